"""Classes of nodes that are linked, where candidates for links share a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from glossaria.llm.common import cut
from glossaria.llm.components import connected


def classes_in_buckets(met: DataFrame, verified: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, class: of every node that is linked to another one.

    `met` has bucket, a (the bucket's chosen member) and b (each member, the chosen one too); `verified` takes pairs
    (a, b) and returns those that are linked. Each member is compared with the chosen one. In buckets that still hold
    several classes, members outside the largest are then compared with members of other classes, so of two members of
    one bucket either both are in one class or they have been considered. Pairs inside a class are never made.

    `across` takes groups of members that share a chosen one (a, node, class, minor: of another class than the chosen
    one's) and returns all pairs (a, b) of one group and of different classes that can be linked; without it, all of one
    bucket are taken. One of such a pair is minor.
    """
    stars = met.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    links = cut(verified(stars).select("a", "b"))
    classes = connected(links)
    placed = met.join(classes.withColumnRenamed("node", "b"), "b", "left").select("bucket", "a", "b", F.coalesce("class", "b").alias("class"))
    if across:
        members = cut(placed.select("a", F.col("b").alias("node"), "class").distinct())
        chosen = members.where(F.col("a") == F.col("node")).select("a", F.col("class").alias("a_class"))
        own = members.join(chosen, "a").withColumn("minor", F.col("class") != F.col("a_class")).drop("a_class")
        mixed = own.groupBy("a").agg(F.max("minor").alias("any"), F.count("*").alias("n")).where((F.col("n") > 2) & F.col("any")).select("a")
        rest = across(cut(own.join(mixed, "a")))
    else:
        sizes = placed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("most"), F.count("*").alias("classes"), F.sum("n").alias("size"))
        mixed = mixed.where((F.col("classes") > 1) & (F.col("size") > 2)).select("bucket", F.col("most.class").alias("largest"))
        rest = _in_buckets(cut(placed.join(mixed, "bucket")))
    more = cut(verified(rest.distinct()).select("a", "b"))
    return classes if more.isEmpty() else connected(links.unionByName(more))


def _in_buckets(held: DataFrame) -> DataFrame:
    minor = held.where(F.col("class") != F.col("largest")).select("bucket", F.col("b").alias("x"), F.col("class").alias("x_class"), "a")
    rest = minor.join(held.select("bucket", F.col("b").alias("y"), F.col("class").alias("y_class"), "largest"), "bucket")
    once = (F.col("y_class") == F.col("largest")) | (F.col("x") < F.col("y"))
    rest = rest.where((F.col("x_class") != F.col("y_class")) & (F.col("x") != F.col("a")) & (F.col("y") != F.col("a")) & once)
    return rest.select(F.col("x").alias("a"), F.col("y").alias("b"))
