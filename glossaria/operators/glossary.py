"""Definitions as trees: their plain text, the media they need, and their normal form.

A definition is a text, or a JSON object: a text, an image, or structured content, whose nodes hold texts, lists and other
nodes to any depth. Trees are folded in the JVM, level by level, each in its own row: a pass replaces every node of a
definition's list by what it holds, in order, so texts need no way back to their tree. `LEVELS` passes are one job; what
is deeper is written and goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from glossaria.sources.scratch import written

# Nodes that end a line, nodes that end a cell, and nodes whose content isn't plain text.
LINES = ("li", "div", "ol", "ul", "table", "thead", "tbody", "tfoot", "tr", "details", "summary")
CELLS = ("td", "th")
HIDDEN = ("rt", "rp")
#: Attributes of images by the kind of their values; sizes that a definition asks for are preferred ones.
IMAGE = {"width": "double", "height": "double", "title": "string", "alt": "string", "description": "string", "pixelated": "boolean", "imageRendering": "string", "appearance": "string", "background": "boolean", "collapsed": "boolean", "collapsible": "boolean", "verticalAlign": "string", "border": "string", "borderRadius": "string", "sizeUnits": "string"}
#: White space at the ends of a text.
TRIM = r"[\s   -     　﻿\x0B]+"
WAY = "array<int>"
#: What a list holds: a node still to be taken apart, or else a text, or an image as its node.
ITEM = "struct<way:array<int>,node:variant,text:string,done:boolean>"
LEVELS = 10


def _as(node: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(node, path, kind)


def _of_kind(node: Column, name: str, kind: str) -> Column:
    """An attribute, if its value is of this kind."""
    shown = {"string": "STRING", "boolean": "BOOLEAN", "double": "^(BIGINT|DOUBLE|DECIMAL)"}[kind]
    return F.when(F.schema_of_variant(_as(node, "variant", f"$.{name}")).rlike(shown), _as(node, kind, f"$.{name}"))


def is_tree(definition: Column) -> Column:
    """A JSON object of one of the kinds that definitions may have."""
    kind = F.get_json_object(definition, "$.type")
    return definition.startswith("{") & F.coalesce(kind.isin("text", "image", "structured-content"), F.lit(False))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is found once."""
    return F.transform(F.array(value), f)[0]


def _item(way: Column, node: Column | None = None, text: Column | None = None, done: bool = False) -> Column:
    void = F.lit(None)
    return F.struct(way.alias("way"), (void if node is None else node).cast("variant").alias("node"), (void if text is None else text).cast("string").alias("text"), F.lit(done).alias("done")).cast(ITEM)


def _expanded(item: Column, images: bool) -> Column:
    """The items that one item holds: itself, if it is done."""
    node = item["node"]
    way = lambda k: F.concat(item["way"], F.array(F.lit(k) if isinstance(k, int) else k)) if images else item["way"]
    none = F.array().cast(f"array<{ITEM}>")

    def of_object(tag: Column) -> Column:
        after = F.when(tag.isin("br", *LINES), "\n").when(tag.isin(*CELLS), " ")
        inside = F.array(_item(way(0), _as(node, "variant", "$.content")))
        image = F.array(_item(item["way"], node, done=True)) if images else none
        ending = none if images else F.when(after.isNotNull(), F.array(_item(way(1), text=after, done=True))).otherwise(none)
        return F.when(tag == "img", image).when(tag == "br", ending).when(tag.isin(*HIDDEN), none).otherwise(F.concat(inside, ending))

    def of_other(kids: Column) -> Column:
        text = none if images else F.when(F.schema_of_variant(node) == "STRING", F.array(_item(item["way"], text=_as(node, "string"), done=True))).otherwise(none)
        return F.when(kids.isNotNull(), F.transform(kids, lambda kid, k: _item(way(k), kid))).otherwise(text)

    tag = F.coalesce(_as(node, "string", "$.tag"), F.when(_as(node, "variant", "$.content").isNotNull(), ""))
    held = _let(tag, lambda t: F.when(t.isNotNull(), of_object(t)).otherwise(_let(_as(node, "array<variant>"), of_other)))
    return F.when(item["done"], F.array(item)).when(node.isNull(), none).otherwise(held)


def taken_apart(trees: DataFrame, images: bool = False) -> DataFrame:
    """`trees` with `items` instead of `node`, a variant or null: the texts that a tree holds, or its images with their ways
    from the root, in order."""
    by = [c for c in trees.columns if c != "node"]
    level = trees.select(*by, F.array(_item(F.array().cast(WAY), F.col("node"))).alias("items"))
    found = []
    while True:
        for _ in range(LEVELS):
            level = level.withColumn("items", F.flatten(F.transform("items", lambda x: _expanded(x, images))))
        level = written(level.select(*by, "items")).withColumn("open", F.exists("items", lambda x: ~x["done"]))
        if level.where("open").isEmpty():
            return reduce(DataFrame.unionByName, [*found, level.drop("open")])
        found.append(level.where("NOT open").drop("open"))
        level = level.where("open").drop("open")


def tidy(text: Column) -> Column:
    """No blanks before line ends, at most one empty line, single blanks, nothing at the ends."""
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return F.regexp_replace(text, f"^{TRIM}|{TRIM}$", "")


def _each(terms: DataFrame) -> DataFrame:
    each = terms.select("dictionary", "id", F.posexplode("definitions").alias("k", "definition"))
    return each.withColumn("tree", F.when(is_tree(F.col("definition")), F.try_parse_json("definition")))


def plain_definitions(terms: DataFrame) -> DataFrame:
    """dictionary, id, k, text: what each definition says, without markup; images say nothing, and readings above words
    (ruby) are left out. A definition that redirects, or an object of no known kind, stands as it is."""
    kind = _as(F.col("tree"), "string", "$.type")
    said = F.when(F.col("tree").isNull(), F.col("definition")).when(kind == "text", F.coalesce(_as(F.col("tree"), "string", "$.text"), F.lit(""))).otherwise("")
    deep = F.col("tree").isNotNull() & (kind == "structured-content")
    each = _each(terms).select("dictionary", "id", "k", F.when(~deep, said).alias("said"), deep.alias("deep"), F.when(deep, _as(F.col("tree"), "variant", "$.content")).alias("node"))
    told = tidy(F.array_join(F.transform("items", lambda x: x["text"]), ""))
    return taken_apart(each).select("dictionary", "id", "k", F.when(F.col("deep"), told).otherwise(F.col("said")).alias("text"))


def image_requirements(terms: DataFrame) -> DataFrame:
    """dictionary, id, k, way, path and what a definition asks of each image, however deep it lies."""
    kind = _as(F.col("tree"), "string", "$.type")
    deep = F.when(kind == "structured-content", _as(F.col("tree"), "variant", "$.content"))
    each = _each(terms).where(F.col("tree").isNotNull()).select("dictionary", "id", "k", F.when(kind == "image", F.col("tree")).alias("own"), deep.alias("node"))
    own = F.when(F.col("own").isNotNull(), F.array(_item(F.array().cast(WAY), F.col("own"), done=True))).otherwise(F.col("items"))
    every = taken_apart(each, images=True).select("dictionary", "id", "k", F.explode(own).alias("item")).select("dictionary", "id", "k", "item.way", F.col("item.node").alias("image"))
    named = lambda n: {"width": "preferred_width", "height": "preferred_height"}.get(n, n)
    return every.select("dictionary", "id", "k", "way", _as(F.col("image"), "string", "$.path").alias("path"), *(_of_kind(F.col("image"), n, kind).alias(named(n)) for n, kind in IMAGE.items()))


def resolved_images(requirements: DataFrame, media: DataFrame) -> DataFrame:
    """Requirements with the size of the file they name; `found` is false where the archive hasn't got it."""
    files = media.select("dictionary", "path", "width", "height", F.lit(True).alias("found"))
    return requirements.join(files, ["dictionary", "path"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
