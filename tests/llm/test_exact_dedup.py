"""The digest index against equal normalised texts, on awkward rows, over batches and jobs."""

import hashlib
import re
from collections import Counter, defaultdict

from glossaria.llm import exact_dedup, queries
from glossaria.llm.common import of_scan
from pyspark.sql import functions as F

NULL = -(1 << 63)
COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: NULL if i is None else i)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return Counter(out)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def told(df):
    return Counter(map(tuple, df.withColumn("text_sha256", F.lower(F.hex("digest"))).select(*COLUMNS).collect()))


def test_awkward_rows(spark, stored):
    assert told(exact_dedup.deduplicate(of_scan(stored))) == expected(rows_of(stored))
    assert told(exact_dedup.deduplicate(of_scan(stored), batches=5)) == expected(rows_of(stored))
    assert exact_dedup.deduplicate(stored.limit(0)).count() == 0


def test_white_space(spark):
    texts = ["a b", "a\t\n b", " a b", "a b ", "a b", "a  b ", "", None, " ", "\x0b\x0c", "a\x1fb", "x" * 500_000 + "  y", "x" * 500_000 + "\ny"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, digest int")
    assert told(exact_dedup.deduplicate(docs)) == expected(rows_of(docs))


def test_hot_groups_meet_by_broadcast(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 2500).cast("string"))).alias("text"))
    assert told(exact_dedup.deduplicate(docs, batches=3)) == expected(rows_of(docs))


def test_index_is_opened_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "it's an index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, root)
    got = told(first.add(frame([(1, "a"), (2, "b"), (3, "a")])))
    assert got == expected([(1, "a"), (2, "b"), (3, "a")])
    # A job that dies before it ends leaves rows that don't count.
    broken = exact_dedup.DigestIndex(spark, root)
    note = broken._note
    monkeypatch.setattr(broken, "_note", lambda *rows: (_ for _ in ()).throw(RuntimeError()) if rows[0][1] == "done" else note(*rows))
    try:
        broken.add(frame([(4, "c"), (5, "a")]))
    except RuntimeError:
        pass
    again = exact_dedup.DigestIndex(spark, root)
    assert again.failed == [1] and again.next == 2
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in again.add(frame([(6, "c"), (7, "a"), (8, "b "), (9, "b")])).collect()]
    assert sorted(rows) == [(6, 6, 1, True), (7, 1, 3, False), (8, 8, 1, True), (9, 2, 2, False)]
    assert again._table("entries").count() == 4
    again.add(frame([])).count()
    assert again._table("entries").count() == 4
    again.drop()


def test_batches_meet_buckets_without_a_shuffle_of_the_index(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    index.add(spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    plan = index.groups()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "SelectedBucketsCount" in plan


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op13_exact_dedup']})").fetchall()
    assert Counter(map(tuple, queries.op13_exact_dedup(spark, sf).select(*COLUMNS).collect())) == Counter(want)
