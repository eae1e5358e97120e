"""The audit against plain sums over all terms and pairs, on awkward and on random rows."""

import random
import re
from collections import Counter, defaultdict

from glossaria.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=10):
    in_docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in [*names, None]}
        share = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in total}
        for s in names:
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in names if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(share[s][t], share[None][t]), t.encode()) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)]
    return Counter(out)


def told(df):
    return Counter(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_awkward_rows(spark, stored):
    rows = [tuple(r) for r in stored.select("text", "lang", "source").collect()]
    for least in (1, 3, 10, 1000):
        assert told(divergence.audit(stored, least)) == plain(rows, least)
    assert divergence.audit(stored.limit(0)).count() == 0


def random_rows(seed, n, sources):
    rng = random.Random(seed)
    words = [w + s for w in ("elephant", "Ärger", "ño", "x", "straße", "KELVINK") for s in ("", "a", "B", "É", "'s", "1z", "c d")]
    return [(" ".join(rng.choices(words[: 3 + k % 40], k=rng.randrange(40))), rng.choice(["en", "de", None, "de"]), rng.choice([*(f"s{j}" for j in range(sources)), None, "hot", "hot", "hot"])) for k in range(n)]


def test_random_rows(spark):
    for seed, n, sources in ((1, 300, 3), (2, 500, 40), (3, 40, 60)):
        rows = random_rows(seed, n, sources)
        docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
        assert told(divergence.audit(docs, 5)) == plain(rows, 5)


def test_bounded_memory_changes_nothing(spark, monkeypatch):
    rows = random_rows(4, 300, 20)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    monkeypatch.setattr(divergence, "TERMS", 10)
    monkeypatch.setattr(divergence, "PAIRS", 10)
    monkeypatch.setattr(divergence, "TILE", 3)
    assert told(divergence.audit(docs, 5)) == plain(rows, 5)


def test_joins_without_broadcast(spark, monkeypatch):
    rows = random_rows(5, 200, 10)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "FEW_ROWS", 0)
    assert told(divergence.audit(docs, 5)) == plain(rows, 5)


def test_shares_are_exact_for_any_count(spark):
    n, total, kept = 9_000_000_000_000_000, 9_100_000_000_000_123, 77
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    from pyspark.sql import functions as F

    assert row.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.oracle_sql()['op12_source_divergence']})").fetchall()
    assert told(queries.op12_source_divergence(spark, sf)) == Counter(want)
    docs = queries.table(spark, sf, "documents")
    assert Counter(want) == plain([tuple(r) for r in docs.select("text", "lang", "source").collect()], 10)


def test_counts_keep_whole_when_sent_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([("a B b", "x", "s"), ("b\u00e9 b", "x", "s"), (None, None, "s"), ("", "x", "t"), ("c c c", "x", "t")], "text string, lang string, source string")
    want = {("x", "s", None, 2, 0), ("x", "s", "a", 1, 1), ("x", "s", "b", 3, 2), ("x", "s", "b\u00e9", 1, 1), ("", "s", None, 1, 0), ("x", "t", None, 2, 0), ("x", "t", "c", 3, 1)}
    for most in (0, 2, 100):
        monkeypatch.setattr(divergence, "TERMS", most)
        assert {tuple(r) for r in divergence.term_counts(docs.coalesce(1), "text", "lang", "source").collect()} == want
