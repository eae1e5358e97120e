"""Registered queries of the engine against their SQL, on the smallest tables."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from glossaria.plans.queries import ORACLES, QUERIES, flagship

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    found = [r.asDict() for r in df.collect()]
    assert found or name in ("merge_secondary", "merge_sequence")
    if name in ORACLES:
        cursor = db.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        expected = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cursor.fetchall())
        assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in found) == expected


def test_flagship(spark):
    assert flagship(spark, SMALL).count() > 0


def test_whole_queries_leave_nothing_out(spark, tmp_path):
    docs = [("Cat cot sings of extraordinary things", "src2"), ("a cat walked; a coat, extraordinary", "src2"), ("Cot walked by cats uninteresting", "src4"), (None, "src4")]
    said = ["Hello walking cat", "Hello wanderer cot", "Hello walking cat", "", None]
    asked = ["cat", "extraordinary walked"]
    for name, rows, schema in (("documents", [(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, source string"), ("conversations", [("user", t) for t in said], "role string, text string"), ("benchmark", list(enumerate(asked)), "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    words = lambda t: re.findall("[a-z]+", (t or "").lower())
    terms = {}
    for k, (t, source) in enumerate(docs):
        for w in words(t):
            terms.setdefault((source, w), set()).add(k)
    reading = lambda w: re.sub("[aeiou]", "", w) or w
    pos = lambda w: "v" if w.endswith(("ed", "ing")) else "np" if w.endswith("s") else "adv" if w.endswith("ly") else "n"
    tag = lambda n: "common" if n >= 5 else "rare" if n == 1 else "usual"
    by_reading = {r: sorted(x for x in terms if reading(x[1]) == r) for r in {reading(w) for _, w in terms}}

    expected = {(r, tuple(sorted({w for _, w in xs})), max(len(terms[x]) for x in xs), len(xs)) for r, xs in by_reading.items()}
    assert {(r["reading"], tuple(r["expressions"]), r["score"], r["definitions"]) for r in run("group_term")} == expected
    expected = set()
    for r, xs in by_reading.items():
        for source in {s for s, _ in xs}:
            own, every = sorted(w for s, w in xs if s == source), {w for _, w in xs}
            expected.add((source, r, tuple(own) if every - set(own) else ()))
    assert {(r["dictionary"], r["reading"], tuple(r["terms"])) for r in run("disambiguation_sets")} == expected
    expected = {(f"{s}/{w}", k > 0 and xs[k - 1][0] == s and pos(xs[k - 1][1]) == pos(w)) for xs in by_reading.values() for k, (s, w) in enumerate(xs)}
    assert {(r["id"], r["redundant"]) for r in run("redundant_tags_lag")} == expected
    expected = {(w, t, s) for (s, w), n in terms.items() for t in (pos(w), tag(len(n)))}
    assert {(r["expression"], r["tag"], s) for r in run("merge_tags") for s in r["dictionaries"]} == expected
    expected = set()
    for item, t in enumerate(asked):
        hits = {x for x in terms if x[1] in words(t)}
        same = {(len(w), reading(w)) for s, w in hits if s == "src2"}
        expected |= {(item, f"{s}/{w}", len(n)) for (s, w), n in terms.items() if s == "src2" and (len(w), reading(w)) in same and (s, w) not in hits}
    assert expected and {tuple(r) for r in run("merge_sequence")} == expected
    found = {}
    for r in run("batch_lookup_whole"):
        found.setdefault(r["text"], []).append((r["rank"], r["expression"]))
    assert found.keys() == {w for t in said for w in words(t)}
    assert (1, "cat") in found["cat"] and (1, "cot") in found["cot"] and (None, None) in found["hello"]
