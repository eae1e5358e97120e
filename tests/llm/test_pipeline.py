"""Each stage of the corpus pipeline against a plain version, on awkward rows: what one stage keeps is the next one's input."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from glossaria.llm import line_dedup, minhash
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tests.llm.test_text_operators import ALNUM_WORDS, LOWER, NULL, SPACE_WORDS, brute_classes, distance

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "rid", "kept", "words"]


def order(row):
    return NULL if row["doc_id"] is None else row["doc_id"]


def good(rows, _):
    """Groups are too small for an estimate here, so the base rules decide."""
    for r in rows:
        w = SPACE_WORDS.findall(r["text"] or "")
        seen, covered = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                covered |= {k + j for k in places for j in range(3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            yield r


def lines_once(rows, _):
    lines = {}
    for r in rows:
        for k, x in enumerate(r["text"].encode().split(b"\n")):
            if re.search(rb"[0-9A-Za-z\x80-\xff]", x):
                lines[x] = min(lines.get(x, (1 << 62, 0)), (order(r), k))
    names = list(lines)
    long_ = [len(x) >= line_dedup.LEAST for x in names]
    letters = np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in names])
    near = set()
    for a in range(len(names)):  # two edits change four counts at most
        for b in np.flatnonzero(np.abs(letters[:a] - letters[a]).sum(1) <= 4).tolist():
            if long_[a] and long_[b] and distance(names[a], names[b]) <= 2:
                near.add((a, b))
    cls, first = dict(zip(names, brute_classes(names, lambda a, b: (a, b) in near), strict=True)), {}
    for x, place in lines.items():
        first[cls[x]] = min(first.get(cls[x], place), place)
    for r in rows:
        own = r["text"].encode().split(b"\n")
        kept = [x for k, x in enumerate(own) if x not in cls or first[cls[x]] >= (order(r), k)]
        text = b"\n".join(kept).decode()
        if len(kept) == len(own):
            yield r
        elif text:
            yield r | {"text": text, "n_chars": len(text)}


def one_of_each(rows, spark):
    texts = list({r["text"] for r in rows})
    idf = minhash.idf_table(spark.createDataFrame([(r["text"],) for r in rows], "text string"))
    sets = [dict(zip(*(x.tolist() for x in minhash.weighted_shingles([t.encode()], idf)[1:]), strict=True)) for t in texts]

    def linked(a, b):
        common = sum(min(w, sets[b].get(h, 0)) for h, w in sets[a].items())
        return common / (sum(sets[a].values()) + sum(sets[b].values()) - common) >= 0.8

    cls = dict(zip(texts, brute_classes(texts, linked), strict=True))
    seen = set()
    for r in sorted(rows, key=order):
        if cls[r["text"]] not in seen:
            seen.add(cls[r["text"]])
            yield r


def uncontaminated(rows, benchmark):
    windows = set()
    for text in benchmark:
        w = ALNUM_WORDS.findall((text or "").translate(LOWER))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(x) for x in windows}
    for r in rows:
        w, hit = ALNUM_WORDS.findall(r["text"].translate(LOWER)), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            yield r


def plain(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def tables(spark, awkward, tmp_path_factory):
    import random

    rng, folder = random.Random(9), tmp_path_factory.mktemp("sf")
    item = prose(rng, 40)
    extra = [(900, prose(rng, 30) + " " + item, "en", "s0", 1), (901, prose(rng, 500) + " " + " ".join(item.split()[:15]), "en", "s0", 1), (902, prose(rng, 70) + "\nyes\n" + prose(rng, 30), "fr", None, 1), (903, "yes\n" + prose(rng, 90), "fr", None, 1)]
    docs = awkward.select(*COLUMNS).unionByName(spark.createDataFrame([(*e, "x", None, 0.5) for e in extra], awkward.select(*COLUMNS).schema))
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    benchmark = [item, None, "", "two words of it", prose(rng, 13)]
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), benchmark


def test_stages_are_those_of_brute_force(spark, tables, tmp_path):
    sf_dir, benchmark = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    for (name, stage), brute, given in zip(corpus_pipeline.STAGES[:-1], (good, lines_once, one_of_each, uncontaminated), (None, None, spark, benchmark), strict=True):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        expected = list(brute(rows, given))
        assert docs.columns == COLUMNS, name
        found = [r.asDict() for r in docs.collect()]
        if name == "near_dedup":  # of rows with one id and one text either may stay
            assert sorted((order(r), r["text"]) for r in found) == sorted((order(r), r["text"]) for r in expected), name
        else:
            assert plain(found) == plain(expected), name
        assert name == "quality_rules" or 0 < len(found) <= len(rows), name
        rows = found
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted((order(r), r["ids"]) for r in last) == sorted((order(r), library.encode(r["text"], add_special_tokens=False).ids) for r in rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)
    assert {900} & {r["doc_id"] for r in last} == set() and 901 in {r["doc_id"] for r in last}


def test_run_applies_all_stages_and_takes_empty_tables(spark, tables, tmp_path):
    sf_dir, _ = tables
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
