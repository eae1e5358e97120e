import random

import pytest

WORDS = "the of and in to elephant river mountain quietly seven walked orange window théâtre straße niño under stone paper candle winter summer garden letter".split()


def prose(rng: random.Random, n: int, line: int = 12) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "a", "e", "ing", str(rng.randrange(30))]) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + line]) for k in range(0, n, line))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, blank, repeated and equal texts, ties, near copies, shared passages, one very long text, and extra
    columns whose names the operators may use."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = [None, "", "   \n\t ", "one", "two words", *base, base[0], base[0], base[1] + " end", base[2].replace("the", "tha", 1), base[3] + "\n" + passage, passage + "\n" + base[4], "x" * 3000, "y " * 200, prose(rng, 6000), base[5].upper(), passage, "\0odd\x1fbytes #*$%&|<> " * 5]
    near = base[6].split(" ")
    for k in range(6):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"edit{k}"
        texts.append(" ".join(copy))
    rows = [(k, t, ["en", "fr", None][k % 3], ["s0", None][k % 2], k, f"extra{k}", True, 0.5) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base[7], "en", "s0", 1, "x", None, None), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid string, kept boolean, words double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def stored(spark, awkward, tmp_path_factory):
    """The same rows as a file scan over several partitions."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    awkward.repartition(3).write.parquet(path)
    return spark.read.parquet(path)
