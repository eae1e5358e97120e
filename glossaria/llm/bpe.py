"""BPE encoding and decoding of whole texts.

Encoding is a streaming transducer. The merge list fixes how far to the right of a position bytes can still change what
is merged there: a merge can be prevented, or made possible, only by an earlier merge that consumes or builds its right
operand, so the reach of each merge follows from those of earlier merges in one pass over the list. Bytes further away
than the largest reach cannot matter, and tokens before them are emitted. Pieces that came before are remembered in a
table of bounded size. Decoding feeds token bytes to an incremental UTF-8 decoder, chunk by chunk.

Defined cases: a null text is empty; an empty text has no tokens; the strings of special tokens are those tokens (as the
library does unless told otherwise); other columns pass through `encode` and `decode` unchanged.
"""

from __future__ import annotations

import codecs
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from glossaria.llm.common import small_batches, text_or_empty

#: The byte-level pre-tokenizer's pattern. `\s` is spelled out as Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
CHUNK = 1 << 16  # characters cut into pieces at a time
NO_MERGE = 1 << 62
MADE = "__glossaria_made__"
HELD = 3  # a piece that ends in the last characters of a chunk may still change
REMEMBERED = 400_000  # pieces
LONGEST_REMEMBERED = 64  # characters


def byte_letters() -> dict[str, int]:
    """The vocabulary writes bytes as letters: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces(dict):
    """Tokens of pieces; what is missing is encoded, and the table starts anew when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(self.encode(piece.encode()))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        ids = {self.bytes_of[i]: i for i in vocab.values()}
        self.first = [ids[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}  # to the merge's rank
        self.wholes: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merged[vocab[left], vocab[right]] = rank
            self.wholes.append(vocab[left + right])
        self.lookahead = self._lookahead()
        self.window = 4 * self.lookahead
        self.pieces = Pieces(self.encode_bytes)
        self.cut = regex.compile(PIECES).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _lookahead(self) -> int:
        """Bytes after a token's start that can decide it, at most."""
        reach: dict[int, int] = {}  # of earlier merges that consume (as left operand) or build a token
        size = [len(b) for b in self.bytes_of]
        most = max(size)
        for (left, right), whole in zip(self.merged, self.wholes, strict=True):  # in order of rank
            own = size[left] + max(size[right], reach.get(right, 0))
            most = max(most, own)
            for token in (left, whole):
                reach[token] = max(reach.get(token, 0), own)
        return most + max(size)

    def _merge(self, tokens: list[int]) -> list[int]:
        """Merges of lowest rank first, of equal rank from the left."""
        ranked = self.merged.get
        ranks = [ranked(p, NO_MERGE) for p in itertools.pairwise(tokens)]
        while ranks and (best := min(ranks)) is not NO_MERGE:
            k = ranks.index(best)
            tokens[k : k + 2] = [self.wholes[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = ranked((tokens[k - 1], tokens[k]), NO_MERGE)
            if k < len(ranks):
                ranks[k] = ranked((tokens[k], tokens[k + 1]), NO_MERGE)
        return tokens

    def encode_bytes(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece, however long, in constant memory besides the piece."""
        at = 0
        while len(data) - at > self.window:
            stable, end = self.window - self.lookahead, 0
            for token in self._merge([self.first[b] for b in data[at : at + self.window]]):
                if end + len(self.bytes_of[token]) > stable:
                    break
                end += len(self.bytes_of[token])
                yield token
            at += end
        yield from self._merge([self.first[b] for b in data[at:]])

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        held = ""
        for at in range(0, len(text), CHUNK):
            found = self.cut(held + text[at : at + CHUNK])
            held = ""
            if at + CHUNK < len(text):
                while found and len(held) < HELD:
                    held = found.pop() + held
            yield from map(self.pieces.__getitem__, found)
        if held:
            yield from map(self.pieces.__getitem__, self.cut(held))

    def encode(self, text: str) -> np.ndarray:
        parts = self.apart(text) if self.apart and any(s in text for s in self.special) else [text]
        tokens = (t for part in parts for t in ([(self.special[part],)] if part in self.special else self._plain(part))) if len(parts) > 1 else self._plain(text)
        return np.fromiter(itertools.chain.from_iterable(tokens), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        known = self.bytes_of
        out = [machine.decode(b"".join([known[i] for i in ids[at : at + CHUNK].tolist()])) for at in range(0, len(ids), CHUNK)]
        return "".join([*out, machine.decode(b"", True)])


_loaded: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    """One transducer a worker process."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def _with(batch: pa.RecordBatch, column: pa.Array, drop: str | None = None) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), column], names=[*kept, MADE])


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the text column replaced by its token ids, as column `into` (in place of one of that name)."""

    def run(batches):
        t = load(tokenizer_path)
        for batch in batches:
            found = [t.encode(x) for x in batch.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            yield _with(batch, ids, text_col)

    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in (text_col, into)]
    schema = T.StructType([*kept, T.StructField(MADE, T.ArrayType(T.IntegerType()))])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], text_or_empty(text_col).alias(text_col)).mapInArrow(run, schema).withColumnRenamed(MADE, into)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """`encoded` with the decoded text as another column."""

    def run(batches):
        t = load(tokenizer_path)
        for batch in batches:
            lists = batch.column(ids_col)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [t.decode(flat[a:b]) for a, b in itertools.pairwise(ends)]
            yield _with(batch, pa.array(texts, pa.string()))

    small_batches(encoded.sparkSession)
    encoded = encoded.drop(into)
    schema = T.StructType([*encoded.schema, T.StructField(MADE, T.StringType())])
    return encoded.mapInArrow(run, schema).withColumnRenamed(MADE, into)
