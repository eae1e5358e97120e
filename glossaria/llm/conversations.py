"""Conversation structure repair: the cheapest edits that give each conversation legal turns, by rank-compressed DP.

Legal roles are nothing, or an optional system turn followed by pairs of user and assistant. A row is kept, gets another
role, or is deleted; turns without text are inserted between. The DP goes over rows; its states are what the last turn
was. One macro edit is a run of inserted turns followed by what becomes of the row, written as a code (`IK`, `D`, ...): no
code begins another, so audits of as many macros compare as their codes do, one after the other. An audit is therefore
never written down while edits are chosen: a state holds its cost and its rank among the audits of its layer, which
follows from the rank of its parent and the code, and a pointer to both. The audit is read off the pointers at the end.

Rows are dealt by range in the order of conversation and turn, so a partition holds whole conversations but for its
first and its last. A conversation within one partition is repaired as it streams by. One that several partitions hold
(at most one begins in each) is cut into pieces there: each piece gives the cost and rank of the best way from every
state to every state, these are combined over the pieces, and each piece then follows its own way. No task holds more
of a conversation than its partition does. Only the digest of the repaired text must read a long one in order: it
streams by, and nothing is kept of it.

Defined cases: rows of equal turn are ordered by role and text, null turns first; a null id is a conversation of its own;
null roles and texts are one space (no role, and blank); a role counts by its first letter, a role that is empty
or begins otherwise can't be kept; conversations that lose all rows have zeros and the digest of an empty string;
repeated rows are duplicates; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossaria.llm.common import ROW, checkpointed, cut, numbered, small_batches

BLANK = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state by initial.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A run of more than two inserted turns passes a state twice and is never cheapest.
RUNS = 2
#: Macro codes in the order of their letters; none begins another.
CODES = sorted("I" * k + e for k in range(RUNS + 1) for e in "DKR")
#: Turns that end a conversation in each state, if it can: inserted after its last row.
ENDS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
SAME, BLANK_FAULT, COPY, CUT_OFF = range(4)
PAIRS = {"su", "ua", "au"}


def inserted(state: int, times: int) -> int:
    """The state after so many inserted turns: user and assistant in turn."""
    for _ in range(times):
        state = ASSISTANT if state == USER else USER
    return state


@cache
def moves(initial: str, fault: int) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, code) of a row: of each pair of states the cheapest macro, then the first in order."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for begin in range(4):
        for number, code in enumerate(CODES):
            runs, edit = len(code) - 1, code[-1]
            state, cost = inserted(begin, runs), INSERT * runs
            if edit == "D":
                end, cost = state, cost + DELETE
            elif fault in (BLANK_FAULT, COPY):
                continue
            else:
                cost += TRUNCATED if fault == CUT_OFF else 0
                if edit == "K":
                    end = NEXT[state].get(initial)
                    cost += KEEP
                else:
                    end = inserted(state, 1)
                    cost += REROLE
            if end is not None:
                best[begin, end] = min(best.get((begin, end), (1 << 60, 0)), (cost, number))
    return tuple((a, b, *best[a, b]) for a, b in sorted(best))


Layer = dict[int, tuple[int, int]]  # state: cost, rank


def step(layer: Layer, ways: tuple[tuple[int, int, int, int], ...]) -> tuple[Layer, bytes]:
    """The next layer and its pointers: one byte a state, code and parent."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for a, b, cost, code in ways:
        if a in layer:
            old_cost, rank = layer[a]
            found = (old_cost + cost, rank, code, a)
            if b not in best or found < best[b]:
                best[b] = found
    order = {b: k for k, b in enumerate(sorted(best, key=lambda b: best[b][1:3]))}
    return {b: (x[0], order[b]) for b, x in best.items()}, bytes(best[b][2] * 4 + best[b][3] if b in best else 255 for b in range(4))


def forward(kinds: list[tuple[str, int]], begin: int) -> tuple[Layer, list[bytes]]:
    """The last layer from one state on, and all pointers, for rows by (initial, fault)."""
    layer, pointers = {begin: (0, 0)}, []
    for kind in kinds:
        layer, points = step(layer, moves(*kind))
        pointers.append(points)
    return layer, pointers


def backward(pointers: list[bytes], end: int) -> tuple[int, list[str]]:
    """The state the way began in and its macros."""
    codes = []
    for points in reversed(pointers):
        code, end = divmod(points[end], 4)
        codes.append(CODES[code])
    return end, codes[::-1]


def best_end(layer: Layer) -> tuple[int, int]:
    """The state to end in and the whole cost."""
    cost, _, state = min((cost + INSERT * ENDS[state], rank, state) for state, (cost, rank) in layer.items())
    return state, cost


def repair(kinds: list[tuple[str, int]]) -> tuple[int, list[str]]:
    """The cost and the macros of the cheapest edits of a whole conversation; the last entry is what is inserted at the end."""
    layer, pointers = forward(kinds, START)
    end, cost = best_end(layer)
    return cost, [*backward(pointers, end)[1], "I" * ENDS[end]]


def turns(codes: list[str], rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns, from one state on; `codes` may have one entry more than rows."""
    for k, code in enumerate(codes):
        for letter in code:
            if letter == "I" or letter == "R":
                state = inserted(state, 1)
                yield NAMES[state], rows[k][1] if letter == "R" else ""
            elif letter == "K":
                state = NEXT[state][rows[k][0][:1]]
                yield rows[k]


def fault_of(role: str, text: str, seen: set) -> int:
    """The first fault of a row, where digests of earlier rows have been `seen`."""
    bare, key = text.rstrip(SPACES), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    old = key in seen
    seen.add(key)
    return BLANK_FAULT if not bare else COPY if old else CUT_OFF if bare[-1] not in ".!?" else SAME


def damaged(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, gone of rows damaged by a checksum of id and turn, nulls as one space. A row that is
    dropped stays, marked, so that its conversation is told of."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space(id_col), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.translate(space("text"), ".!?", "")).when(way == 0, "").otherwise(space("text"))
    role = F.when(way == 4, "user").when(way == 0, "").otherwise(space("role"))
    made = rows.select(F.col(id_col).alias("conv_id"), "turn", role.alias("role"), text.alias("text"), (way == 0).alias("gone"), F.col(ROW), F.when(way == 3, 2).otherwise(1).alias("times"))
    return made.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Facts:
    """What a piece of a conversation tells of its rows' turns and roles, as they stream by."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.distinct = self.illegal = self.rows = 0
        self.first = self.last = None

    def take(self, turn: int | None, role: str) -> None:
        if turn is not None:
            self.distinct += turn != self.high  # rows come by turn
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.rows:
            self.illegal += self.last + role[:1] not in PAIRS
        else:
            self.first = role[:1]
        self.last, self.rows = role[:1], self.rows + 1


def told(facts: Facts, kinds: list[tuple[str, int]], rows: list[tuple[str, str]]) -> tuple:
    """The result of a whole conversation."""
    cost, codes = repair(kinds)
    text = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns(codes, rows, START)).encode()).hexdigest()
    gaps = 0 if facts.low is None else facts.high - facts.low + 1 - facts.distinct
    faults = [sum(k[1] == x for k in kinds) for x in (BLANK_FAULT, COPY, CUT_OFF)]
    return gaps, *faults, facts.illegal, cost, "".join(codes), text


def streamed(dealt: DataFrame, id_type: str) -> DataFrame:
    """Results of conversations whose rows stand together in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [c.split()[0] for c in RESULT.split(", ")]
        current, facts, rows, marks, seen = None, Facts(), [], [], set()

        def packed(done: list[tuple]) -> pa.RecordBatch:
            ids = pa.array([d[0] for d in done], batch.column("conv_id").type)
            return pa.RecordBatch.from_arrays([ids, *(pa.array([d[1][k] for d in done], kind) for k, kind in enumerate(kinds))], names=["conv_id", *names])

        batch = None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                conv, turn, role, text, gone = row
                if current != (conv,):
                    if current:
                        done.append((current[0], told(facts, marks, rows)))
                    current, facts, rows, marks, seen = (conv,), Facts(), [], [], set()
                if not gone:
                    facts.take(turn, role)
                    rows.append((role, text))
                    marks.append((role[:1], fault_of(role, text, seen)))
            if done:
                yield packed(done)
        if current:
            yield packed([(current[0], told(facts, marks, rows))])

    small_batches(dealt.sparkSession)
    return dealt.select("conv_id", "turn", "role", "text", "gone").mapInArrow(run, f"conv_id {id_type}, {RESULT}")


#: A row of a piece: role's initial and fault. The way through a piece from each state to each: cost and rank by start, end.
PIECE = "low long, high long, distinct long, illegal long, first string, last string, blank long, duplicate long, truncated long, rows long, costs array<long>, ranks array<int>"


def piece_ways(pieces: DataFrame, key: str) -> DataFrame:
    """Of each piece (conv, part, rows in order: turn, initial, fault) its facts and the best ways through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows").to_pylist():
                facts, kinds = Facts(), [(r["initial"], r["fault"]) for r in rows]
                for r in rows:
                    facts.take(r["turn"], r["initial"])
                costs, ranks = [None] * 16, [None] * 16
                for begin in range(4):
                    for end, (cost, rank) in forward(kinds, begin)[0].items():
                        costs[4 * begin + end], ranks[4 * begin + end] = cost, rank
                out.append({"low": facts.low, "high": facts.high, "distinct": facts.distinct, "illegal": facts.illegal, "first": facts.first, "last": facts.last, **{n: sum(k[1] == x for k in kinds) for n, x in (("blank", BLANK_FAULT), ("duplicate", COPY), ("truncated", CUT_OFF))}, "rows": facts.rows, "costs": costs, "ranks": ranks})
            kinds_ = pa.schema([*((n, pa.int64()) for n in ("low", "high", "distinct", "illegal")), ("first", pa.string()), ("last", pa.string()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "rows")), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
            made = pa.RecordBatch.from_pylist(out, kinds_)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("part"), *made.columns], names=[key, "part", *made.schema.names])

    small_batches(pieces.sparkSession)
    return pieces.select(key, "part", "rows").mapInArrow(run, f"{key} string, part int, {PIECE}")


def combined(pieces: list[dict]) -> tuple[int, list[tuple[int, int]], int]:
    """The whole cost, the (begin, end) state of each piece, and what is inserted at the end: layers over pieces."""
    layer, parents = {START: (0, 0)}, []
    for piece in pieces:
        best: dict[int, tuple] = {}
        for a, (cost, rank) in layer.items():
            for b in range(4):
                more = piece["costs"][4 * a + b]
                if more is not None:
                    found = (cost + more, rank, piece["ranks"][4 * a + b], a)
                    if b not in best or found < best[b]:
                        best[b] = found
        order = {b: k for k, b in enumerate(sorted(best, key=lambda b: best[b][1:3]))}
        layer = {b: (x[0], order[b]) for b, x in best.items()}
        parents.append({b: x[3] for b, x in best.items()})
    end, cost = best_end(layer)
    last, ways = end, []
    for parent in reversed(parents):
        ways.append((parent[end], end))
        end = parent[end]
    return cost, ways[::-1], ENDS[last]


def whole_facts(pieces: list[dict]) -> tuple[int, int]:
    """Gaps and illegal neighbours over pieces in order."""
    low = high = last = None
    distinct = illegal = 0
    for p in pieces:
        if p["low"] is not None:
            distinct += p["distinct"] - (p["low"] == high)
            low, high = p["low"] if low is None else low, p["high"]
        if p["rows"]:
            illegal += p["illegal"] + (last is not None and last + p["first"] not in PAIRS)
            last = p["last"]
    return (0 if low is None else high - low + 1 - distinct), illegal


WAYS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, ways array<struct<part:int,begin:int,end:int,more:int>>"


def ways_over(pieces: DataFrame, key: str) -> DataFrame:
    """Of each conversation with all its pieces (at most one of each partition): its figures and the way of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("pieces").to_pylist():
                cost, ways, more = combined(parts)
                gaps, illegal = whole_facts(parts)
                steps = [{"part": p["part"], "begin": a, "end": b, "more": more if p is parts[-1] else 0} for p, (a, b) in zip(parts, ways, strict=True)]
                out.append({"gaps": gaps, **{n: sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "ways": steps})
            step_ = pa.struct([(n, pa.int32()) for n in ("part", "begin", "end", "more")])
            made = pa.RecordBatch.from_pylist(out, pa.schema([*((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("ways", pa.list_(step_))]))
            yield pa.RecordBatch.from_arrays([batch.column(key), *made.columns], names=[key, *made.schema.names])

    small_batches(pieces.sparkSession)
    return pieces.select(key, "pieces").mapInArrow(run, f"{key} string, {WAYS}")


def piece_edits(pieces: DataFrame, key: str) -> DataFrame:
    """Of each piece (rows, begin, end, more) its codes: `codes`, one a row and one for what is inserted at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, begin, end, more in zip(*(batch.column(c).to_pylist() for c in ("rows", "begin", "end", "more")), strict=True):
                _, pointers = forward([(r["initial"], r["fault"]) for r in rows], begin)
                out.append([*backward(pointers, end)[1], "I" * more])
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("part"), batch.column("begin"), pa.array(out, pa.list_(pa.string()))], names=[key, "part", "begin", "codes"])

    small_batches(pieces.sparkSession)
    return pieces.select(key, "part", "rows", "begin", "end", "more").mapInArrow(run, f"{key} string, part int, begin int, codes array<string>")


def repaired_digests(rows: DataFrame, key: str) -> DataFrame:
    """key, repaired_sha256 of rows (key, place, role, text, code, begin of a piece's first row), in order within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, made, any_turn = None, START, hashlib.sha256(), False
        for batch in batches:
            done = []
            for conv, role, text, code in zip(*(batch.column(c).to_pylist() for c in (key, "role", "text", "code")), strict=True):
                if current != conv:
                    if current is not None:
                        done.append((current, made.hexdigest()))
                    current, state, made, any_turn = conv, START, hashlib.sha256(), False
                for r, t in turns([code], [(role, text)], state):
                    made.update(f"{chr(10) if any_turn else ''}{r}:{t}".encode())
                    any_turn = True
                for letter in code:
                    state = state if letter == "D" else NEXT[state][role[:1]] if letter == "K" else inserted(state, 1)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[key, "repaired_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([made.hexdigest()])], names=[key, "repaired_sha256"])

    small_batches(rows.sparkSession)
    return rows.select(key, "role", "text", "code").mapInArrow(run, f"{key} string, repaired_sha256 string")


def cut_up(dealt: DataFrame) -> DataFrame:
    """Results of conversations that several partitions hold: `dealt` has conv (never null), part and place too."""
    rows = cut(dealt.where(~F.col("gone")).withColumn("digest", F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, 16)))
    first = rows.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    marked = rows.join(first, ["conv", "digest"], "left")
    last = F.substring(F.rtrim(F.translate("text", SPACES, " " * len(SPACES))), -1, 1)
    fault = F.when(~F.col("text").rlike(BLANK), BLANK_FAULT).when(F.col("place") > F.col("first"), COPY).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(SAME)
    narrow = cut(marked.select("conv", "part", "place", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")))
    pieces = cut(narrow.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "initial", "fault"))).alias("rows")))  # bounded by a partition
    ways = piece_ways(pieces, "conv")
    parts = F.sort_array(F.collect_list(F.struct("part", *(c.split()[0] for c in PIECE.split(", ")))))
    known = cut(ways_over(ways.groupBy("conv").agg(parts.alias("pieces")), "conv"))
    edits = cut(piece_edits(pieces.join(known.select("conv", F.explode("ways").alias("w")).select("conv", "w.*"), ["conv", "part"]), "conv"))
    audits = edits.groupBy("conv").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("part", F.concat_ws("", "codes").alias("a")))), lambda p: p["a"])).alias("audit"))

    # Codes by row: a piece's rows are those of its partition in order; the last code goes to a row after all.
    codes = edits.select("conv", "part", F.posexplode("codes").alias("k", "code"))
    at = pieces.select("conv", "part", F.posexplode(F.transform("rows", lambda r: r["place"])).alias("k", "place"))
    placed = codes.join(at, ["conv", "part", "k"], "left").select("conv", "place", "code", "part")
    inner = rows.select("conv", "place", "role", "text").join(placed.where(F.col("place").isNotNull()).select("conv", "place", "code"), ["conv", "place"])
    tail = placed.where(F.col("place").isNull() & (F.col("code") != "")).select("conv", F.lit((1 << 63) - 1).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), "code")
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = inner.unionByName(tail).repartition(n, "conv").sortWithinPartitions("conv", "place")
    digests = repaired_digests(in_order, "conv")
    nothing = hashlib.sha256().hexdigest()
    every = dealt.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    out = every.join(known.drop("ways"), "conv", "left").join(audits, "conv", "left").join(digests, "conv", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repair_rows(rows: DataFrame) -> DataFrame:
    """conv_id and `RESULT` of each conversation of damaged rows (conv_id, turn, role, text, gone and a number of the row)."""
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "text", "gone", ROW, "again"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    conv: Column = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id(), "conv": conv})
    ends = dealt.groupBy("part").agg(F.min_by("conv", "place").alias("a"), F.max_by("conv", "place").alias("b"))
    edges = [(r["a"], r["b"]) for r in ends.orderBy("part").collect()]  # two ids of each partition
    split = sorted({b for (_, b), (a, _) in zip(edges, edges[1:]) if a == b})
    id_type = rows.schema["conv_id"].dataType.simpleString()
    if not split:
        return streamed(dealt, id_type)
    return streamed(dealt.where(~F.col("conv").isin(split)), id_type).unionByName(cut_up(dealt.where(F.col("conv").isin(split))))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the contract's law, then repaired: conv_id and `RESULT`."""
    return repair_rows(damaged(numbered(conversations)))
