"""Repairs against all cheapest edits written down as strings, and pieces against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from glossaria.llm import conversations, queries
from glossaria.llm.common import ROW
from pyspark.sql import functions as F

FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    """By the contract, row by row: (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        out += [] if way == 0 else [(conv, turn, role, text)] * (2 if way == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by a search over all edits, with the audit as it is written."""
    bad = faults(rows)
    roles = re.compile("(s?(ua)+)?")
    begins = {"", "s"}  # what may still become legal: (s?)(ua)*u?

    def may(r):
        return re.fullmatch("s?(ua)*u?", r)

    # Rows done, last initials (enough to go on), whether anything stands: cost and audit, least first.
    best = {(0, ""): (0, "", [])}
    for k in range(len(rows) + 1):
        open_ = [key for key in best if key[0] == k]
        grown = True
        while grown:  # inserted turns
            grown = False
            for key in list(open_):
                cost, audit, made = best[key]
                for role in ("user", "assistant"):
                    roles_now = key[1] + role[0]
                    if not may(roles_now):
                        continue
                    short = shorten(roles_now)
                    found = (cost + 3, audit + "I", [*made, (role, "")])
                    if (k, short) not in best or found[:2] < best[k, short][:2]:
                        best[k, short] = found
                        open_.append((k, short))
                        grown = True
        if k == len(rows):
            break
        role, text = rows[k]
        for key in set(open_):
            cost, audit, made = best[key]
            options = [(4, "D", [])]
            if bad[k] not in ("blank", "duplicate"):
                more = 3 if bad[k] == "truncated" else 0
                options += [(more, "K", [(role, text)]), (3 + more, "R", [("user", text)]), (3 + more, "R", [("assistant", text)])]
            for c, letter, kept in options:
                now = key[1] + "".join(r[:1] or "-" for r, _ in kept)
                if may(now):
                    target, found = (k + 1, shorten(now)), (cost + c, audit + letter, made + kept)
                    if target not in best or found[:2] < best[target][:2]:
                        best[target] = found
    assert begins
    return min((v for (k, r), v in best.items() if k == len(rows) and roles.fullmatch(r)), key=lambda v: v[:2])


def shorten(roles):
    """Equal for role strings that can go on alike."""
    return re.sub("^(s?)(ua)(ua)*(u?)$", r"ua\4", roles) if "ua" in roles else "su" if roles == "su" else roles


def plain(rows):
    by = defaultdict(list)
    for conv, *_ in rows:
        by[conv] = []
    for conv, *rest in damage(rows):
        by[conv].append(rest)
    return Counter(result(conv, own) for conv, own in by.items())


def result(conv, own):
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    numbers = [r[0] for r in own if r[0] is not None]
    pairs = [(r[1], r[2]) for r in own]
    bad = faults(pairs)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    cost, audit, made = cheapest(pairs)
    return (conv, gaps, *(bad.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made)))


def told(df):
    return Counter(map(tuple, df.select(*FIELDS).collect()))


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    out = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ufo", " "])
            text = rng.choice([f"Word {turn}.", "Same.", "Same.", "no end", "", " \n", None, "Well! ", "a. ", f"é {turn % 3}?"])
            out.append((conv, rng.choice([turn, turn, turn + 1, None, turn * 3]), role, text))
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, place int")


def test_rows_at_random(spark):
    rows = random_rows(3, 150, 14)
    rows += rows[:20]
    assert told(conversations.damage_and_repair(frame(spark, rows))) == plain(rows)
    assert conversations.damage_and_repair(frame(spark, [])).count() == 0


def test_every_short_conversation():
    kinds = [("system", "A."), ("user", "B."), ("assistant", "C."), ("user", "open"), ("assistant", ""), ("tool", "D.")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            cost, audit, made = cheapest(list(rows))
            seen = set()
            marks = [(r[:1], conversations.fault_of(r, t, seen)) for r, t in rows]
            found, codes = conversations.repair(marks)
            assert (found, "".join(codes), list(conversations.turns(codes, list(rows), conversations.START))) == (cost, audit, made), rows


def test_codes_are_prefix_free_and_in_order():
    for a, b in itertools.permutations(conversations.CODES, 2):
        assert not b.startswith(a)
    assert conversations.CODES == sorted(conversations.CODES)


def test_a_conversation_that_many_partitions_hold(spark):
    rng = random.Random(9)
    rows = random_rows(4, 12, 30)
    rows += [(5, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", "open", "Same.", f"m{k % 40}!", ""])) for k in range(900)]
    rows += [(None, 7, "user", "equal rows.")] * 200 + [(7, None, "assistant", "x.")] * 100
    made = conversations.damaged(frame(spark, rows).withColumn(ROW, F.monotonically_increasing_id()))
    seen = []
    cut_up = conversations.cut_up
    conversations.cut_up = lambda d: seen.append(d.select("conv", "part").distinct().count()) or cut_up(d)
    try:
        assert told(conversations.repair_rows(made)) == plain(rows)
    finally:
        conversations.cut_up = cut_up
    assert seen and seen[0] >= 4  # pieces


def test_long_texts_and_empty_conversations(spark):
    lost = next(k for k in range(100_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (1, 0, "system", "S."), (1, 1, "user", "x" * 400_000 + "."), (1, 2, "assistant", "y" * 400_000)]
    found = told(conversations.damage_and_repair(frame(spark, rows)))
    assert found == plain(rows)
    assert (lost, 0, 0, 0, 0, 0, 0, "", sha("")) in found


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op11_conversation_repair(spark, sf)) == plain(rows)
