"""Conversation repair against a search over all edits, and conversations that spread over partitions."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import repair as r

SPACES = " \t\n\x0b\x0c\r"


def by_search(rows):
    """The cheapest edits and turns by a search in the order of (cost, initials) over (row, roles so far)."""
    goal = {"": 0, "s": 1, "u": 2, "a": 3}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, turns = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, turns
        ok = lambda x: (last, x) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
        assert last in goal
        for name in ("user", "assistant"):
            if ok(name[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, name[0], (*turns, name + ":")))
        if i < len(rows):
            role, text, gone, short = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, turns))
            if not gone:
                if role[:1] and ok(role[:1]):
                    heapq.heappush(heap, (cost + short, audit + "K", i + 1, role[:1], (*turns, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if ok(name[0]):
                        heapq.heappush(heap, (cost + 2 + short, audit + "R", i + 1, name[0], (*turns, f"{name}:{text}")))
    raise AssertionError


def plain(rows):
    """The result for (turn, role, text) of one conversation."""
    rows = [(t, " " if a is None else a, " " if x is None else x) for t, a, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{x[1]}:{x[2]}".encode()).hexdigest()))
    counts, seen, told = [0, 0, 0], set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        told.append((role, text, kind in (0, 1), int(kind == 2)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, left = by_search(told)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def results(df):
    return {x["id"]: tuple(x[c] for c in r.RESULT) for x in df.collect()}


def conversations(seed, n, longest, roles=("system", "user", "user", "assistant", "assistant", "tool", "", None)):
    rand = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "a. b", "Ünï.\n", "x\x0b"]
    out = []
    for c in range(n):
        for t in range(rand.randrange(longest)):
            turn = None if rand.random() < 0.1 else t + rand.randrange(2)
            out.append((None if c == 0 else c, turn, rand.choice(roles), rand.choice(texts)))
    return out


def test_all_edits(spark):
    rows = conversations(1, 150, 9)
    got = results(r.repair(spark.createDataFrame(rows, "c int, turn long, role string, text string"), "c", "turn", "role", "text"))
    want = {c: plain([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_conversations_over_several_partitions(spark, parts):
    rows = conversations(2, 3, 400, ("system", "user", "assistant", "user", "assistant")) + conversations(3, 30, 6) + [(9999, 5, "user", "the same.")] * 60
    rows += [(9998, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(500)]
    df = spark.createDataFrame(rows, "c int, turn long, role string, text string").repartition(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = results(r.repair(df, "c", "turn", "role", "text"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {c: plain([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    assert got[9998] == (0, 0, 0, 0, 0, 0, "K" * 500, hashlib.sha256("\n".join(f"{'user' if t % 2 == 0 else 'assistant'}:turn {t}." for t in range(500)).encode()).hexdigest())


def test_damage(spark):
    rows = [(c, t, ("user", "assistant", None)[t % 3], None if t == 4 else f"Turn {t}! of {c}?") for c in range(60) for t in range(6)] + [(None, None, "user", "Hm.")]
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text
        want += [(c, t, "user" if code == 4 else role, text, code != 0)] * (2 if code == 3 else 1)
    df = r.damaged(spark.createDataFrame(rows, "c int, t int, role string, text string"), "c", "t", "role", "text")
    assert sorted(map(repr, (tuple(x) for x in df.collect()))) == sorted(map(repr, want))
    assert {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows} >= {0, 1, 2, 3, 4}
    got = results(r.repair(df, "id", "turn", "role", "text", F.col("present")))
    assert got == {c: plain([x[1:4] for x in want if x[0] == c and x[4]]) for c in {x[0] for x in rows}}


def test_odd_tables(spark):
    kinds = "id int, turn string, role string, text string, gaps int, part int, present boolean"
    empty = spark.createDataFrame([], kinds)
    assert r.repair(empty, "id", "turn", "role", "text").collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(1, "x", "user", "Long. " * 300_000, 7, 8, True), (1, "2", "assistant", "Yes.", 7, 8, True), (2, "1", "user", "gone.", 7, 8, False), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, kinds)
    got = results(r.repair(df, "id", "turn", "role", "text", F.col("present")))
    assert got[2] == got[3] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[1] == plain([(None, "user", "Long. " * 300_000), (2, "assistant", "Yes.")])
    assert got[1][6] == "KK"


def test_sums_of_stretches():
    rand = random.Random(4)
    for _ in range(200):
        turns = sorted((rand.choice([None, 1, 2, 3, 5]) for _ in range(rand.randrange(8))), key=lambda t: (t is not None, t or 0))
        rows = [(t, rand.choice("suax"), *rand.choice([(True, False, False), (False, True, False), (False, False, True), (False, False, False)])) for t in turns]
        at = sorted(rand.choices(range(len(rows) + 1), k=2))
        assert r._joined(map(r._sums, (rows[: at[0]], rows[at[0] : at[1]], rows[at[1] :]))) == r._sums(rows)
