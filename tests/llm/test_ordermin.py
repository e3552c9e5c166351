"""Order MinHash against a plain version, and neighbours over partitions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import ordermin as o
from ledgerloom.llm.common import mixed


def text(rand, n, alphabet="abcdef éß日𝔘"):
    return "".join(rand.choice(alphabet) for _ in range(n))


def plain_signature(s, k=o.K, picked=o.PICKED, draws=o.DRAWS):
    """The same selection, one k-mer at a time: number repeats, take the least of each draw, put them into the order of the text."""
    grams = [s[i : i + k] for i in range(max(len(s) - k + 1, min(len(s), 1)))]
    named = {g: int(o.kmers(np.array([ord(c) for c in g], np.uint32), k, 0, 1)[0]) for g in set(grams)}
    seen, marks = Counter(), []
    for g in grams:
        marks.append(int(mixed(np.array([named[g]], np.uint64) + np.array([seen[g]], np.uint64) * o._STEP)[0]) >> 32)
        seen[g] += 1
    out = []
    for a in o._factors(draws)[:, 0].tolist():
        best = sorted(range(len(grams)), key=lambda i: (marks[i] * a % (1 << 32), i))[:picked]
        h = np.zeros(1, np.uint64)
        for i in sorted(best):
            h = mixed(h * o._STEP + np.array([named[grams[i]]], np.uint64))
        out.append(int(h[0]) >> 32)
    return out


def test_signature_one_kmer_at_a_time():
    rand = random.Random(1)
    texts = ["", "a", "ab", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "ab" * 40, *(text(rand, rand.randrange(300)) for _ in range(20)), text(rand, 90) * 3]
    for s in texts:
        assert o.signature(s).tolist() == (plain_signature(s) if s else [0] * o.DRAWS), s
        assert o.signature(s, k=3, picked=3, draws=9).tolist() == (plain_signature(s, 3, 3, 9) if s else [0] * 9), s


def test_parts_of_long_texts_change_nothing():
    rand = random.Random(2)
    for s in (text(rand, 20_000), "ab" * 9000, "a" * 5000, text(rand, 3000, "ab") * 4):
        assert (o.signature(s) == o.signature(s, limit=700)).all()


def test_likeness_follows_edits_and_order():
    rand = random.Random(3)
    base = text(rand, 4000)
    near = base[:2000] + "x" + base[2001:]
    swapped = base[2000:] + base[:2000]
    half = base[:2000] + text(rand, 2000)
    sign = o.signature
    one, order, some, none = (o.likeness(sign(base), sign(x)) for x in (near, swapped, half, text(rand, 4000)))
    assert one > 0.9 and 0.3 < order < 0.7 and 0.02 < some < 0.3 and none < 0.03
    assert one > order > some > none  # a set of k-mers would not tell the swapped text


def expected(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    out = {}
    for (key, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        a, b = a or "", b or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        s, e, n = o.signature(a), o.signature(edited), o.signature(b)
        out[key] = (len(a), hashlib.sha256(edited.encode()).hexdigest(), o.as_text(s), o.as_text(e), o.likeness(s, e), o.likeness(s, n))
    return out


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_neighbours(spark, parts):
    rand = random.Random(parts)
    rows = [(None if i == 7 else i * 3, None if i % 9 == 0 else "" if i % 11 == 0 else text(rand, rand.choice([3, 50, 400]))) for i in range(30)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "k long, t string, text string, edge int, id int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["id"]: tuple(r[c] for c in o.RESULT) for r in o.fingerprints(df, "k", "t").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expected(rows)


def test_odd_tables(spark):
    kinds = "k string, t string"
    assert o.fingerprints(spark.createDataFrame([], kinds), "k", "t").collect() == []
    one = o.fingerprints(spark.createDataFrame([("a", "alone here")], kinds), "k", "t").collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 10
    same = o.fingerprints(spark.createDataFrame([("a", "again")] * 50 + [("a", None)], kinds), "k", "t").collect()
    assert len(same) == 51 and len({r["fingerprint"] for r in same}) == 2
    nothing = [r for r in same if r["n_chars"] == 0]
    assert nothing[0]["fingerprint"] == "0" * 8 * o.DRAWS and nothing[0]["near_edited"] == 1.0
    long = o.fingerprints(spark.createDataFrame([("a", "long text " * 90_000), ("b", "short")], kinds), "k", "t").collect()
    assert {r["n_chars"] for r in long} == {900_000, 5}
