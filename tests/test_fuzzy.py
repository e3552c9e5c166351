"""Fuzzy pairs, containment and the resolver against all pairs and against the loop over names in order."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest

from ledgerloom.functions.names import score
from ledgerloom.operators import fuzzy, graph, resolve


def names(seed, n):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        if r.random() < 0.25:
            s = "".join(r.choice("abc ") for _ in range(r.randrange(1, 7)))
        else:
            s = " ".join("".join(r.choice("abcdefghijé日") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(1, 4)))
        out.add(s.strip() or "a")
        s = list(r.choice(sorted(out)))
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(s) + 1)
            s[at : at + r.randrange(2)] = r.choice(["", "x", "de"])
        out.add("".join(s).strip() or "b")
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "type string, norm string, side int").repartition(3)


@pytest.mark.parametrize("group", [4096, 8])
def test_no_pair_is_lost(spark, monkeypatch, group):
    some = names(1, 260)
    few = group < 100
    d = frame(spark, [("T", x, 3) for x in some] + [("U", "abc", 3), ("U", "abd", 3), (None, "abc", 3), ("U", "", 3)])
    monkeypatch.setattr(fuzzy, "GROUP", group)
    real = fuzzy._postings

    def postings(threshold, shared):
        inner = real(threshold, shared)

        def run(batches):
            fuzzy.GROUP = group  # in the worker
            yield from inner(batches)

        return run

    monkeypatch.setattr(fuzzy, "_postings", postings)
    for t in (0.78,) if few else (0.3, 0.66, 0.78, 0.85, 0.95):
        want = {(a, b) for a, b in combinations(some, 2) if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= t}
        got = [tuple(r) for r in fuzzy.alike(d, t).collect()]
        assert len(got) == len(set(got)) and want <= {g[1:] for g in got if g[0] == "T"} and all(g[1] < g[2] for g in got)
        assert {g[0] for g in got} <= {"T", "U"}
        if t >= 0.78:
            assert len(got) < 4 * len(want) + 50


def test_sides(spark):
    some = names(2, 120)
    side = {x: 1 + i % 3 for i, x in enumerate(some)}
    got = {tuple(r)[1:] for r in fuzzy.alike(frame(spark, [("T", x, side[x]) for x in some]), 0.7).collect()}
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    meets = lambda a, b: (side[a] & 1 and side[b] & 2) or (side[a] & 2 and side[b] & 1)
    assert {(a, b) for a, b in combinations(some, 2) if meets(a, b) and ratio(a, b) >= 0.7} <= got
    assert all(meets(a, b) for a, b in got)


def test_bounds_hold_for_every_pair():
    some = names(3, 150)
    for a, b in combinations(some, 2):
        m = sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())
        ratio, total = 2 * m / (len(a) + len(b)), len(a) + len(b)
        for t in (0.5, 0.78, 0.85):
            if ratio >= t:
                assert m >= fuzzy.matched(total, t)
                pairs = fuzzy._Names(["T", "T"], [a, b]).tokens(2)
                shared = len(np.intersect1d(pairs[1][pairs[0] == 0], pairs[1][pairs[0] == 1]))
                assert shared >= fuzzy.shared_pairs(total, t)


def test_contained(spark):
    some = names(4, 200) + ["x" * 400 + "abcabcabc", "abcabcabc", "日", "日é"]
    got = [tuple(r) for r in fuzzy.contained(frame(spark, [(k, x, 3) for k in "TU" for x in sorted(set(some))])).collect()]
    want = {(k, a, b) for k in "TU" for a in set(some) for b in set(some) if a != b and a in b}
    assert set(got) == want and len(got) == len(want)


def test_odd_names(spark):
    kinds = "type string, norm string, side int"
    assert fuzzy.alike(spark.createDataFrame([], kinds), 0.8).collect() == []
    assert fuzzy.contained(spark.createDataFrame([], kinds)).collect() == []
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    got = fuzzy.alike(spark.createDataFrame([("T", long, 3), ("T", long[:-1] + "z", 3), ("T", "a", 3), ("T", "a b", 3)], kinds), 0.8).collect()
    assert {tuple(x) for x in got} >= {("T", *sorted((long, long[:-1] + "z")))}


def in_order(rows, threshold, compat):
    """The loop: each type's names in order, against all that are registered."""
    norm = {}
    out = {}
    for kind in {r[0] for r in rows}:
        registry = {}
        for name, text in rows_in_order(rows, kind):
            norm[name] = text
            if not text and not compat:
                out[kind, name] = name
                continue
            if text not in registry:
                hit = next((c for n, c in registry.items() if score(text, n, 0 if compat else 1) >= threshold), None)
                registry[text] = name if hit is None else hit
            out[kind, name] = registry[text]
    return out


def rows_in_order(rows, kind):
    seen = {}
    for k, name, seq, text in rows:
        if k == kind:
            seen[name] = min(seen.get(name, (seq, text)), (seq, text))
    return [(name, text) for name, (_, text) in sorted(seen.items(), key=lambda x: (x[1][0], x[0]))]


@pytest.mark.parametrize("compat", [False, True])
def test_resolver_equals_the_loop(spark, compat):
    from pyspark.sql import functions as F

    from ledgerloom.functions.names import normalize_name

    for seed in range(3):
        r = random.Random(seed)
        some = names(seed + 10, 120)
        rows = [(r.choice(["T", "T", "T", "U", None]), r.choice(some).title() + r.choice(["", "", " Inc.", " Ltd"]), r.randrange(400)) for _ in range(260)]
        rows += [(k, "Inc.", r.randrange(400)) for k in "TU"] + [("T", "LLC", 3)]
        df = spark.createDataFrame(rows, "type string, name string, seq int")
        text = {x["name"]: x["n"] for x in df.select("name", normalize_name(F.col("name"), True).alias("n")).collect()}
        got = {(x["type"], x["name"]): x["canonical"] for x in resolve.resolve_in_order(df, compat=compat).collect()}
        assert got == in_order([(*x, text[x[1]]) for x in rows], 0.85, compat)
        assert len(set(got.values())) < len(got)


def test_chains_of_alike_names(spark):
    chain = ["abcdefghij"]
    for i in range(40):  # each is alike to the one before only
        chain.append(chain[-1][2:] + "klmnopqrstuvwxyz"[i % 16] + "0123456789"[i % 10])
    rows = [("T", x, i) for i, x in enumerate(chain)]
    got = {x["name"]: x["canonical"] for x in resolve.resolve_in_order(spark.createDataFrame(rows, "type string, name string, seq int"), threshold=0.8).collect()}
    assert got == {n: c for (_, n), c in in_order([(*x, x[1]) for x in rows], 0.8, False).items()} and set(got.values()) == {chain[0]}


def test_roots(spark):
    steps = [(i, i - 1) for i in range(1, 300)] + [(1000, 7), (1001, 1002)]
    got = {r["id"]: r["up"] for r in graph.roots(spark.createDataFrame(steps, "id int, up int")).collect()}
    assert got == {i: 0 for i in range(1, 300)} | {1000: 0, 1001: 1002}
    assert graph.roots(spark.createDataFrame([], "id int, up int")).collect() == []
