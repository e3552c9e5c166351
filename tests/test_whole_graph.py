"""Queries over the whole graph against brute force on small tables."""

import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from ledgerloom.operators import graph, references
from ledgerloom.plans import catalog
from tests.test_graph import union_find


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(directory, lines, orders) of three separate groups: every line has less than 49 pieces, so the heavy graph has no edge."""
    r, d = random.Random(7), str(tmp_path_factory.mktemp("small"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    orders = [(i, i % 4 + 1, "FO"[i % 2]) for i in range(1, 25)]
    lines = [(o, k, 10 * (c % 2) + r.randrange(1, 6), c % 2 + 1, 5.0, 0.04) for o, c, _ in orders for k in (1, 2) if o != 24]
    put("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string")
    put("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double")
    put("customer", [(i, i % 2) for i in range(1, 6)], "c_custkey long, c_nationkey long")
    put("supplier", [(i,) for i in range(1, 4)], "s_suppkey long")
    put("nation", [(0, "A", 0), (1, "B", 1), (2, "C", 1)], "n_nationkey long, n_name string, n_regionkey long")
    put("region", [(0, "X"), (1, "Y"), (2, "Z")], "r_regionkey long, r_name string")
    return d, lines, orders


def edges_of(lines, orders):
    yield from ((f"P{c}", f"O{o}") for o, c, _ in orders)
    for o, _, p, s, *_ in lines:
        yield from ((f"O{o}", f"D{p}"), (f"O{o}", f"S{s}"))
    yield from ((f"P{i}", "AB"[i % 2]) for i in range(1, 6))
    yield from (("A", "R X"), ("B", "R Y"), ("C", "R Y"))


def test_components_of_the_whole_graph(spark, small):
    d, lines, orders = small
    edges = list(edges_of(lines, orders))
    names = {x for e in edges for x in e} | {f"S{i}" for i in (1, 2, 3)} | {"R Z"}
    want = union_find(names, edges)
    assert {r["name"]: r["component"] for r in catalog.QUERIES["connected_components_whole"](spark, d).collect()} == want
    sizes = Counter(want.values()).values()
    got = catalog.QUERIES["component_stats_whole"](spark, d).first()
    assert tuple(got)[:3] == (len(sizes), max(sizes), sum(x == 1 for x in sizes)) and len(sizes) == 4


def test_pairs_of_all_lines(spark, small):
    d, lines, _ = small
    links = {(o, p) for o, _, p, *_ in lines}
    want = Counter((a, b) for (a, p), (b, q) in combinations(sorted(links), 2) if p == q)
    assert want and {(r["left"], r["right"]): r["shared"] for r in catalog.QUERIES["shared_reference_pairs_whole"](spark, d).collect()} == want


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_pairs_are_rows_of_greater_contracts(spark, monkeypatch, kind):
    """Keys of any size and sign, frequent documents in groups, repeated and null links; what is shuffled is a row for a contract, not for a pair."""
    monkeypatch.setattr(references, "PAIRS", 50)
    r = random.Random(3)
    spread = [0, 1, -1, 255, 256, 65535, 65536, -65537, 2**24 - 1, 2**24, 2**31 - 1, -(2**31)] + ([2**62, -(2**62), 2**63 - 1, -(2**63)] if kind == "long" else [])
    keys = [*spread, *(r.randrange(-(2**31), 2**31) for _ in range(20))]
    keys = [str(k) for k in keys] if kind == "string" else keys
    links = [(k, "hot") for k in keys] + [(r.choice(keys), f"d{r.randrange(9)}") for _ in range(60)] + [(keys[0], None), (None, "hot")]
    by = {d: sorted({c for c, x in links if x == d and c is not None}) for d in {d for _, d in links if d}}
    want = Counter(p for cs in by.values() for p in combinations(cs, 2))
    df = spark.createDataFrame(links * 2, f"c {kind}, d string").repartition(3)
    for most in (4, 7, 1024):
        found = references.sharing_pairs(df, "c", "d", most)
        assert found.schema["left"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
        rows = found.collect()
        assert len(rows) == len(want) and {(x["left"], x["right"]): x["shared"] for x in rows} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(left#\d+L?, right", plan) and "Exchange hashpartitioning(left" in plan


def test_sample_of_all_relations(spark, small):
    """Less than 120 names: the sample is the whole graph."""
    d, lines, orders = small
    got = [tuple(r) for r in catalog.QUERIES["instance_sample_whole"](spark, d).collect()]
    edges = {(s, t): label for kind, s, t, label in got if kind == "edge"}
    assert set(edges) == set(edges_of(lines, orders)) and set(edges.values()) == {"PARTY_TO", "HAS_DELIVERABLE", "FULFILLED_BY", "LOCATED_IN"}
    assert {s for kind, s, *_ in got if kind == "node"} == {x for e in edges for x in e} | {"S3", "R Z"} and len(got) == len(edges) + len({x for e in edges for x in e}) + 2


def test_sample_counts_a_pair_once(spark):
    n = spark.createDataFrame([("a", "T", 0), ("h", "U", 1)], "name string, type string, seq int")
    pairs = [("a", "b")] * 5 + [("h", "c"), ("d", "h"), ("h", "e"), ("h", "c")]
    e = spark.createDataFrame([(s, f"r{i}", t, i + 2) for i, (s, t) in enumerate(pairs)], "source string, relation string, target string, seq int")
    assert [tuple(r) for r in graph.sampled_graph(n, e, 1).collect()] == [("node", "h", None, "U")]
    got = {tuple(r) for r in graph.sampled_graph(n, e, 4).collect()}
    assert got == {("node", "h", None, "U"), ("node", "a", None, "T"), ("node", "b", None, "Unknown"), ("node", "c", None, "Unknown"), ("edge", "a", "b", "r4"), ("edge", "h", "c", "r8")}


def test_stats_of_the_whole_graph_write_little(spark, small, monkeypatch):
    """No uncompressed checkpoint is made where contraction leaves nothing for doubling steps."""
    monkeypatch.setattr(graph, "keep", lambda df: pytest.fail("checkpoint"))
    assert catalog.QUERIES["component_stats_whole"](spark, small[0]).first()["total_components"] == 4


def test_stats_of_the_whole_graph_store_no_names(spark, small, monkeypatch):
    """Names are counted where they meet: what is stored are ups and edges between centres."""
    held, put = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: held.append(put(df)) or held[-1])
    d, lines, orders = small
    assert catalog.QUERIES["component_stats_whole"](spark, d).first()["largest_component_size"] > 5
    kept = {r["name"] for df in held for r in df.collect()}
    names = {f"O{o}" for o, *_ in orders} | {f"D{x[2]}" for x in lines} | {f"P{i}" for i in range(1, 6)} | {f"S{i}" for i in range(1, 4)}
    assert len(kept & names) < len(names)


def test_sizes_of_components_of_many_parts(spark, monkeypatch):
    for name, value in (("BROADCAST_NAMES", 3), ("EDGES", 8), ("BLOCKS", 2)):
        monkeypatch.setattr(graph, name, value)
    r = random.Random(11)
    names = [f"v{i:03d}" for i in range(300)] + ["", "ü", "üü", "n\0"]
    mixed = r.sample(names, len(names))
    for pairs in ([(r.choice(mixed[:20]), r.choice(names)) for _ in range(150)], list(zip(mixed[:120], mixed[1:121])), []):
        want = Counter(union_find(names, pairs).values())
        v = spark.createDataFrame([(x,) for x in names for _ in range(2)], "name string").repartition(5)
        e = spark.createDataFrame([*pairs, (None, "v001")], "source string, target string").repartition(7)
        assert {x["component"]: x["size"] for x in graph.sizes_of_components(v, e).collect()} == want


def test_packed_stars_are_small_and_whole(spark):
    """A block keeps stars as they were, names of equal beginning share it, and names in order take few bytes."""
    names = pa.array([f"O{i}" for i in range(100_000, 150_000)] + ["x"])
    ups = pa.array(["O100000"] * 50_000 + ["x"])
    blocks = [x for b in graph._packed_stars(64)(iter([pa.RecordBatch.from_arrays([names, ups], names=["name", "up"])])) for x in b.column("stars").to_pylist()]
    got = [graph._unpacked(x, pa.string()) for x in blocks]
    assert sorted((a, b, c) for x in got for a, b, c in zip(*(y.to_pylist() for y in x))) == sorted((a, b, a == "x") for a, b in zip(names.to_pylist(), ups.to_pylist()))
    assert sum(map(len, blocks)) < 4 * len(names)
