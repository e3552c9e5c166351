import random

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import graph, summary
from tests.fixtures import pages


def parts(spark):
    p = pages(spark)
    return graph.flatten_nodes(p), graph.flatten_edges(p)


def test_totals_and_hubs(spark):
    n, e = parts(spark)
    v = graph.vertices(n, e)
    assert tuple(graph.totals(v, e).first()) == (8, 6)
    hubs = [tuple(r) for r in graph.hubs(v).collect()]
    assert hubs == [
        ("C-1001", "Contract", 5), ("Acme Aerospace", "Party", 2), ("STD-9", "Requirement", 2), ("Loop", "Goal", 2), ("PDR", "Unknown", 1),
        ("Acme International Inc.", "Party", 0), ("Lone Site", "Site", 0), ("Space Group", "Party", 0),
    ]
    assert sum(d for _, _, d in hubs) == 2 * e.count()
    assert [r["name"] for r in graph.hubs(v, 2).collect()] == ["C-1001", "Acme Aerospace"]


def test_components_and_isolated(spark):
    n, e = parts(spark)
    c = graph.components(graph.vertices(n, e), e)
    assert tuple(graph.component_stats(c).first()) == (5, 4, 4, "4x1,1x4")
    assert sorted(r["name"] for r in graph.isolated(n, e).collect()) == ["Acme International Inc.", "Lone Site", "Space Group"]
    empty = graph.component_stats(c.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, "")


def test_components_of_no_edges(spark):
    v = spark.createDataFrame([("a",), ("b",)], "name string")
    e = spark.createDataFrame([("a", "a")], "source string, target string")
    assert sorted(tuple(r) for r in graph.components(v, e).collect()) == [("a", "a"), ("b", "b")]


def union_find(names, edges):
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in names}


def test_components_against_union_find_either_way_round(spark):
    r = random.Random(5)
    for n, m in ((40, 30), (60, 59)):
        names = [f"v{i:03d}" for i in range(n)]
        pairs = [(r.choice(names), r.choice(names)) for _ in range(m)] if n == 40 else [(names[i], names[i + 1]) for i in range(n - 1)]
        want = union_find(names, pairs)
        v = spark.createDataFrame([(x,) for x in names], "name string")
        for flip in (False, True):
            e = spark.createDataFrame([(b, a) if flip else (a, b) for a, b in pairs], "source string, target string")
            assert {x: c for x, c in graph.components(v, e).collect()} == want


def test_components_of_many_parts(spark, monkeypatch):
    """Chunks of few edges, so that names meet in several levels, and chains that only doubling steps finish; ends outside of the vertices have a component too."""
    monkeypatch.setattr(graph, "BROADCAST_NAMES", 3)
    r = random.Random(9)
    names = [f"v{i:04d}" for i in range(900)]
    mixed = r.sample(names, len(names))
    for pairs in ([(r.choice(mixed[:30]), r.choice(names)) for _ in range(700)], list(zip(mixed[:300], mixed[1:301])), [(f"é{a}", b) for a, b in zip(mixed, mixed[1:]) if a > b]):
        want = union_find({*names, *(x for p in pairs for x in p)}, pairs)
        v = spark.createDataFrame([(x,) for x in names for _ in range(2)], "name string")
        e = spark.createDataFrame(pairs + [(None, "v0001"), ("v0002", "v0002")], "source string, target string").repartition(9)
        got = graph.components(v.repartition(5), e).collect()
        assert len(got) == len(want) and {x: c for x, c in got} == want


def test_chunks_keep_names_together(monkeypatch):
    monkeypatch.setattr(graph, "EDGES", 4)
    rows = [("a", "x")] * 3 + [("b", "y")] * 7 + [("c", "z")] * 2 + [("d", "z")] * 5
    for size in (1, 2, 3, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=["name", "up"]) for i in range(0, len(rows), size)]
        parts = [a.to_pylist() for a, _ in graph._chunks(iter(batches), True)]
        assert [x for p in parts for x in p] == [x for x, _ in rows] and sum(len(set(p)) for p in parts) == 4
        assert size == 50 or len(parts) > 1


def test_dense_edges_are_not_shuffled(spark, tmp_path):
    """All that components write for a dense graph is a row for a vertex and task, not for an edge."""
    pairs = [(f"O{i}", f"D{j}") for i in range(100) for j in range(50)]
    met = spark.createDataFrame(pairs, "name string, up string").coalesce(1).mapInArrow(graph._stars, "name string, up string").collect()
    assert sorted(r["name"] for r in met) == sorted({x for p in pairs for x in p}) and {r["up"] for r in met} == {"D0"}


def test_counts_differ_only_where_an_end_is_missing(spark):
    p = pages(spark)
    raw = graph.relation_counts(graph.flatten_edges(p))
    assert {r["relation"]: r["count"] for r in raw.collect()} == {"PARTY_TO": 1, "REFERENCES_STANDARD": 2, "HAS_MILESTONE": 1, "UNKNOWN": 1, "SAME_AS": 1}
    diff = graph.count_differences(raw, summary.type_counts(summary.all_edges(p), "relation"))
    assert [tuple(r) for r in diff.collect()] == [("DUE_TO", 0, 1)]


def test_summary(spark):
    p = pages(spark)
    counts = [(r["type"], r["count"]) for r in summary.type_counts(summary.all_nodes(p), "type").orderBy("place").collect()]
    assert counts == [("Party", 4), ("Contract", 1), ("Standard", 1), ("Site", 1), ("Requirement", 1), ("Goal", 1)]
    ex = {r["type"]: r["examples"] for r in summary.examples(summary.all_nodes(p), "type").collect()}
    assert ex["Party"] == ["", "Acme Aerospace", "Acme International Inc.", "Space Group"]
    edges = {r["relation"]: r["examples"] for r in summary.examples(summary.all_edges(p), "relation").collect()}
    assert edges["DUE_TO"] == ["? -> PDR"]
    assert [tuple(r) for r in summary.suggested(p).collect()] == [("Widget", ["not listed"])]


def test_first_ten_distinct_examples(spark):
    rows = spark.createDataFrame([("t", f"n{i % 15:02d}", i) for i in range(60)], "type string, name string, seq int")
    assert summary.examples(rows, "type").first()["examples"] == [f"n{i:02d}" for i in range(10)]


def test_schema_edges_take_the_last_declaration_of_their_page(spark):
    n, e = parts(spark)
    got = {(r["source_type"], r["target_type"]): r["label"] for r in graph.schema_edges(n, e).collect()}
    assert got == {("Party", "Contract"): "PARTY_TO", ("Contract", "Standard"): "REFERENCES_STANDARD", ("Unknown", "Unknown"): "UNKNOWN", ("Goal", "Goal"): "SAME_AS"}


def test_instance_sample_keeps_the_best_connected(spark):
    n, e = parts(spark)
    v = graph.vertices(n, e)
    got = {(r["source"], r["target"]) for r in graph.instance_sample(v, e, 2).collect()}
    assert got == {("Acme Aerospace", "C-1001"), ("C-1001", "Acme Aerospace")}


def test_colours_cycle(spark):
    t = spark.createDataFrame([(f"t{i:02d}",) for i in range(11)], "type string")
    got = {r["type"]: r["colour"] for r in graph.type_colours(t).collect()}
    assert got["t00"] == 0 and got["t08"] == 8 and got["t09"] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), min_size=1, max_size=8))
def test_degrees_sum_to_twice_the_edges(spark, pairs):
    n = spark.createDataFrame([("a", "T", 0)], "name string, type string, seq int")
    e = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(pairs)], "source string, target string, seq int")
    assert graph.vertices(n, e).agg(F.sum("degree")).first()[0] == 2 * len(pairs)
