from random import Random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import document_key
from ledgerloom.operators import graph, ingest, resolve, revisions
from ledgerloom.sources import files, sinks
from tests.fixtures import pages


def run(spark, compat):
    p = pages(spark)
    names = graph.flatten_nodes(p).select("type", "name", "seq")
    return ingest.ingest(p, resolve.resolve_in_order(names, compat=compat))


def test_ingest_of_the_fixture(spark):
    nodes, edges, bridge = run(spark, False)
    assert nodes.count() == 7 and run(spark, True)[0].count() == 6
    got = {(r["src_name"], r["rel_type"], r["tgt_name"], r["confidence"]) for r in edges.collect()}
    assert got == {("Acme Aerospace", "PARTY_TO", "C-1001", 0.85), ("C-1001", "REFERENCES_STANDARD", "STD-9", 0.9), ("C-1001", "POSSIBLE_REFERENCES_STANDARD", "STD-9", 0.6), ("Loop", "SAME_AS", "Loop", 0.75)}
    assert bridge.select("chunk_id").distinct().count() == 3


def test_stats_count_dropped_edges_too(spark):
    p = pages(spark)
    n = graph.flatten_nodes(p)
    e = p.select("doc", "page", F.explode("edges").alias("e")).select("e.*").filter("source <> '' and target <> ''")
    got = {r["key"]: r["count"] for r in ingest.stats(n, e).collect()}
    assert got == {"node:Party": 3, "node:Contract": 1, "node:Standard": 1, "node:Site": 1, "node:Requirement": 1, "node:Goal": 1, "edge:PARTY_TO": 1, "edge:REFERENCES_STANDARD": 2, "edge:HAS_MILESTONE": 1, "edge:RELATED_TO": 1, "edge:SAME_AS": 1}


def test_merging_is_last_non_empty_and_idempotent(spark):
    rows = spark.createDataFrame([("T", "x", {"a": "1", "b": "2"}, 1), ("T", "x", {"b": "3", "c": ""}, 2), ("T", "y", {}, 3)], "label string, canonical_name string, props map<string,string>, seq int")
    got = {r["canonical_name"]: r["props"] for r in ingest.merged_nodes(rows).collect()}
    assert got == {"x": {"a": "1", "b": "3"}, "y": {}}
    again = {r["canonical_name"]: r["props"] for r in ingest.merged_nodes(rows.unionByName(rows)).collect()}
    assert again == got


def looked_up(nodes, end):
    """A plain twin of the lookup in a page: (first type, last type, last canonical name) of an end."""
    same = [n for n in nodes if n[0] == end]
    return (same[0][1] or "Unknown", same[-1][1] or "Unknown", same[-1][2] or end) if same else ("Unknown", "Unknown", end)


def test_ends_are_looked_up_in_their_own_page(spark):
    random = Random(7)
    name, kind = lambda: random.choice(["a", "b", "c", "", None]), lambda: random.choice(["T", "U", None])
    rows = [("D", k, [(name(), kind(), name() or "z") for _ in range(random.randrange(6))], [(name(), "R", name(), {}) for _ in range(random.randrange(5))]) for k in range(60)]
    rows += [("D", 60, None, None), ("D", 61, None, [("a", None, "b", None)]), ("D", 62, [], [])]
    p = spark.createDataFrame(rows, "doc string, page int, nodes array<struct<name:string,type:string,canonical:string>>, edges array<struct<source:string,relation:string,target:string,properties:map<string,string>>>")
    got = {(r["page"], r["pos"]): (r["src_label"], r["src_last"], r["src_name"], r["tgt_label"], r["tgt_last"], r["tgt_name"]) for r in ingest.page_edges(p).collect()}
    assert got == {(page, i): looked_up(n or [], e[0]) + looked_up(n or [], e[2]) for _, page, n, edges in rows for i, e in enumerate(edges or []) if e[0] and e[2]}
    n, e = graph.flatten_nodes(p.withColumn("nodes", F.transform("nodes", lambda x: x.withField("properties", F.create_map())))), graph.flatten_edges(p)
    assert sorted(graph.schema_edges(n, e).collect()) == sorted(graph.page_schema_edges(ingest.page_edges(p)).collect())


def test_a_batch_is_merged_into_the_stored_snapshot(spark):
    node = "label string, canonical_name string, props map<string,string>, element_id string"
    old = spark.createDataFrame([("T", "x", {"a": "1", "b": "2"}, "i"), ("T", "y", None, "j")], node)
    new = spark.createDataFrame([("T", "x", {"b": "3", "c": "", "d": "4"}, "i"), ("T", "z", {}, "k")], node)
    want = {"x": ({"a": "1", "b": "3", "d": "4"}, "i"), "y": ({}, "j"), "z": ({}, "k")}
    merged = ingest.upserted_nodes(old, new)
    assert {r["canonical_name"]: (r["props"], r["element_id"]) for r in merged.collect()} == want
    assert {r["canonical_name"]: (r["props"], r["element_id"]) for r in ingest.upserted_nodes(merged, new).collect()} == want
    assert ingest.upserted_nodes(old.limit(0), old.limit(0)).count() == 0
    edge = "src_label string, src_name string, rel_type string, tgt_label string, tgt_name string, props map<string,string>, confidence double"
    e = lambda name, props, c: ("T", name, "R", "T", "x", props, c)
    got = ingest.upserted_edges(spark.createDataFrame([e("x", {"k": "1"}, 0.9), e("y", {}, 0.8)], edge), spark.createDataFrame([e("x", {"l": "2"}, 0.7), e("z", {}, 0.6)], edge))
    assert {r["src_name"]: (r["props"], r["confidence"]) for r in got.collect()} == {"x": ({"k": "1", "l": "2"}, 0.7), "y": ({}, 0.8), "z": ({}, 0.6)}


def test_ingest_into_a_published_snapshot(spark, tmp_path):
    folder = str(tmp_path)
    p = pages(spark)
    names = resolve.resolve_in_order(graph.flatten_nodes(p).select("type", "name", "seq"))
    assert sinks.published(spark, folder) is None
    for k, doc in enumerate(("D1", "D2", "D2")):  # the last run repeats a batch, as after a retry
        sinks.publish(*ingest.ingest(p.filter(F.col("doc") == doc), names, stored=sinks.published(spark, folder)), folder, f"run{k}")
    got, want = sinks.published(spark, folder), ingest.ingest(p, names)
    for a, b in zip(got, want):
        rows = lambda df: sorted(repr(sorted(r.asDict().items())) for r in df.withColumn("props", F.array_sort(F.map_entries("props"))).collect()) if "props" in df.columns else sorted(df.collect())
        assert rows(a) == rows(b)
    with pytest.raises(ValueError, match="is current"):
        sinks.publish(*got, folder, "run2")


def test_dropped_edges_tell_the_missing_end(spark):
    nodes = spark.createDataFrame([("T", "a")], "label string, canonical_name string")
    edges = spark.createDataFrame([("T", "a", "T", "b"), ("T", "c", "T", "a"), ("T", "c", "T", "b")], "src_label string, src_name string, tgt_label string, tgt_name string")
    assert sorted(r["missing"] for r in ingest.dropped_edges(edges, nodes).collect()) == ["both", "source", "target"]


def test_overlay_wins_unless_empty(spark):
    c = spark.createDataFrame([("1", {"sales_contract_status": "Draft", "x": "y"}), ("2", {"sales_contract_status": "Draft"}), ("3", {})], "contract_id string, props map<string,string>")
    m = spark.createDataFrame([("1", "Active"), ("2", "")], ["contract_id", "Sales Contract Status"])
    got = {r["contract_id"]: r["props"] for r in ingest.overlaid(c, m).collect()}
    assert got == {"1": {"x": "y", "sales_contract_status": "Active"}, "2": {"sales_contract_status": "Draft"}, "3": {}}


def test_confidence(spark):
    df = spark.createDataFrame([("0.75", "photographed", {"a": "b"}), ("0.7", "photographed", {}), ("bad", "pdf_text", {"a": "b"}), (None, "pdf_text", None)], "c string, s string, p map<string,string>")
    c = ingest.confidence_of(F.col("c"))
    got = [tuple(r) for r in df.select(ingest.gated(F.lit("R"), c), F.round(ingest.node_confidence(F.col("s"), F.col("p")), 3)).collect()]
    assert got == [("R", 0.75), ("POSSIBLE_R", 0.7), ("R", 0.95), ("R", 0.9)]


def test_metadata_ids(spark):
    assert files.id_column(["Name", "General Contract Confidential", "Sales Contract ID"]) == "General Contract Confidential"
    raw = spark.createDataFrame([("1", None), ("1", "b")], ["Sales Contract ID", "Status"])
    assert [tuple(r) for r in files.with_contract_id(raw).collect()] == [("1", "1", "")]


def test_lineage_skips_bookkeeping(spark):
    m = spark.createDataFrame([("1", "2", "file")], ["k", "Previous Document ID", "Attached File"])
    assert [tuple(r) for r in ingest.lineage_edges(m, "k", {"Previous Document ID": "SUPERSEDES", "Attached File": "SAME_AS"}).collect()] == [("1", "SUPERSEDES", "2")]


def test_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "i int, s string")
    assert {(r["i"], r["reason"]) for r in ingest.key_violations(rows, ["i", "s"]).collect()} == {(1, "duplicate"), (2, "null")}
    assert {(r["i"], r["reason"]) for r in ingest.key_violations(rows, ["i", "s"], required=False).collect()} == {(1, "duplicate")}


def test_revisions_of_the_fixture(spark):
    c = spark.createDataFrame([("C", 1, h) for h in ("h1", "h2", "h3")] + [("C", 2, h) for h in ("h1", "h4", "h3", "h5")], "contract_id string, revision int, chunk_hash string")
    a = {r["revision"]: (r["reused"], r["added"], r["removed"]) for r in revisions.audit(revisions.chunk_changes(c)).collect()}
    assert a[2] == (2, 2, 1) and a[1] == (0, 3, 0)
    same = c.filter("revision = 1").unionByName(c.filter("revision = 1").withColumn("revision", F.lit(2)))
    assert {r["revision"]: r["changed"] for r in revisions.audit(revisions.chunk_changes(same)).collect()}[2] == 0
    v = c.select("contract_id", "revision").distinct()
    assert {(r["revision"], r["superseded"]) for r in revisions.superseded(v).collect()} == {(1, True), (2, False)}
    assert {(r["revision"], r["supersedes"]) for r in revisions.chain(v).collect()} == {(1, None), (2, 1)}


def test_document_keys_and_terms(spark):
    df = spark.createDataFrame([("AD-1 Rev.B",), ("ad 1 revb",)], "n string").select(document_key(F.col("n")).alias("k")).distinct()
    assert df.count() == 1
    schema = "contract_id string, revision int, chunk_id string, milestones array<struct<name:string,date_offset:string,payment_terms:array<struct<percent:double,cumulative_percent:double,amount_usd:double>>>>"
    p = spark.createDataFrame([("C", 1, "k", [("PDR", "event+9", [(10.0, 10.0, 5.0), (20.0, 30.0, 7.0)]), ("CDR", "event+10", [])])], schema)
    t = revisions.unwound(p)
    assert t.count() == 2 and revisions.last_terms(t).first()["amount_usd"] == 7.0
