import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import chunk_hash
from ledgerloom.operators import embedding, extraction, ingest, retrieval
from ledgerloom.sources import settings, sinks
from ledgerloom.streaming import jobs
from tests.fixtures import pages

CHUNK = "chunk_id string, contract_id string, text string, superseded boolean"


def test_settings():
    s = settings.Settings.of({"SOURCE": "photographed", "CONFIDENCE": "0.5", "SKIP_VECTORS": "1", "METADATA": ""}, threshold=0.9)
    assert (s.source, s.confidence, s.skip_vectors, s.threshold, s.metadata) == ("photographed", 0.5, True, 0.9, None)
    with pytest.raises(ValueError, match="one of pdf_text"):
        settings.Settings.of({}, source="paper")
    assert settings.required(["A"], {"A": "x"}) == {"A": "x"}
    with pytest.raises(ValueError, match="missing required variables: B, C"):
        settings.required(["A", "B", "C"], {"A": "x", "B": ""})


def test_embeddings_of_changes_only(spark):
    sent = spark.sparkContext.accumulator(0)

    def embedder(texts):
        sent.add(len(texts))
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = [("1", "c", "Old text", False), ("2", "c", "new", False), ("3", "d", "new", False), ("4", "d", "bad", False), ("5", "d", "", False), ("6", None, None, None)]
    c = spark.createDataFrame(rows, CHUNK).withColumn("chunk_hash", chunk_hash(F.col("text")))
    known = spark.createDataFrame([("old  text", [9.0, 9.0])], "t string, embedding array<double>").select(chunk_hash(F.col("t")).alias("chunk_hash"), "embedding")
    got = {r["chunk_id"]: (r["embedding"], r["embedding_dims"], r["embedding_error"]) for r in embedding.embedded_changes(c, known, embedder, pause=0).collect()}
    assert got == {"1": ([9.0, 9.0], 2, None), "2": ([3.0, 1.0], 2, None), "3": ([3.0, 1.0], 2, None), "4": (None, None, "ValueError: no"), "5": (None, None, None), "6": (None, None, None)}
    assert sent.value < 12  # the text of equal chunks goes out once, the bad one four times
    assert embedding.embedded(c.limit(0)).count() == 0
    short = {r["embedding_error"] for r in embedding.embedded(c.filter("chunk_id = '2'"), lambda t: [], tries=1).collect()}
    assert short == {"ValueError: 0 vectors for 1 texts"}


def test_datapoints_are_restricted_to_their_contract(spark, tmp_path):
    c = embedding.embedded(spark.createDataFrame([("1", "c", "a b", False), ("2", None, "x", True), ("3", "c", " ", False)], CHUNK))
    bridge = spark.createDataFrame([("1", "n2"), ("1", "n1"), ("1", "n2"), ("9", "n")], "chunk_id string, element_id string")
    got = {r["datapoint_id"]: (r["crowding_tag"], r["restricts"][0]["namespace"], r["restricts"][0]["allow"], r["element_ids"], len(r["feature_vector"])) for r in embedding.datapoints(c, bridge).collect()}
    assert got == {"1": ("c", "contract_id", ["c"], ["n1", "n2"], 64), "2": ("", "contract_id", [""], [], 64)}
    assert embedding.datapoints(c).first()["element_ids"] == []
    sinks.write_chunks(c, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert stored.count() == 3 and {r["chunk_id"] for r in retrieval.current_chunks(stored).collect()} == {"1", "3"}
    assert retrieval.current_chunks(stored, ["d"]).count() == 0
    assert retrieval.current_chunks(stored, stored.filter("chunk_id = '1'")).count() == 2


def test_insights_must_have_every_field(spark, tmp_path):
    whole = {"document_type_guess": "other", "section_heading": "", "parties": [{"name": "A", "role": ""}], "dates_or_milestones": [], "monetary_values": [], "cross_document_references": [], "tables_detected": [], "confidentiality_marking": "", "has_signature": False, "notes": ""}
    bad = {k: v for k, v in whole.items() if k != "notes"} | {"parties": [{"name": "A"}], "document_type_guess": "poem"}
    f = spark.createDataFrame([(f"/x/{n}.jpg", bytearray(json.dumps(x).encode())) for n, x in (("b", whole), ("a", bad))] + [("/x/c.jpg", bytearray(b"{no"))], "path string, content binary")
    insights = extraction.image_insights(f, lambda c: c.decode(), pause=0)
    assert [tuple(r) for r in extraction.insight_violations(insights).collect()] == [("a.jpg", ["no notes", "incomplete parties", "unknown type poem"])]
    sinks.write_insights(insights, str(tmp_path), 2)
    lines = [json.loads(line)["_source_file"] for part in sorted((tmp_path / "all").glob("part-*.json")) for line in part.read_text().splitlines()]
    assert lines == ["a.jpg", "b.jpg", "c.jpg"] and spark.read.json(str(tmp_path / "images")).count() == 3


def test_conversion_skips_what_is_done_and_fits_sizes(spark):
    f = spark.createDataFrame([(n, bytearray(b"3200x100")) for n in ("a", "b")] + [("c", bytearray(b"?"))], "path string, content binary")

    def convert(content, sizes):
        w, h = content.decode().split("x")
        return "x".join(map(str, sizes(int(w), int(h)))).encode()

    got = {r["path"]: (r["content"] and bytes(r["content"]), bool(r["error"])) for r in extraction.converted(f, f.filter("path = 'a'"), convert).collect()}
    assert got == {"b": (b"1600x50", False), "c": (None, True)}


def test_extraction_violations(spark):
    got = {(r["doc"], r["page"]): r["violations"] for r in ingest.extraction_violations(pages(spark)).collect()}
    assert got == {("D1", 2): ["no name: Party", "undeclared: Acme Aerospace", "undeclared: C-1001", "undeclared: PDR"]}
    p = pages(spark).withColumn("nodes", F.expr("array(named_struct('name', 'x', 'type', 'Poem', 'properties', map('Bot Status', '1')), named_struct('name', 'y', 'type', 'Widget', 'properties', cast(null as map<string,string>)))")).withColumn("edges", F.slice("edges", 1, 0))
    assert {tuple(r["violations"]) for r in ingest.extraction_violations(p).collect()} == {("bookkeeping: Bot Status", "type not suggested: Poem")}
    assert ingest.extraction_violations(p.withColumns({"nodes": F.lit(None).cast(p.schema["nodes"].dataType), "edges": F.lit(None).cast(p.schema["edges"].dataType)})).count() == 0


def test_backfill_is_taken_up_where_it_stopped(spark, tmp_path):
    rows = [(f"k{i}", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=12 * i)) for i in range(8)] + [("k0", pd.Timestamp("2024-01-01")), ("k9", None)]
    h = spark.createDataFrame(pd.DataFrame(rows, columns=["event_key", "ts"]).astype({"ts": "datetime64[ns]"}))
    folder, at = str(tmp_path / "b"), F.lit("2024-01-04").cast("timestamp")
    assert jobs.backfill(h.filter("ts < '2024-01-02'"), folder, at) == ["20240101T000000"]
    assert jobs.backfill(h, folder, at) == ["20240102T000000", "20240103T000000", "none"]
    assert jobs.backfill(h, folder, at) == []
    got = spark.read.parquet(folder).drop("page")
    assert sorted(r["event_key"] for r in got.collect()) == ["k0", "k1", "k2", "k3", "k4", "k5", "k9"]
    late = jobs.reconciled(h.select("event_key"), got, ["event_key"])
    assert {(r["event_key"], r["reason"]) for r in late.collect()} == {("k6", "too late"), ("k7", "too late")}
