"""A run from files by its settings, the plain sinks, and the guard of vector tasks."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, ingest, resolve, retrieval
from ledgerloom.operators.run import run
from ledgerloom.sources import files, sinks
from ledgerloom.sources.settings import Settings
from tests.fixtures import pages


def rows(df):
    return sorted(str(r.asDict(True)) for r in df.collect())


def test_a_run_from_candidate_files(spark, tmp_path):
    folder, out = tmp_path / "candidates", str(tmp_path / "graph")
    folder.mkdir()
    for doc in ("D1", "D2"):
        found = [r.asDict(True) | {"doc": None} for r in pages(spark).filter(F.col("doc") == doc).collect()]
        (folder / f"{doc}{files.CANDIDATES}").write_text(json.dumps(found, indent=1))
    (tmp_path / "meta.csv").write_text("Contract ID,Title\nC-1001,Given\n")
    settings = Settings.of({"CANDIDATES": str(folder), "CONFIDENCE": "0.95", "METADATA": str(tmp_path / "meta.csv")})
    seen = []
    run(spark, settings, out, "one", vectors=lambda p: seen.append(p.count()))
    nodes, edges, bridge = sinks.published(spark, out)
    p = pages(spark)
    names = graph.flatten_nodes(p).select("type", "name", "seq")
    want = ingest.ingest(p, resolve.resolve_in_order(names), files.read_metadata(spark, settings.metadata), threshold=0.95)
    assert [rows(a) for a in (nodes, edges, bridge)] == [rows(b) for b in want] and seen == [3]
    assert {r["rel_type"] for r in edges.collect()} == {"POSSIBLE_PARTY_TO", "POSSIBLE_REFERENCES_STANDARD", "POSSIBLE_SAME_AS"}
    run(spark, Settings.of({}, candidates=str(folder), skip_vectors=True), out, "two", vectors=lambda p: seen.append(p.count()))
    assert sinks.current_run(spark, out) == "two" and len(seen) == 1
    assert {r["rel_type"] for r in sinks.published(spark, out)[1].collect()} > {"PARTY_TO"}


def test_candidates_and_rows_as_json(spark, tmp_path):
    p = pages(spark)
    sinks.write_candidates(p, str(tmp_path / "c"))
    back = spark.read.schema(p.schema).json(str(tmp_path / "c"))
    assert {r["doc"] for r in back.collect()} == {"D1", "D2"} and rows(back.select(*p.columns)) == rows(p)
    sinks.write_json(p.select("doc", "page"), str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j")).select("doc", F.col("page").cast("int").alias("page"))) == rows(p.select("doc", "page"))


def test_vectors_of_other_tasks_do_not_meet(spark):
    q = spark.createDataFrame([(1, "query", [1.0, 0.0])], "query_id int, task_type string, q array<double>")
    c = spark.createDataFrame([(1, "document", [1.0, 0.0])], "vec_id int, task_type string, embedding array<double>")
    assert q.join(c, retrieval.same_task(q, c)).count() == 1
    for bad in (c.withColumn("task_type", F.lit("query")), c.withColumn("embedding", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="vectors of different tasks or lengths"):
            q.join(bad, retrieval.same_task(q, bad)).count()
