import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.names import normalize_name
from ledgerloom.operators import chunks, extraction, references, retrieval, summary
from ledgerloom.sources import files, sinks
from ledgerloom.streaming import jobs
from tests.fixtures import pages


def test_files_to_pages_to_graph(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.pdf").write_text("Contract C-1001 with Acme Systems refers to STD-9.\f \fsecond")
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "x.txt").write_text("no")
    found = files.discover(spark, str(tmp_path / "in"))
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["a.pdf", "b.pdf"]
    got = {(r["doc"], r["page"]): r for r in extraction.extract(extraction.page_texts(found), pause=0).collect()}
    assert len(got) == 4 and [n["name"] for n in got["b", 1]["nodes"]] == ["C-1001", "STD-9", "Acme Systems"] and got["b", 2]["nodes"] == []
    assert files.first_files(found, 1).count() == 1 and files.not_done(found, found.limit(1), "path").count() == 1


def test_payload_has_no_line_breaks(spark):
    import base64

    content = [b"", b"a", b"https://" + b"x" * 49, b"https://" + b"x" * 50, bytes(range(256)) * 3, None]
    rows = spark.createDataFrame([(c,) for c in content], "content binary").select("content", files.payload(F.col("content")).alias("p")).collect()
    assert [r["p"] for r in rows] == [None if c is None else base64.b64encode(c).decode() for c in content]


def test_a_failing_page_keeps_its_row(spark):
    def bad(text):
        raise ValueError("no model")

    p = spark.createDataFrame([("d", 1, "text", "ok", None), ("d", 2, " ", "ok", None)], "doc string, page int, raw_text string, status string, error string")
    got = {r["page"]: (r["status"], r["error"]) for r in extraction.extract(p, bad, tries=2, pause=0).collect()}
    assert got == {1: ("failed", "ValueError: no model"), 2: ("ok", None)}
    assert extraction.attempt(lambda: 1 / 0, 1, float)[1].startswith("ZeroDivisionError")


def test_insights(spark):
    good = {"document_type_guess": "other", "section_heading": "", "parties": [{"name": "A", "role": "buyer"}], "has_signature": True}
    f = spark.createDataFrame([("/x/b.jpg", bytearray(json.dumps(good).encode())), ("/x/a.jpg", bytearray(b"{not json"))], "path string, content binary")
    rows = extraction.image_insights(f, lambda c: c.decode(), pause=0).collect()
    assert [r["_source_file"] for r in rows] == ["a.jpg", "b.jpg"] and rows[0]["error"] and rows[1]["parties"][0]["role"] == "buyer"
    df = spark.createDataFrame([("x", None), (None, "boom")], "k string, e string")
    assert [r[0] for r in df.select(extraction.page_label(F.col("k"), F.col("e"))).collect()] == ["x", "ERROR: boom"]
    assert extraction.fitted(3200, 1000) == (1600, 500) and extraction.fitted(10, 20) == (10, 20)
    insights = extraction.image_insights(f, lambda c: c.decode(), pause=0)
    assert len(summary.synthesis_payload(insights, 100).first()["payload"]) <= 100


def test_sinks_round_trip(spark, tmp_path):
    p = pages(spark)
    sinks.write_json(p, str(tmp_path / "j"))
    assert spark.read.schema(p.schema).json(str(tmp_path / "j")).count() == 3
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "D9_graph_candidates.json").write_text(json.dumps([{"page": 1, "nodes": [{"name": "x", "type": "T"}], "edges": []}]))
    assert files.read_candidates(spark, str(tmp_path / "c")).first()["doc"] == "D9"
    assert files.read_summary(spark, str(tmp_path / "none.json")) is None
    n = spark.createDataFrame([(1,)], "a int")
    sinks.publish(n, n, n, str(tmp_path / "g"), "run1")
    assert spark.read.json(str(tmp_path / "g" / "current")).first()["run_id"] == "run1"
    s = summary
    row = sinks.summary_row(s.type_counts(s.all_nodes(p), "type"), s.examples(s.all_nodes(p), "type"), s.type_counts(s.all_edges(p), "relation"), s.examples(s.all_edges(p), "relation"), s.suggested(p))
    assert json.loads(row.first()[0])["node_type_counts"]["Party"] == 4
    counts = s.type_counts(s.all_nodes(p), "type").select(F.lit("node").alias("kind"), F.col("type").alias("key"), "count")
    assert "| node | Party | 4 |" in sinks.proposal(counts)


def test_chunks_and_references(spark):
    d = spark.createDataFrame([(1, "intro\nSECTION A\nx\n\nSECTION B\ny\nz"), (2, "")], "k int, t string")
    s = chunks.sectioned(chunks.lines(d, "k", "t"), "k", F.col("line").startswith("SECTION"))
    c = {r["section"]: (r["section_path"], r["text"]) for r in chunks.structure_chunks(s, "k").collect()}
    assert c == {0: (None, "intro"), 1: ("SECTION A", "SECTION A\nx"), 2: ("SECTION B", "SECTION B\ny\nz")}
    t = spark.createDataFrame([(1, "h", ["a", "b", "c"]), (2, "h", [])], "k int, header string, rows array<string>")
    assert [tuple(r) for r in chunks.row_groups(t, "k", 2).orderBy("part").collect()] == [(1, 0, "h\na\nb"), (1, 1, "h\nc")]
    p = spark.createDataFrame([("2024-01-01",)], "d string").select(F.to_date("d").alias("first_seen"))
    assert references.ageing(p, F.lit("2024-02-15").cast("date")).first()["bucket"] == "30 to 59"


def test_topk_against_all(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(50, 6))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(7, x[7].tolist())], "query_id int, q array<double>")
    got = [r_["vec_id"] for r_ in retrieval.topk(q, e, 5).orderBy("rank").collect()]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == np.argsort(-(u @ u[7]))[:5].tolist() and got[0] == 7
    a = q.withColumn("task_type", F.lit("document")).join(e.withColumn("task_type", F.lit("document")), F.lit(True))
    assert a.count() == 50


@pytest.fixture
def events(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    rows = [(f"k{i // 2}", base + pd.Timedelta(minutes=i)) for i in range(20)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["key", "ts"])).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def test_stream_has_each_event_once(spark, events, tmp_path):
    s = jobs.once(jobs.event_stream(spark, events, "key string, ts timestamp"), ["key"])
    out = str(tmp_path / "out")
    jobs.ingest(s, jobs.merge_batch(out, ["event_key"]), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 10
    jobs.ingest(s, jobs.merge_batch(out, ["event_key"]), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 10


def test_stream_windows(spark, events, tmp_path):
    s = jobs.tumbling(jobs.event_stream(spark, events, "key string, ts timestamp"), "10 minutes", late="1 minute")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [10, 10]


def test_registry_stream(spark, tmp_path):
    folder = str(tmp_path / "names")
    for k, names in enumerate((["Orion Systems", "Orion"], ["Orion Devices", "Acme Inc"])):
        df = spark.createDataFrame([("T", x) for x in names], "type string, name string").withColumn("norm", normalize_name(F.col("name"), True)).coalesce(1)
        df.write.mode("append").parquet(folder)
        s = jobs.registry(spark.readStream.schema(df.schema).parquet(folder))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and k in (0, 1)
    got = {r["name"]: r["canonical"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"Orion Systems": "Orion Systems", "Orion": "Orion Systems", "Orion Devices": "Orion Systems", "Acme Inc": "Acme Inc"}


def test_pending_references(spark, tmp_path):
    t = lambda s: pd.Timestamp(s)
    spark.createDataFrame(pd.DataFrame([("a", 1, t("2024-01-01")), ("b", 2, t("2024-01-01"))], columns=["key", "ref", "cited_at"])).write.parquet(str(tmp_path / "c"))
    spark.createDataFrame(pd.DataFrame([("a", "doc", t("2024-01-05"))], columns=["key", "document", "arrived_at"])).write.parquet(str(tmp_path / "d"))
    c = spark.readStream.schema("key string, ref long, cited_at timestamp").parquet(str(tmp_path / "c"))
    d = spark.readStream.schema("key string, document string, arrived_at timestamp").parquet(str(tmp_path / "d"))
    q = jobs.pending(c, d).writeStream.format("memory").queryName("p").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["ref"], r["document"]) for r in spark.table("p").collect()] == [(1, "doc")]


def test_batch_feeds(spark):
    e = spark.createDataFrame([(i, f"2024-01-{i:02d}", None if i == 3 else "c") for i in range(1, 6)], "id int, ts string, contract_id string")
    both = jobs.cutover(e, e, F.lit("2024-01-03"))
    assert sorted(r["id"] for r in both.collect()) == [1, 2, 3, 4, 5]
    good, bad = jobs.dead_letters(e, "contract_id")
    assert good.count() == 4 and [r["reason"] for r in bad.collect()] == ["no contract_id"]
