"""Streams with state: placeholders with timers, the registry by batches, and a paginated feed, each stopped and restarted."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import resolve
from ledgerloom.sources import feed
from ledgerloom.streaming import jobs, pending, register
from tests.test_fuzzy import names


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


def test_placeholders_relink_age_and_restart(rocks, tmp_path):
    spark, t = rocks, pd.Timestamp
    kinds = ("key string, ref long, cited_at timestamp", "key string, document string, arrived_at timestamp")

    def add(which, rows):
        spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in kinds[which].split(", ")]), kinds[which]).coalesce(1).write.mode("append").parquet(str(tmp_path / "cd"[which]))

    def run():
        c, d = (spark.readStream.schema(k).parquet(str(tmp_path / x)) for k, x in zip(kinds, "cd"))
        q = pending.placeholders(c, d).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return sorted((r["key"], r["ref"], r["outcome"], r["document"], str(r["at"])[:10]) for r in spark.read.parquet(str(tmp_path / "o")).collect())

    add(0, [("soon", 1, t("2024-01-01")), ("late", 2, t("2024-01-01")), ("late", 3, t("2024-01-02")), ("never", 4, t("2024-01-01"))])
    add(1, [("known", "K", t("2024-01-01"))])
    assert run() == []
    add(1, [("soon", "S", t("2024-01-10"))])
    add(0, [("known", 5, t("2024-01-10"))])
    one = [("known", "5", "resolved", "K", "2024-01-10"), ("soon", "1", "relinked", "S", "2024-01-10")]
    assert run() == one
    add(0, [("clock", 9, t("2024-02-10"))])  # the watermark moves with both streams
    add(1, [("clock", "C", t("2024-02-10"))])
    run()
    add(0, [("clock", 10, t("2024-02-11"))])
    two = run()
    aged = [("late", "2", "aged 30", None, "2024-01-31"), ("late", "3", "aged 30", None, "2024-02-01"), ("never", "4", "aged 30", None, "2024-01-31")]
    assert {r for r in two if r[0] != "clock"} == {*one, *aged}
    add(1, [("late", "L", t("2024-02-12"))])
    add(0, [("clock", 11, t("2024-02-12"))])
    run()
    add(0, [("clock", 12, t("2024-06-01"))])
    add(1, [("clock", "C", t("2024-06-01"))])
    run()
    add(0, [("clock", 13, t("2024-06-02"))])
    three = {r for r in run() if r[0] != "clock"}
    relinked = {("late", "2", "relinked", "L", "2024-02-12"), ("late", "3", "relinked", "L", "2024-02-12")}
    assert three == {*one, *aged, *relinked, ("never", "4", "aged 60", None, "2024-03-01")}
    add(1, [("never", "N", t("2024-06-03"))])  # its placeholder has ended
    assert {r for r in run() if r[0] != "clock"} == three


def test_registry_equals_one_pass_over_all_batches(spark, tmp_path):
    r = random.Random(3)
    some = names(20, 90)
    rows = [(r.choice(["T", "T", "U", None]), r.choice(some).title() + r.choice(["", " Inc."]), i) for i in range(240)] + [("T", "Inc.", 240)]
    folder, feed_, out = str(tmp_path / "r"), str(tmp_path / "in"), {}
    for k in range(3):  # each run is a restart from the checkpoint
        spark.createDataFrame(rows[k * 80 : k * 80 + 81 if k == 2 else k * 80 + 80], "type string, name string, seq int").coalesce(1).write.mode("append").parquet(feed_)
        s = spark.readStream.schema("type string, name string, seq int").parquet(feed_)
        q = jobs.ingest(s, register.register(folder), str(tmp_path / "cp"))
        q.awaitTermination(240)
        assert q.exception() is None
    for x in spark.read.parquet(f"{folder}/names").collect():
        out.setdefault((x["type"], x["name"]), set()).add(x["canonical"])
    want = {(x["type"], x["name"]): {x["canonical"]} for x in resolve.resolve_in_order(spark.createDataFrame(rows, "type string, name string, seq int")).collect()}
    assert out == want
    sizes = {x["batch"]: x["entries"] for x in register.size(spark, folder).collect()}
    assert set(sizes) == {0, 1, 2} and sum(sizes.values()) == register.entries(spark, folder).select("kind", "norm").distinct().count()
    before = sorted(map(tuple, spark.read.parquet(f"{folder}/names/batch=1").collect()), key=str)
    register.register(folder)(spark.createDataFrame(rows[80:160], "type string, name string, seq int"), 1)  # a repeated batch
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/names/batch=1").collect()), key=str) == before
    assert {x["batch"]: x["entries"] for x in register.size(spark, folder).collect()} == sizes


def put(folder, n):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{n:04d}.json").write_text("".join(json.dumps({"id": 10 * n + i, "text": f"é{n}"}) + "\n" for i in range(3)))


@pytest.mark.parametrize("stops", [(1, 2, 3, 4, 5, 6), (4,), (2, 5)])
def test_feed_has_each_event_once_wherever_it_stops(spark, tmp_path, stops):
    pages, name = tmp_path / "pages", f"feed{len(stops)}"
    spark.dataSource.register(feed.source(feed.FolderClient(f"file://{pages}"), "id long, text string, page string", name))
    for n in range(1, 4):
        put(pages, n)
    cut = feed.FolderClient(f"file://{pages}").last()
    put(pages, 4)
    got = [r["id"] for r in feed.history(spark, name, cut).collect()]
    assert feed.history(spark, name, cut).rdd.getNumPartitions() == 3
    assert sorted(r["id"] for r in feed.history(spark, name, cut, after="page-0001.json").collect()) == [20, 21, 22, 30, 31, 32]
    for stop in [*stops, 6]:
        for n in range(5, 5 + stop):
            if n <= 10:
                put(pages, n)
        q = feed.live(spark, name, cut).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(got + [r["id"] for r in rows]) == sorted(10 * n + i for n in range(1, 11) for i in range(3))
    assert {(r["id"] // 10, r["text"], r["page"]) for r in rows} == {(n, f"é{n}", f"page-{n:04d}.json") for n in range(4, 11)}


def test_feed_is_polled(spark, tmp_path):
    pages = tmp_path / "pages"
    spark.dataSource.register(feed.source(feed.FolderClient(f"file://{pages}"), "id long, text string", "polled"))
    put(pages, 1)
    q = jobs.ingest(feed.live(spark, "polled", ""), jobs.merge_batch(str(tmp_path / "o"), ["id"]), str(tmp_path / "cp"), every="1 second")
    try:
        for n in (2, 3):
            put(pages, n)
            end = time.time() + 60
            while time.time() < end and not (tmp_path / "o").exists() or spark.read.parquet(str(tmp_path / "o")).agg(F.max("id")).first()[0] < 10 * n:
                time.sleep(1)
    finally:
        q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [10, 11, 12, 20, 21, 22, 30, 31, 32]
