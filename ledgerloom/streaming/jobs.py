"""Streaming jobs over freeze events: exactly-once ingestion, backfill, pending references, registry, monitoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions.names import score
from ledgerloom.functions.text import key_of
from ledgerloom.sources import files
from ledgerloom.sources.schemas import MERGE_THRESHOLD


def event_stream(spark: SparkSession, folder: str, schema: str, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files with ``ts`` as a timestamp (watermarks refuse timestamps without a zone)."""
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    return r.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def once(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key's first event; retries within the watermark are dropped."""
    keyed = events.withColumn("event_key", key_of(*(F.col(k) for k in keys)))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_key"])


def ingest(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run ``write`` on each micro-batch: all that is there now, or with ``every`` at an interval, as a fallback to poll."""
    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def merge_batch(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A writer whose effect is the same however often a batch is repeated: each batch has a folder of its own, overwritten on retry."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def cutover(history: DataFrame, live: DataFrame, at, ts: str = "ts") -> DataFrame:
    """History before a time and live events from it on: no gap and nothing twice."""
    return history.filter(F.col(ts) < at).unionByName(live.filter(F.col(ts) >= at))


def backfill(history: DataFrame, folder: str, at, ts: str = "ts", unit: str = "day", keys: tuple[str, ...] = ("event_key",)) -> list[str]:
    """Write history before the cutover in pages of time, each a folder of its own, and give the names of the pages that were written.

    A page is written whole or not at all, and one that is there is not written again, so that a run that stopped is taken up where it was.
    Pages are as many as the days (or other units) of history, whatever its rows; events without a time go to the page ``none``.
    """
    spark = history.sparkSession
    paged = history.filter((F.col(ts) < at) | F.col(ts).isNull()).withColumn("__page", F.coalesce(F.date_format(F.date_trunc(unit, ts), "yyyyMMdd'T'HHmmss"), F.lit("none")))
    names = [r[0] for r in paged.select("__page").distinct().orderBy("__page").collect()]
    todo = [n for n in names if not files.exists(spark, f"{folder}/page={n}/_SUCCESS")]
    for n in todo:
        paged.filter(F.col("__page") == n).drop("__page").dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{folder}/page={n}")
    return todo


def reconciled(arrived: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Events that arrived but were not written, as rows that came after the watermark are dropped without a trace: dead letters with the reason."""
    done = written.select(*keys).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & arrived[k].eqNullSafe(done[k])
    return arrived.join(done, same, "left_anti").withColumn("reason", F.lit("too late"))


def dead_letters(events: DataFrame, *needed: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with an empty needed column go to review with the reason, and are never dropped."""
    reason = F.array_join(F.filter(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"no {c}")) for c in needed)), lambda x: x.isNotNull()), "; ")
    marked = events.withColumn("reason", reason)
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def tumbling(events: DataFrame, width: str, *by: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    c = e.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, gap: str, *by: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    c = e.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return c.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def pending(citations: DataFrame, documents: DataFrame, within: str = "30 days", late: str = "1 day") -> DataFrame:
    """Citations (key, ref, cited_at) joined to documents (key, document, arrived_at) that arrive within a time after; those without stay, with nulls, once the time is over."""
    c = citations.withWatermark("cited_at", late)
    d = documents.withColumnRenamed("key", "doc_key").withWatermark("arrived_at", late)
    match = F.expr(f"key = doc_key and arrived_at >= cited_at and arrived_at <= cited_at + interval {within}")
    return c.join(d, match, "leftOuter").select("key", "ref", "cited_at", "document", "arrived_at")


def registry(names: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Canonical names (type, name, canonical) as names (type, name, norm) come: state by type holds the normalised names seen, in order, and never ends."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        norms, canon = (list(x) for x in state.get) if state.exists else ([], [])
        known = dict(zip(norms, canon))
        for pdf in batches:
            out = []
            for name, norm in zip(pdf["name"], pdf["norm"]):
                if norm and norm not in known:
                    known[norm] = next((c for n, c in known.items() if score(norm, n) >= threshold), name)
                out.append((key[0], name, known.get(norm, name)))
            yield pd.DataFrame(out, columns=["type", "name", "canonical"])
        state.update((list(known), list(known.values())))

    return names.select("type", "name", "norm").groupBy("type").applyInPandasWithState(step, "type string, name string, canonical string", "norms array<string>, canon array<string>", "append", GroupStateTimeout.NoTimeout)
