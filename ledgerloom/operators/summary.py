"""Type summaries over all pages, edges with missing ends included."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ledgerloom.operators.graph import keep
from ledgerloom.sources.schemas import EXAMPLES, PAYLOAD_CHARS


def all_nodes(pages: DataFrame) -> DataFrame:
    n = pages.select("doc", "page", F.posexplode("nodes").alias("pos", "n"))
    return n.select(F.coalesce("n.type", F.lit("Unknown")).alias("type"), F.coalesce("n.name", F.lit("")).alias("name"), F.struct("doc", "page", "pos").alias("seq"))


def all_edges(pages: DataFrame) -> DataFrame:
    e = pages.select("doc", "page", F.posexplode("edges").alias("pos", "e"))
    text = F.concat(F.coalesce("e.source", F.lit("?")), F.lit(" -> "), F.coalesce("e.target", F.lit("?")))
    return e.select(F.coalesce("e.relation", F.lit("UNKNOWN")).alias("relation"), text.alias("name"), F.struct("doc", "page", "pos").alias("seq"))


def type_counts(rows: DataFrame, kind: str) -> DataFrame:
    """Counts by type, the most frequent first, ties by first appearance: (kind, count, place)."""
    c = rows.groupBy(kind).agg(F.count("*").alias("count"), F.min("seq").alias("first"))
    c = running(c.withColumn("one", F.lit(1)), [F.desc("count"), F.asc("first")], "one", "before")
    return c.select(kind, "count", (F.col("before") + 1).cast("int").alias("place"))


def running(df: DataFrame, order: list[Column], amount: str, out: str, within: list[Column] | None = None) -> DataFrame:
    """``df`` with the sum of a whole-number column over all rows before each row in an order; a null amount counts as 0.

    Rows are dealt by ranges of ``order`` (and sorted by ``within`` besides, of which long texts are no range); each task sums its range and each range begins with the sums of those before it.
    One row a range is added up in the driver, and no task sees all rows. Rows that the order does not tell apart come in any order.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    plain = df.select(*map(col, df.columns), F.coalesce(col(amount).cast("long"), F.lit(0)).alias("__amount")).repartitionByRange(*order).sortWithinPartitions(*order, *(within or []))
    plain = plain.toDF(*names, "amount")
    schema = StructType([*plain.schema.fields[:-1], StructField("part", IntegerType()), StructField("here", LongType()), StructField("upto", LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("amount").to_numpy()
            upto = total + np.cumsum(n)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(len(n), part), pa.int32()), pa.array(upto - n), pa.array(upto)], names=[f.name for f in schema.fields])

    summed = keep(plain.mapInArrow(sums, schema))
    ends = sorted((r["part"], r["total"]) for r in summed.groupBy("part").agg(F.max_by("upto", F.struct("upto", "here")).alias("total")).collect())
    before = list(zip((p for p, _ in ends), accumulate((t for _, t in ends), initial=0)))
    offsets = df.sparkSession.createDataFrame(before, "part int, offset long")
    found = summed.join(F.broadcast(offsets), "part")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns)), (F.col("here") + F.col("offset")).alias(out))


def examples(rows: DataFrame, kind: str, n: int = EXAMPLES) -> DataFrame:
    """The first n distinct names of each type by first appearance, sorted: (kind, examples)."""
    first = rows.groupBy(kind, "name").agg(F.min("seq").alias("first"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(kind).orderBy("first", "name"))).filter(F.col("r") <= n)
    return ranked.groupBy(kind).agg(F.array_sort(F.collect_list("name")).alias("examples"))


def suggested(pages: DataFrame) -> DataFrame:
    """All distinct reasons of each suggested type, sorted."""
    s = pages.select(F.explode("suggested_new_types").alias("s"))
    return s.groupBy(F.coalesce("s.type", F.lit("?")).alias("type")).agg(F.array_sort(F.collect_set(F.coalesce("s.reason", F.lit("")))).alias("reasons"))


def synthesis_payload(insights: DataFrame, chars: int = PAYLOAD_CHARS) -> DataFrame:
    """All insights as JSON in the order of their files, cut for a model's input. Rows are numbered first, so that only those that may fit are gathered."""
    j = insights.select("_source_file", F.to_json(F.struct(*insights.columns)).alias("j"))
    j = running(j.withColumn("size", F.length("j") + 1), [F.asc("_source_file")], "size", "before", [F.asc("j")])
    kept = j.filter(F.col("before") < chars)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_source_file", "j"))), lambda x: x["j"])
    return kept.agg(F.substring(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 1, chars).alias("payload"))
