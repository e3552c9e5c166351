"""The entity registry of a stream: names as they come, resolved against all that came before, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import normalize_name
from ledgerloom.operators.graph import keep, roots
from ledgerloom.operators.resolve import earliest
from ledgerloom.sources import files
from ledgerloom.sources.schemas import MERGE_THRESHOLD

_AT = "struct<batch: long, seq: long, name: string>"
_ENTRIES = f"kind string, norm string, canonical string, at {_AT}, batch long"


def entries(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The registered names (kind, norm, canonical, at, batch), of batches before a number where one is given."""
    if not files.exists(spark, f"{folder}/entries"):
        return spark.createDataFrame([], _ENTRIES)
    out = spark.read.schema(_ENTRIES).parquet(f"{folder}/entries")
    return out if before is None else out.filter(F.col("batch") < before)


def size(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, entries): how the registry has grown."""
    return entries(spark, folder).groupBy("batch").agg(F.count("*").alias("entries"))


def register(folder: str, threshold: float = MERGE_THRESHOLD) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch`` over names (type, name, seq): canonical names go to ``folder/names``, new registry entries to ``folder/entries``.

    A name is resolved as ``resolve_in_order`` does over all batches so far in their order, within a batch by ``seq``. The state is the table of entries, one row for each
    normalised name, read as any other table: new names meet it in the index of rare tokens, so no type and no name is gathered in one place, and entries are never written
    again. A batch that is repeated reads the batches before it only and overwrites its own folders, so its effect is the same however often it runs.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = F.coalesce(F.concat(F.lit("="), F.col("type").cast("string")), F.lit(""))
        rows = batch.groupBy("type", "name").agg(F.min(F.col("seq").cast("long")).alias("seq"))
        rows = keep(rows.select("type", "name", "seq", kind.alias("kind"), normalize_name(F.col("name"), strip_dash=True).alias("norm")))
        known = keep(entries(spark, folder, number).drop("batch"))
        fresh = rows.filter("norm <> ''").groupBy("kind", "norm").agg(F.min(F.struct(F.lit(number).cast("long").alias("batch"), "seq", "name")).alias("at"))
        fresh = keep(fresh.join(known, ["kind", "norm"], "left_anti"))
        parents = earliest(fresh.withColumn("side", F.lit(3)).unionByName(known.select("kind", "norm", "at", F.lit(2).alias("side"))), threshold)
        top = roots(parents.select(F.struct("kind", "norm").alias("id"), F.struct("kind", F.col("parent").alias("norm")).alias("up")))
        top = top.select(F.col("id.kind").alias("kind"), F.col("id.norm").alias("norm"), F.col("up.norm").alias("root"))
        stands = known.select("kind", F.col("norm").alias("root"), "canonical").unionByName(fresh.select("kind", F.col("norm").alias("root"), F.col("at.name").alias("canonical")))
        new = fresh.join(top, ["kind", "norm"], "left").withColumn("root", F.coalesce("root", "norm")).join(stands, ["kind", "root"]).select("kind", "norm", "canonical", "at")
        new = keep(new)
        told = known.select("kind", "norm", "canonical").unionByName(new.select("kind", "norm", "canonical"))
        out = rows.join(told, ["kind", "norm"], "left").select("type", "name", F.coalesce("canonical", "name").alias("canonical"))
        out.write.mode("overwrite").parquet(f"{folder}/names/batch={number}")
        new.write.mode("overwrite").parquet(f"{folder}/entries/batch={number}")

    return write
