"""Outputs: candidates, summaries, analysis files, graph snapshots, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import files


def write_candidates(pages: DataFrame, folder: str) -> None:
    pages.write.mode("overwrite").partitionBy("doc").json(folder)


def write_csv(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """One CSV file with a header and the columns in this order; for results that are small by their limit or threshold."""
    rows.select(*columns).coalesce(1).write.mode("overwrite").csv(folder, header=True)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def summary_row(node_counts: DataFrame, node_examples: DataFrame, edge_counts: DataFrame, edge_examples: DataFrame, suggested: DataFrame) -> DataFrame:
    """The type summary as one row of JSON; types are few."""
    as_map = lambda df, k, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("m"))
    parts = [as_map(node_counts, "type", "count"), as_map(node_examples, "type", "examples"), as_map(edge_counts, "relation", "count"), as_map(edge_examples, "relation", "examples"), as_map(suggested, "type", "reasons")]
    names = ["node_type_counts", "node_type_examples", "edge_type_counts", "edge_type_examples", "suggested_new_types"]
    out = parts[0].withColumnRenamed("m", names[0])
    for part, name in zip(parts[1:], names[1:]):
        out = out.crossJoin(part.withColumnRenamed("m", name))
    return out.select(F.to_json(F.struct(*names)).alias("summary"))


def _pointer(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    if not files.exists(spark, f"{folder}/current/_SUCCESS"):
        return 0, None
    runs = spark.read.schema("n long, run_id string").json(f"{folder}/current")
    return tuple(runs.agg(F.max("n"), F.max_by("run_id", "n")).first())


def current_run(spark: SparkSession, folder: str) -> str | None:
    """The run that a folder's last pointer names, or None before the first one."""
    return _pointer(spark, folder)[1]


def published(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(nodes, edges, bridge) of the current run, which ``ingest.ingest`` takes as ``stored``."""
    run = current_run(spark, folder)
    return None if run is None else tuple(spark.read.parquet(f"{folder}/{run}/{name}") for name in ("nodes", "edges", "bridge"))


def publish(nodes: DataFrame, edges: DataFrame, bridge: DataFrame, folder: str, run_id: str) -> None:
    """Write a run's tables, then the pointer that makes them current: readers see all of a run or none of it.

    A run never overwrites the current one, which it may be reading; a run that failed before its pointer can be repeated under its name. Pointers are added, not
    replaced, so that there is a current run at any time.
    """
    spark = nodes.sparkSession
    n, current = _pointer(spark, folder)
    if current == run_id:
        raise ValueError(f"run {run_id} is current already")
    for name, table in (("nodes", nodes), ("edges", edges), ("bridge", bridge)):
        table.write.mode("overwrite").parquet(f"{folder}/{run_id}/{name}")
    spark.createDataFrame([(n + 1, run_id)], "n long, run_id string").coalesce(1).write.mode("append").json(f"{folder}/current")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Chunks by whether they are superseded, so that queries on current text prune the rest; within that in ranges of contract and chunk, so that a contract of many chunks fills several files."""
    chunks.repartitionByRange("contract_id", "chunk_id").sortWithinPartitions("contract_id", "chunk_id").write.mode("overwrite").partitionBy("superseded").parquet(folder)


def write_insights(insights: DataFrame, folder: str, parts: int | None = None) -> None:
    """Insights as a row of JSON per image in ``images``, and all of them as one sorted list: the parts of ``all``, read in the order of their names.

    The list is never gathered: parts are ranges of file names, and a line of a part is an item.
    """
    insights.write.mode("overwrite").json(f"{folder}/images")
    ranges = (parts, "_source_file") if parts else ("_source_file",)
    insights.repartitionByRange(*ranges).sortWithinPartitions("_source_file").write.mode("overwrite").json(f"{folder}/all")


def proposal(summary: DataFrame, title: str = "Schema proposal") -> str:
    """A Markdown text of counts by kind and key; the synthesis itself is a boundary."""
    lines = [f"# {title}", "", "| kind | key | count |", "|---|---|---|"]
    return "\n".join(lines + [f"| {r['kind']} | {r['key']} | {r['count']} |" for r in summary.orderBy("kind", F.desc("count"), "key").collect()])
