"""A run from candidate files to the published graph, as its settings say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph, ingest, resolve
from ledgerloom.sources import files, sinks
from ledgerloom.sources.settings import Settings


def run(spark: SparkSession, settings: Settings, folder: str, run_id: str, pages: DataFrame | None = None, vectors=None) -> None:
    """Read the candidates of ``settings`` (or ``pages``), resolve, overlay metadata, gate, merge into what ``folder`` has published, and publish as ``run_id``.

    ``vectors`` takes the pages that have text and writes their vectors; it is left out where the settings skip vectors. Nodes without a name are no entities.
    """
    p = files.read_candidates(spark, settings.candidates) if pages is None else pages
    nodes = graph.flatten_nodes(p).select(F.coalesce("type", F.lit("Unknown")).alias("type"), F.trim("name").alias("name"), "seq").filter("name <> ''")
    canonical = resolve.resolve_in_order(nodes, settings.threshold)
    metadata = None if settings.metadata is None else files.read_metadata(spark, settings.metadata)
    sinks.publish(*ingest.ingest(p, canonical, metadata, settings.source, sinks.published(spark, folder), settings.confidence), folder, run_id)
    if vectors is not None and not settings.skip_vectors:
        vectors(p.filter("trim(raw_text) <> ''"))
