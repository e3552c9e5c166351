"""The embedding boundary between structural chunks and extraction: each step reads and writes a table of its own."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructType

from ledgerloom.operators.extraction import attempt
from ledgerloom.operators.revisions import reuse_embeddings

Embedder = Callable[[list[str]], list[list[float]]]


def by_hashes(texts: list[str], dims: int = 64) -> list[list[float]]:
    """The default embedder: words are counted with a sign at a place of their hash, and the vector has length 1."""
    out = []
    for text in texts:
        v = [0.0] * dims
        for word in text.lower().split():
            h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
            v[(h >> 1) % dims] += 1.0 if h & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def embedded(chunks: DataFrame, embedder: Embedder = by_hashes, text: str = "text", batch: int = 64, tries: int = 3, pause: float = 2.0) -> DataFrame:
    """Chunks with ``embedding``, ``embedding_dims`` and ``embedding_error``.

    Texts go out in batches; of a batch that fails each text is tried by itself, so that one bad text takes no other with it. Blank texts are
    not sent: they have neither an embedding nor an error. A failed chunk keeps its row.
    """
    plain = chunks.drop("embedding", "embedding_dims", "embedding_error")
    extra = StructType().add("embedding", ArrayType(FloatType())).add("embedding_dims", IntegerType()).add("embedding_error", StringType())

    def call(texts: list[str]) -> list[list[float]]:
        got = embedder(texts)
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[int, tuple[list[float] | None, str | None]] = {}
            sent = [i for i, t in enumerate(pdf[text]) if isinstance(t, str) and t.strip()]
            for at in range(0, len(sent), batch):
                part = sent[at : at + batch]
                got, error = attempt(lambda p=part: call([pdf[text].iloc[i] for i in p]), tries, lambda k: pause * k)
                if error is None:
                    found |= {i: (v, None) for i, v in zip(part, got)}
                    continue
                for i in part:
                    one, error = attempt(lambda i=i: call([pdf[text].iloc[i]]), 1, float)
                    found[i] = (one[0] if error is None else None, error)
            rows = [found.get(i, (None, None)) for i in range(len(pdf))]
            vectors = [None if v is None else [float(x) for x in v] for v, _ in rows]
            sizes = pd.array([None if v is None else len(v) for v in vectors], dtype="Int32")
            yield pdf.assign(embedding=pd.Series(vectors, index=pdf.index, dtype=object), embedding_dims=sizes, embedding_error=pd.Series([e for _, e in rows], index=pdf.index, dtype=object))

    return plain.mapInPandas(run, StructType(plain.schema.fields + extra.fields))


def embedded_changes(chunks: DataFrame, known: DataFrame, embedder: Embedder = by_hashes, **options) -> DataFrame:
    """Chunks (chunk_hash, text, ...) with embeddings: those of equal text are taken from ``known`` (chunk_hash, embedding), and of the rest each distinct text is sent once."""
    kept, fresh = reuse_embeddings(chunks.drop("embedding_dims", "embedding_error"), known)
    once = fresh.groupBy("chunk_hash").agg(F.min("text").alias("text"))
    made = embedded(once, embedder, **options).drop("text")
    kept = kept.withColumn("embedding", F.col("embedding").cast("array<float>")).withColumn("embedding_dims", F.size("embedding")).withColumn("embedding_error", F.lit(None).cast("string"))
    return kept.unionByName(fresh.join(made, "chunk_hash", "left"))


def datapoints(chunks: DataFrame, bridge: DataFrame | None = None, tenant: str = "contract_id") -> DataFrame:
    """What a vector index takes of chunks: (datapoint_id, feature_vector, restricts, crowding_tag, element_ids).

    A search is restricted to a tenant by ``restricts`` and spread over tenants by ``crowding_tag``; ``element_ids`` are the graph nodes of the
    chunk by ``bridge`` (chunk_id, element_id), sorted. Chunks without text or embedding are left out.
    """
    usable = chunks.filter(F.col("text").rlike(r"\S")).filter(F.size("embedding") > 0)
    owner: Column = F.coalesce(F.col(tenant).cast("string"), F.lit(""))
    restricts = F.array(F.struct(F.lit(tenant).alias("namespace"), F.array(owner).alias("allow")))
    points = usable.select(F.col("chunk_id").alias("datapoint_id"), F.col("embedding").alias("feature_vector"), restricts.alias("restricts"), owner.alias("crowding_tag"))
    none = F.array().cast("array<string>")
    if bridge is None:
        return points.withColumn("element_ids", none)
    nodes = bridge.groupBy(F.col("chunk_id").alias("datapoint_id")).agg(F.array_sort(F.collect_set("element_id")).alias("element_ids"))
    return points.join(nodes, "datapoint_id", "left").withColumn("element_ids", F.coalesce("element_ids", none))
