"""Retrieval: vectors, facts, both, routing, access."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def topk(queries: DataFrame, chunks: DataFrame, k: int, on: Column | None = None) -> DataFrame:
    """The k nearest chunks of each query (query_id, q) among (vec_id, embedding, ...), by exact scan: (query_id, vec_id, rank, score).

    Queries are few and are broadcast; every chunk is read once, where it lies. Each task keeps its own best k of each query first, so that k
    rows a task and query are shuffled, whatever the number of chunks.
    """
    q = F.broadcast(queries)
    pairs = chunks.join(q, on) if on is not None else chunks.crossJoin(q)
    pairs = pairs.select("query_id", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("score"), F.spark_partition_id().alias("__part"))
    order = [F.desc("score"), F.asc("vec_id")]
    local = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "__part").orderBy(*order))).filter(F.col("r") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "score")


def _scores(q: np.ndarray, rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Cosines of a query to n rows, given by length as (places, vectors, norms); not a number where lengths differ. Equal vectors get equal scores."""
    out = np.full(n, np.nan)
    if len(q) in rows:
        at, x, norms = rows[len(q)]
        with np.errstate(all="ignore"):
            out[at] = (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * norms)
    return out


def topk_blocks(queries: DataFrame, chunks: DataFrame, k: int, same: tuple[str, str] | None = None, block: int = 1024, slice_: int = 4096) -> DataFrame:
    """As ``topk`` for any number of queries: blocks of queries meet slices of chunks in a grid, nothing is broadcast. ids are unique.

    A cell gives k rows of each query at most. ``same`` names a column of the queries and one of the chunks that must be equal. Scores that are
    no number (vectors of different lengths, without length, or with gaps) come last, as null.
    """
    asked, label = same or ("query_id", "vec_id")
    blocks, slices = -(-max(queries.count(), 1) // block), max(16, -(-max(chunks.count(), 1) // slice_))
    spread = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    part = lambda key, n, c: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(c)
    q = queries.select("query_id", F.col(asked).alias("asked"), "q", part("query_id", blocks, "b")).select("*", spread(slices, "s"))
    c = chunks.select("vec_id", F.col(label).alias("label"), "embedding", part("vec_id", slices, "s")).select("*", spread(blocks, "b"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        vectors = [None if v is None else np.asarray(v, dtype="float64") for v in right["embedding"]]
        rows = {}
        for d in {len(v) for v in vectors if v is not None}:
            at = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == d])
            x = np.stack([vectors[i] for i in at])
            rows[d] = at, x, np.sqrt((x * x).sum(axis=1))
        ids, labels, out = right["vec_id"].to_numpy(), right["label"], []
        for i, own, v in zip(left["query_id"], left["asked"], left["q"]):
            found = np.full(len(ids), np.nan) if v is None else _scores(np.asarray(v, dtype="float64"), rows, len(ids))
            fit = np.flatnonzero((labels == own).to_numpy(dtype=bool)) if same else np.arange(len(ids))
            best = fit[np.lexsort((ids[fit], np.where(np.isnan(found[fit]), np.inf, -found[fit])))][:k]
            out.append(pd.DataFrame({"query_id": i, "vec_id": ids[best], "score": found[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["vec_id"]
    local = q.groupBy("b", "s").cogroup(c.groupBy("b", "s")).applyInPandas(cell, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    local = local.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "score")


def current_chunks(chunks: DataFrame, contracts: DataFrame | list | None = None) -> DataFrame:
    """Chunks that a search may give: not superseded and, if ``contracts`` is given, of these contracts (a short list of ids, or a table of any size with contract_id)."""
    current = chunks.filter(~F.coalesce("superseded", F.lit(False)))
    if contracts is None:
        return current
    return current.join(contracts.select("contract_id"), "contract_id", "left_semi") if isinstance(contracts, DataFrame) else current.filter(F.col("contract_id").isin(contracts))


def truncated(embedding: Column, k: int) -> Column:
    """The first k components, scaled to length 1."""
    head = F.transform(F.slice(embedding, 1, k), lambda x: x.cast("double"))
    return F.transform(head, lambda x: x / norm(head))


def facts(contracts: DataFrame, has_clause: DataFrame, clause_document: DataFrame, milestones: DataFrame) -> DataFrame:
    """Milestone facts of contracts of which a clause refers to a document; the path is a condition and does not multiply rows."""
    path = has_clause.join(clause_document, "clause_id", "left_semi")
    return milestones.join(contracts, "contract_id", "left_semi").join(path, "contract_id", "left_semi")


def hybrid(hits: DataFrame, facts_of: DataFrame, on: str) -> DataFrame:
    """Vector hits with the facts of their contracts; a hit without facts stays."""
    return hits.join(facts_of, on, "left")


def route(question: Column, money: str = r"[$%]", dates: str = r"\b\d{4}-\d{2}-\d{2}\b|\b(date|when|deadline)\b", totals: str = r"\b(cumulative|total|how much|sum)\b") -> Column:
    """vector, or hybrid where a signal of amounts, dates or totals shows that structured facts are asked for."""
    q = F.lower(question)
    return F.when(q.rlike(money) | q.rlike(dates) | q.rlike(totals), "hybrid").otherwise("vector")


def allowed(rows: DataFrame, grants: DataFrame, on: list[str]) -> DataFrame:
    """Rows that some grant covers."""
    return rows.join(grants, on, "left_semi")


def same_task(queries: DataFrame, chunks: DataFrame) -> Column:
    """A join condition that errors when vectors of different tasks or lengths meet."""
    ok = (queries["task_type"] == "query") & (chunks["task_type"] == "document") & (F.size(queries["q"]) == F.size(chunks["embedding"]))
    return F.assert_true(ok, "vectors of different tasks or lengths").isNull()
