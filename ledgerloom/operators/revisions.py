"""Contract revisions: versions, chunk changes, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(events: DataFrame, contract: str, *order: str) -> DataFrame:
    """Events with a revision number within their contract."""
    return events.withColumn("revision", F.row_number().over(Window.partitionBy(contract).orderBy(*order)))


def chain(versions: DataFrame) -> DataFrame:
    """SUPERSEDES: each revision with the one before it."""
    w = Window.partitionBy("contract_id").orderBy("revision")
    return versions.withColumn("supersedes", F.lag("revision").over(w))


def latest(versions: DataFrame, *columns: str) -> DataFrame:
    """The current revision of each contract, derived and never stored."""
    return versions.groupBy("contract_id").agg(F.max("revision").alias("revision"), *(F.max_by(c, "revision").alias(c) for c in columns))


def superseded(versions: DataFrame) -> DataFrame:
    top = versions.groupBy("contract_id").agg(F.max("revision").alias("__top"))
    return versions.join(top, "contract_id").withColumn("superseded", F.col("revision") < F.col("__top")).drop("__top")


def as_of(versions: DataFrame, when, ts: str = "freeze_ts") -> DataFrame:
    """What was current at a time: the last revision frozen by then."""
    return latest(versions.filter(F.col(ts) <= when), ts)


def chunk_changes(chunks: DataFrame) -> DataFrame:
    """(contract_id, revision, chunk_hash, status) of chunks against the revision before: reused or new, and removed ones."""
    d = chunks.select("contract_id", "revision", "chunk_hash").distinct()
    before = d.select("contract_id", (F.col("revision") + 1).alias("revision"), "chunk_hash", F.lit(True).alias("was"))
    now = d.withColumn("now", F.lit(True))
    revisions = d.select("contract_id", "revision").distinct()
    both = now.join(before, ["contract_id", "revision", "chunk_hash"], "full").join(revisions, ["contract_id", "revision"], "left_semi")
    status = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "new").otherwise("reused")
    return both.select("contract_id", "revision", "chunk_hash", status.alias("status"))


def audit(changes: DataFrame) -> DataFrame:
    """One row per revision: counts and a line of text."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    a = changes.groupBy("contract_id", "revision").agg(n("new").alias("added"), n("removed").alias("removed"), n("reused").alias("reused"))
    return a.withColumn("changed", F.col("added") + F.col("removed")).withColumn("summary", F.format_string("rev %d: %d added, %d removed, %d reused", "revision", "added", "removed", "reused"))


def set_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """(chunk_hash, change) by multiset operations: what only one side has, and what both have."""
    tag = lambda df, t: df.withColumn("change", F.lit(t))
    return tag(now.exceptAll(before), "added").unionByName(tag(before.exceptAll(now), "removed")).unionByName(tag(now.intersect(before), "kept"))


def reuse_embeddings(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with an embedding of equal text, chunks to embed)."""
    k = known.groupBy("chunk_hash").agg(F.first("embedding", ignorenulls=True).alias("embedding"))
    j = chunks.drop("embedding").join(k, "chunk_hash", "left")
    return j.filter("embedding is not null"), j.filter("embedding is null").drop("embedding")


def cumulative(terms: DataFrame, key: str, amount: str, *order: str) -> DataFrame:
    """Running totals over a contract's milestones."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return terms.withColumn("cumulative", F.sum(amount).over(w))


def unwound(payload: DataFrame) -> DataFrame:
    """Milestones and their payment terms as rows; an empty list gives none. Terms are numbered, so that several on one milestone stay apart."""
    m = payload.select("contract_id", "revision", "chunk_id", F.explode("milestones").alias("m"))
    t = m.select("contract_id", "revision", "chunk_id", F.col("m.name").alias("milestone"), F.col("m.date_offset").alias("date_offset"), F.posexplode("m.payment_terms").alias("pos", "t"))
    return t.select("contract_id", "revision", "milestone", "date_offset", (F.col("pos") + 1).alias("term_no"), "t.percent", "t.cumulative_percent", "t.amount_usd", F.col("chunk_id").alias("source_chunk_id"))


def last_terms(terms: DataFrame) -> DataFrame:
    """One term per milestone, the last: the key without the term's number."""
    return terms.groupBy("contract_id", "revision", "milestone").agg(F.max_by(F.struct("percent", "cumulative_percent", "amount_usd", "source_chunk_id"), "term_no").alias("t")).select("contract_id", "revision", "milestone", "t.*")
