"""References between documents: resolution, placeholders, ageing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import document_key


def resolve(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations (ref, number) against documents (number) by normalised numbers: (ref, key, document, status), Unresolved where there is none. Of documents with one key the least number stands."""
    d = documents.select(document_key(F.col("number")).alias("key"), F.col("number").alias("document")).filter("key <> ''").groupBy("key").agg(F.min("document").alias("document"))
    c = citations.withColumn("key", document_key(F.col("number")))
    return c.join(d, "key", "left").select("ref", "key", "document", F.when(F.col("document").isNull(), "Unresolved").otherwise("Document").alias("status"))


def relink(pending: DataFrame, arrived: DataFrame) -> DataFrame:
    """Placeholders (key, ref) that documents arriving now resolve."""
    return resolve(pending.select("ref", F.col("key").alias("number")), arrived).filter("status = 'Document'")


def ageing(pending: DataFrame, today, first_seen: str = "first_seen") -> DataFrame:
    """Placeholders by age: (bucket, n) for under 30, 30 to 59, and 60 days or more."""
    days = F.datediff(today, F.col(first_seen))
    bucket = F.when(days < 30, "under 30").when(days < 60, "30 to 59").otherwise("60 or more")
    return pending.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


#: So many pairs are counted by a task.
PAIRS = 4_000_000


def _packed(c: Column) -> list[Column]:
    """Sorted longs by their bits 0 to 15, 16 to 23 and the rest: three arrays, of which the last ones compress to little."""
    return [
        F.transform(c, lambda x: (x.bitwiseAND(F.lit(65535)) - 32768).cast("smallint")).alias("low"),
        F.transform(c, lambda x: (F.shiftright(x, 16).bitwiseAND(F.lit(255)) - 128).cast("tinyint")).alias("mid"),
        F.transform(c, lambda x: F.shiftright(x, 24)).alias("high"),
    ]


def sharing_pairs(links: DataFrame, a: str, doc: str, most: int = 1024) -> DataFrame:
    """(left, right, shared): pairs of contracts that refer to a document in common; contracts are whole numbers or of another type that has an order.

    A document that very many contracts refer to gives a pair for any two of them; that is the result's own size. So that no task forms all of them, the contracts of a document
    with more than ``most`` are dealt to groups, and each pair of groups meets by itself; a document with fewer is one group. A repeated link counts once, null ends have no pairs.
    Pairs are not shuffled one by one: for each contract of a group a row goes with all greater ones of a group, numbers in about three bytes each.
    """
    kind = dict(links.dtypes)[a]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    d = links.select((F.col(a).cast("long") if whole else F.col(a)).alias("c"), F.col(doc).alias("d")).filter("c is not null and d is not null")
    counts = d.groupBy("d").agg(F.count("*").alias("n"))
    pairs, largest = (x or 0 for x in counts.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.max("n")).first())
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-pairs // PAIRS)))
    heavy = counts.filter(F.col("n") > most).select("d", F.ceil(F.col("n") / most).cast("int").alias("groups"))
    dealt = d.join(heavy, "d", "left").withColumn("groups", F.coalesce("groups", F.lit(1))) if largest > most else d.withColumn("groups", F.lit(1))
    groups = dealt.groupBy("d", "groups", F.pmod(F.xxhash64("c"), F.col("groups")).cast("int").alias("i")).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    met = groups.filter("groups = 1").select("cs", F.col("cs").alias("others"))
    if largest > most:
        several = groups.filter("groups > 1")
        other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
        left = several.select("d", "cs", "i", other.alias("j"))
        right = several.select("d", F.col("cs").alias("others"), F.col("i").alias("j"), other.alias("i"))
        met = met.unionByName(left.join(right, ["d", "i", "j"]).select("cs", "others"))
    met = met.select(F.explode("cs").alias("left"), "others").select("left", F.filter("others", lambda x: x > F.col("left")).alias("rights")).filter(F.size("rights") > 0)
    if whole:
        told = met.select("left", *_packed(F.col("rights"))).repartition(parts, "left").select("left", F.inline(F.arrays_zip("low", "mid", "high")))
        right = F.shiftleft("high", 24) + F.shiftleft((F.col("mid").cast("int") + 128).cast("long"), 16) + F.col("low").cast("int") + 32768
        told = told.select("left", right.alias("right"))
    else:
        told = met.repartition(parts, "left").select("left", F.explode("rights").alias("right"))
    out = told.groupBy("left", "right").agg(F.count("*").alias("shared"))
    return out.select(F.col("left").cast(kind).alias("left"), F.col("right").cast(kind).alias("right"), "shared")
