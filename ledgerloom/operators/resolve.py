"""Entity resolution: duplicate candidates and canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import contains, normalize_name, ratio_udf
from ledgerloom.operators import fuzzy
from ledgerloom.operators.graph import components, keep, roots
from ledgerloom.sources.schemas import CONTAINMENT, DUPLICATE_THRESHOLD, MERGE_THRESHOLD


def named(v: DataFrame, strip_dash: bool = False) -> DataFrame:
    """Vertices with their normalised names; those with none are left out, as they would lie within every other."""
    return v.withColumn("norm", normalize_name(F.col("name"), strip_dash)).filter("norm <> ''")


def exact_pairs(n: DataFrame) -> DataFrame:
    """Pairs of one type with equal normalised names."""
    return _pairs(n, n, ["type", "norm"]).withColumn("similarity", F.lit(1.0))


def _pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    left = a.select(*on, *(F.col(c).alias(c + "_a") for c in ("name", "degree", "seq")), *([] if "norm" in on else [F.col("norm").alias("norm_a")]))
    right = b.select(*on, *(F.col(c).alias(c + "_b") for c in ("name", "degree", "seq")), *([] if "norm" in on else [F.col("norm").alias("norm_b")]))
    return left.join(right, on).filter("seq_a < seq_b")


def candidate_pairs(n: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """(type, x, y): pairs of one type with different normalised names that may reach the threshold, from an index of rare tokens; names within others are found by a rare piece.

    A column ``side`` restricts the pairs: 1 and 2 for names of two sides that are to meet, 3 for both.
    """
    side = F.bit_or("side") if "side" in n.columns else F.lit(3)
    d = keep(n.groupBy("type", "norm").agg(side.cast("int").alias("side")))
    near = fuzzy.alike(d, threshold)
    if threshold <= CONTAINMENT:
        near = near.unionByName(contained_norms(d).select("type", F.least("short", "long").alias("x"), F.greatest("short", "long").alias("y"))).distinct()
    return near


def contained_norms(d: DataFrame) -> DataFrame:
    """(type, short, long): distinct normalised names of which one lies within the other."""
    return fuzzy.contained(d)


def scored_pairs(v: DataFrame, threshold: float = DUPLICATE_THRESHOLD, least: int = 1, strip_dash: bool = False) -> DataFrame:
    """(type, name_a, name_b, similarity, degree_a, degree_b) of pairs of one type whose score reaches the threshold; a is the one that appeared first."""
    n = named(v, strip_dash)
    found = candidate_pairs(n, threshold)
    left = n.select("type", F.col("norm").alias("x"), F.struct("seq", "name", "degree", "norm").alias("l"))
    right = n.select("type", F.col("norm").alias("y"), F.struct("seq", "name", "degree", "norm").alias("r"))
    p = found.join(left, ["type", "x"]).join(right, ["type", "y"])
    swap = F.col("l.seq") > F.col("r.seq")
    p = p.select("type", F.when(swap, F.col("r")).otherwise(F.col("l")).alias("a"), F.when(swap, F.col("l")).otherwise(F.col("r")).alias("b"))
    na, nb = F.col("a.norm"), F.col("b.norm")
    s = ratio_udf(na, nb)
    p = p.withColumn("s", s).withColumn("s", F.when(contains(na, nb, least), F.greatest("s", F.lit(CONTAINMENT))).otherwise(F.col("s"))).filter(F.col("s") >= threshold)
    fuzzy = p.select("type", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), F.bround("s", 3).alias("similarity"), F.col("a.degree").alias("degree_a"), F.col("b.degree").alias("degree_b"), F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"))
    exact = exact_pairs(n).select("type", "name_a", "name_b", "similarity", "degree_a", "degree_b", "seq_a", "seq_b")
    return exact.unionByName(fuzzy)


def duplicates(v: DataFrame, threshold: float = DUPLICATE_THRESHOLD, least: int = 1) -> DataFrame:
    return scored_pairs(v, threshold, least).orderBy(F.desc("similarity"), "seq_a", "seq_b").drop("seq_a", "seq_b")


def resolve_in_order(names: DataFrame, threshold: float = MERGE_THRESHOLD, compat: bool = False) -> DataFrame:
    """(type, name, canonical) as one pass over each type's names in the order of ``seq`` decides: an equal normalised name, else the first
    registered one whose score reaches the threshold, else a new entity.

    A registered name stands for what it was resolved to, so the pass is a forest: the parent of a normalised name is the earliest earlier one that it is alike to, and its
    canonical name is its root's. Parents come from the candidate pairs, roots by doubling steps; nothing goes name by name. ``compat``: names that normalise to nothing
    take part too, and then merge with anything.
    """
    kind = F.coalesce(F.concat(F.lit("="), F.col("type").cast("string")), F.lit("")).alias("kind")
    first = names.groupBy("type", "name").agg(F.min("seq").alias("seq")).select("type", "name", "seq", kind, normalize_name(F.col("name"), strip_dash=True).alias("norm"))
    known = first if compat else first.filter("norm <> ''")
    entries = keep(known.groupBy("kind", "norm").agg(F.min(F.struct("seq", "name")).alias("at")))
    parents = earliest(entries, threshold, compat)
    top = roots(parents.select(F.struct("kind", "norm").alias("id"), F.struct("kind", F.col("parent").alias("norm")).alias("up")))
    top = top.select(F.col("id.kind").alias("kind"), F.col("id.norm").alias("norm"), F.col("up.norm").alias("root"))
    told = entries.join(top, ["kind", "norm"], "left").select("kind", "norm", F.coalesce("root", "norm").alias("root"))
    told = told.join(entries.select("kind", F.col("norm").alias("root"), F.col("at.name").alias("canonical")), ["kind", "root"])
    return first.join(told, ["kind", "norm"], "left").select("type", "name", F.coalesce("canonical", "name").alias("canonical"))


def earliest(entries: DataFrame, threshold: float = MERGE_THRESHOLD, compat: bool = False) -> DataFrame:
    """(kind, norm, parent): the earliest earlier name of the kind whose score reaches the threshold; ``at`` orders names. Those without one have no row."""
    pairs = candidate_pairs(entries.filter("norm <> ''").select(F.col("kind").alias("type"), "norm", *(c for c in entries.columns if c == "side")), threshold)
    side = lambda c: entries.select(F.col("kind").alias("type"), F.col("norm").alias(c), F.col("at").alias("at_" + c))
    p = pairs.join(side("x"), ["type", "x"]).join(side("y"), ["type", "y"])
    before = F.col("at_x") < F.col("at_y")
    p = p.select(F.col("type").alias("kind"), *(F.when(before, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("y", "x", "norm"), ("x", "y", "old"), ("at_x", "at_y", "old_at"))))
    s = ratio_udf(F.col("norm"), F.col("old"))
    p = p.withColumn("s", F.when(contains(F.col("norm"), F.col("old")), F.greatest(s, F.lit(CONTAINMENT))).otherwise(s)).filter(F.col("s") >= threshold).drop("s")
    if compat and threshold <= CONTAINMENT:  # nothing lies within every name
        empty = entries.filter("norm = ''").select("kind", F.col("at").alias("old_at"))
        after = entries.filter("norm <> ''").join(empty, "kind").filter(F.col("at") > F.col("old_at")).select("kind", "norm", F.lit("").alias("old"), "old_at")
        start = entries.groupBy("kind").agg(F.min_by("norm", "at").alias("old"), F.min("at").alias("first"))
        own = empty.join(start, "kind").filter(F.col("first") < F.col("old_at")).select("kind", F.lit("").alias("norm"), "old", F.col("first").alias("old_at"))
        p = p.unionByName(after).unionByName(own)
    return p.groupBy("kind", "norm").agg(F.min_by("old", "old_at").alias("parent"))


def resolve_by_links(names: DataFrame, threshold: float = MERGE_THRESHOLD, least: int = 1) -> DataFrame:
    """(type, name, canonical) by components of the links at the threshold, independent of order but for the canonical name: the first of its component.

    Nothing is sequential here. Chains merge where one pass in order might not.
    """
    first = names.groupBy("type", "name").agg(F.min("seq").alias("seq"))
    v = keep(first.withColumn("degree", F.lit(0)))
    links = scored_pairs(v, threshold, least, strip_dash=True)
    tag = lambda n: F.concat_ws("\u0001", "type", n)
    c = components(v.select(tag(F.col("name")).alias("name")), links.select(tag(F.col("name_a")).alias("source"), tag(F.col("name_b")).alias("target")))
    member = v.withColumn("id", tag(F.col("name"))).join(c.withColumnRenamed("name", "id"), "id")
    canonical = member.groupBy("component").agg(F.min_by("name", F.struct("seq", "name")).alias("canonical"))
    return member.join(canonical, "component").select("type", "name", "canonical")


def ambiguous(references: DataFrame, documents: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Fuzzy matches of references' titles to documents of the same revision: (ref, title, best, similarity, verdict). Several best ones, or none, go to review; nothing is matched by itself."""
    r = references.select("ref", "revision", normalize_name(F.col("title")).alias("x")).filter("x <> ''")
    d = documents.select("revision", normalize_name(F.col("title")).alias("y"), F.col("title").alias("found")).filter("y <> ''").distinct()
    asked, there = keep(r.select("revision", "x").distinct()), keep(d.select("revision", "y").distinct())
    sides = asked.select("revision", F.col("x").alias("norm"), F.lit(1).alias("side")).unionAll(there.select("revision", "y", F.lit(2)))
    both = keep(sides.groupBy(F.col("revision").cast("string").alias("type"), "norm").agg(F.bit_or("side").alias("side")))
    near = fuzzy.alike(both, threshold)
    if threshold <= CONTAINMENT:
        near = near.unionByName(fuzzy.contained(both).select("type", F.least("short", "long").alias("x"), F.greatest("short", "long").alias("y"))).distinct()
    same = both.filter("side = 3").select("type", F.col("norm").alias("x"), F.col("norm").alias("y"))
    either = near.unionByName(near.select("type", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(same)
    kind = F.col("revision").cast("string").alias("type")
    pairs = either.join(asked.select("revision", kind, "x"), ["type", "x"]).join(there.select(kind, "y"), ["type", "y"]).select("revision", "x", "y")
    s = ratio_udf(F.col("x"), F.col("y"))
    pairs = pairs.withColumn("s", F.when(F.col("x") == F.col("y"), 1.0).when(contains(F.col("x"), F.col("y")), F.greatest(s, F.lit(CONTAINMENT))).otherwise(s)).filter(F.col("s") >= threshold)
    full = r.join(pairs, ["revision", "x"], "left").join(d, ["revision", "y"], "left")
    best = full.groupBy("ref").agg(F.max("s").alias("best"))
    ties = full.join(best, "ref").filter("s = best or best is null").groupBy("ref").agg(F.bround(F.max("s"), 3).alias("similarity"), F.count("found").alias("n"), F.min("found").alias("title"))
    return ties.select("ref", "similarity", F.col("n").alias("candidates"), F.when(F.col("n") == 1, F.col("title")).alias("title"), F.when(F.col("n") == 1, "suggest").otherwise("review").alias("verdict"))
