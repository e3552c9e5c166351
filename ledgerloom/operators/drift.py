"""Drift of a measure between periods: quantile sketches that merge, and population stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 10
#: Quantiles of a sketch that are compared with the edges of bins.
GRID = 200
#: The least share of a bin, so that an empty one has a logarithm.
LEAST = 1e-4
#: Usual readings of population stability: up to the first there is no drift, above the second it is plain.
WATCH, ALARM = 0.1, 0.25


def sketches(rows: DataFrame, by: list[str], period: Column, value: str) -> DataFrame:
    """(by…, period, n, sketch): a quantile sketch of bounded size for each group and period. Values that are null or no number are left out."""
    v = F.col(value).cast("double")
    good = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*by, period.alias("period"), v.alias("v"))
    return good.groupBy(*by, "period").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v").alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the same groups and periods, from several runs or of finer groups, as one each."""
    return parts.groupBy(*by, "period").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def stability(sketched: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """(by…, period, before, n, stability, verdict) of each period against the one before it that has values.

    Bins are quantiles of the period before; the stability index is the sum over bins of (a - e) ln(a / e), of the shares now and before. Only sketches are read, so what a period held
    need not be read again. The first period of a group has nothing to be compared with and no row.
    """
    w = Window.partitionBy(*by).orderBy("period") if by else Window.orderBy("period")  # a row for each group and period
    s = sketched.select(*by, "period", "n", "sketch", F.lag("period").over(w).alias("before"), F.lag("sketch").over(w).alias("base")).filter("base is not null")
    fine = F.array(*(F.lit(i / GRID) for i in range(1, GRID)))  # the sketch's functions take constants only
    s = s.withColumns({"now": F.kll_sketch_get_quantile_double("sketch", fine), "was": F.kll_sketch_get_quantile_double("base", fine)})
    edges = F.array_distinct(F.transform(F.array(*(F.lit(GRID * i // bins) for i in range(1, bins))), lambda i: F.element_at("was", i)))
    rank = lambda grid: F.transform("edges", lambda e: F.size(F.filter(grid, lambda x: x <= e)) / F.lit(float(GRID)))
    s = s.withColumn("edges", edges).withColumns({"was": rank("was"), "now": rank("now")})
    share = lambda ranks: F.zip_with(F.concat(ranks, F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), ranks), lambda hi, lo: F.greatest(hi - lo, F.lit(LEAST)))
    terms = F.zip_with(share(F.col("now")), share(F.col("was")), lambda a, e: (a - e) * F.ln(a / e))
    s = s.withColumn("stability", F.aggregate(terms, F.lit(0.0), lambda x, y: x + y))
    verdict = F.when(F.col("stability") > ALARM, "drift").when(F.col("stability") > WATCH, "watch").otherwise("stable")
    return s.select(*by, "period", "before", "n", F.round("stability", 6).alias("stability"), verdict.alias("verdict"))
