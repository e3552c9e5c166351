"""As-of join: each row of one table with the version that was current at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(events: DataFrame, versions: DataFrame, on: list[str], at: str, since: str, take: list[str], order: list[str] | None = None, days: int = 30) -> DataFrame:
    """``events`` with the columns ``take`` of the last version of the same keys whose ``since`` is not after ``at``; nulls where there is none.

    Versions of one time are ordered by ``order``, else by ``take``, and the last counts. Events without a time or a key have no version; versions without one are never
    current. All events stay, repeated ones too. No column of ``events`` may be called as one of ``take``.

    Both sides are dealt by keys and stretches of ``days``. A key's last version in each stretch is carried on to the next ones in a small table of stretches, so a
    key with a long history is split over tasks, and within a stretch one window over the union of both sides finds each event's version. A key whose rows crowd in one stretch
    wants shorter ones.
    """
    clash = set(take) & set(events.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    kept = [f"e{i}" for i in range(len(events.columns))]
    keys = [f"k{i}" for i in range(len(on))]
    of = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / F.lit(days * 86_400))
    value = F.struct(*(versions[c] for c in take))
    v = versions.filter(versions[since].isNotNull()).dropna(subset=on)
    v = v.select(*(v[c].alias(k) for c, k in zip(on, keys)), of(v[since]).alias("stretch"), F.struct(v[since].cast("timestamp").alias("t"), F.lit(0).alias("side"), F.struct(*(v[c] for c in order or take)).alias("o")).alias("place"), value.alias("value"))
    last = v.groupBy(*keys, "stretch").agg(F.max_by("value", "place").alias("value"))
    e = events.select(*(events[c].alias(k) for c, k in zip(on, keys)), of(events[at]).alias("stretch"), events[at].cast("timestamp").alias("t"), *(events[c].alias(k) for c, k in zip(events.columns, kept)))
    stretches = e.select(*keys, "stretch").distinct().join(last, [*keys, "stretch"], "full")
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(*keys, "stretch", F.last("value", ignorenulls=True).over(before).alias("carried"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    order_type = v.schema["place"].dataType["o"].dataType
    both = e.select(*keys, "stretch", F.struct("t", F.lit(1).alias("side"), F.lit(None).cast(order_type).alias("o")).alias("place"), none(v, "value"), *kept)
    both = both.unionByName(v.select(*keys, "stretch", "place", "value", *(none(e, c) for c in kept)))
    now = Window.partitionBy(*keys, "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("value", F.last("value", ignorenulls=True).over(now)).filter(F.col("place.side") == 1)
    found = found.join(carried, [*keys, "stretch"], "left").withColumn("value", F.coalesce("value", "carried"))
    return found.select(*(F.col(k).alias(c) for c, k in zip(events.columns, kept)), *(F.col("value")[c].alias(c) for c in take))
