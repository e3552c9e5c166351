"""Drift, typed leaves, running sums and shared references."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import typed
from ledgerloom.operators import drift, references, summary


def test_a_planted_shift_is_found(spark):
    r = random.Random(1)
    rows = []
    for week in range(4):
        for _ in range(1500):
            rows.append(("calm", week, r.gauss(10, 2)))
            rows.append(("moved", week, r.gauss(10, 2) + (4 if week >= 2 else 0)))
            rows.append(("few kinds", week, float(r.choice([1, 1, 2]))))
    rows += [("calm", 1, None), ("calm", 1, float("nan")), ("new", 3, 1.0)]
    df = spark.createDataFrame(rows, "kind string, week int, v double").repartition(4)
    s = drift.sketches(df, ["kind"], F.col("week"), "v")
    got = {(x["kind"], x["period"]): (x["before"], x["n"], x["verdict"]) for x in drift.stability(s, ["kind"]).collect()}
    assert got.pop(("moved", 2)) == (1, 1500, "drift") and len(got) == 8
    assert {v[2] for v in got.values()} == {"stable"} and got["calm", 1][1] == 1500
    halves = [drift.sketches(df.filter(F.col("v") > 10 if k else F.col("v") <= 10), ["kind"], F.col("week"), "v") for k in (0, 1)]
    again = {(x["kind"], x["period"]): x["verdict"] for x in drift.stability(drift.merged(halves[0].unionByName(halves[1]), ["kind"]), ["kind"]).collect()}
    assert again == {k: v[2] for k, v in got.items()} | {("moved", 2): "drift"}
    assert drift.stability(drift.sketches(df.limit(0), [], F.col("week"), "v"), []).collect() == []


def test_typed_leaves(spark):
    money = {"$1,234.50": "1234.50", "USD 12": "12.00", "12 eur": "12.00", "(3.10)": "-3.10", "-4": "-4.00", "about $5": None, "": None, None: None, "1.2.3": None, "9" * 40: None, "€7": "7.00"}
    dates = {"2024-01-31": dt.date(2024, 1, 31), "1/31/2024": dt.date(2024, 1, 31), "31 January 2024": dt.date(2024, 1, 31), "January 31, 2024": dt.date(2024, 1, 31), "2024-13-01": None, "soon": None, None: None}
    got = spark.createDataFrame([(k,) for k in money], "t string").select("t", typed.money(F.col("t")).alias("v"), typed.bad(F.col("t"), typed.money(F.col("t"))).alias("b")).collect()
    assert {r["t"]: r["v"] for r in got} == {k: None if v is None else Decimal(v) for k, v in money.items()}
    assert {r["t"] for r in got if r["b"]} == {"about $5", "1.2.3", "9" * 40}
    got = spark.createDataFrame([(k,) for k in dates], "t string").select("t", typed.date(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == dates
    docs = ['{"a": {"n": 5, "s": "x"}}', '{"a": {"n": "five"}}', "{broken", None, "[]"]
    v = spark.createDataFrame([(d,) for d in docs], "p string").select(typed.variant(F.col("p")).alias("v"))
    assert [r[0] for r in v.select(typed.leaf(F.col("v"), "$.a.n", "int")).collect()] == [5, None, None, None, None]
    assert [r[0] for r in v.select(typed.leaf(F.col("v"), "$.a.s")).collect()] == ["x", None, None, None, None]


@pytest.mark.parametrize("parts", [1, 5])
def test_running_sums(spark, parts):
    r = random.Random(parts)
    rows = [(i, r.choice([None, *range(5)]), "x" * (i % 3)) for i in range(300)]
    r.shuffle(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "`a b` int, n int, `n.t` string").repartition(3)
        out = summary.running(df, [F.desc("`a b`")], "n", "before")
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
        got = {x["a b"]: x["before"] for x in out.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    total, want = 0, {}
    for i, n, _ in sorted(rows, reverse=True):
        want[i] = total
        total += n or 0
    assert got == want
    assert summary.running(df.limit(0), [F.asc("n")], "n", "before").collect() == []


@pytest.mark.parametrize("most", [1024, 3])
def test_shared_references_of_frequent_documents(spark, most):
    r = random.Random(most)
    links = [(r.randrange(40), r.choice(["hot", "hot", *"abcdefgh", None])) for _ in range(300)] + [(i, "all") for i in range(40)] + [(None, "all")]
    held = {}
    for c, d in links:
        if c is not None and d is not None:
            held.setdefault(d, set()).add(c)
    want = Counter(p for members in held.values() for p in combinations(sorted(members), 2))
    got = {(x["left"], x["right"]): x["shared"] for x in references.sharing_pairs(spark.createDataFrame(links, "c int, d string"), "c", "d", most).collect()}
    assert got == want
