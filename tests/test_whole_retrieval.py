"""Searches for all queries against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval
from ledgerloom.plans import catalog


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def vectors(n):
    r = random.Random(3)
    return [(i, f"l{i % 3}", [float(r.randrange(-4, 5)) + 0.5 for _ in range(6)]) for i in range(n)]


def best(rows, k, same):
    out = set()
    for i, own, q in rows:
        if i % 20 == 0:
            near = sorted((-round(cosine(q, v), 12), j) for j, label, v in rows if not same or label == own)
            out |= {(i, j, rank) for rank, (_, j) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize(("name", "k", "same"), [("vector_topk_whole", 8, True), ("vector_topk_all_whole", 10, False)])
def test_every_twentieth_row_asks(spark, tmp_path, name, k, same):
    rows = vectors(130)
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"], r["rank"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == best(rows, k, same) and len({q for q, *_ in got}) == 7


def test_blocks_do_as_one_scan(spark):
    rows = [*vectors(90), (90, "l0", [1.0, 2.0]), (91, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    q = df.filter("vec_id % 5 = 0 or vec_id = 91").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"), F.col("embedding").alias("q"))
    take = lambda d: sorted((r["query_id"], r["rank"], r["vec_id"], None if r["score"] is None else round(r["score"], 9)) for r in d.collect())
    small = {"block": 4, "slice_": 5}
    assert take(retrieval.topk_blocks(q, df, 92, **small)) == take(retrieval.topk(q, df, 92))
    assert take(retrieval.topk_blocks(q, df, 7, ("asked", "label"), **small)) == take(retrieval.topk(q, df, 7, F.col("label") == F.col("asked")))
    assert retrieval.topk_blocks(q.limit(0), df, 3).count() == 0 and retrieval.topk_blocks(q, df.limit(0), 3).count() == 0
