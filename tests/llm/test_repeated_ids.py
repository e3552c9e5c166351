"""Tables whose ids repeat or are null."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import jaccard


def words(seed, n=60):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_deduplicate_ids_that_repeat(spark):
    a, b, c, d = (words(i) for i in range(4))
    near = lambda w, i: " ".join([*w[:-1], f"end{i}"])
    rows = [
        (1, near(a, 1), "x"), (2, near(a, 2), "linked with 1"), (2, near(b, 0), "alone, id repeats"), (3, near(c, 1), "y"), (3, near(c, 2), "linked with the other 3"),
        (4, near(d, 1), "z"), (5, near(d, 2), "linked with 4"), (6, "", "empty"), (6, "", "empty again"), (6, None, "null"), (None, near(a, 3), "no id"),
    ]
    df = spark.createDataFrame(rows, "k int, t string, note string")
    got = sorted((r["k"] or 0, r["t"] or "") for r in jaccard.deduplicate(df, "k", "t").collect())
    threes = [x for x in got if x[0] == 3]
    assert len(threes) == 1 and threes[0][1] in {near(c, 1), near(c, 2)}
    assert [x for x in got if x[0] != 3] == sorted([(1, near(a, 1)), (2, near(b, 0)), (4, near(d, 1)), (6, ""), (6, ""), (0, near(a, 3))])


def test_a_set_is_signed_by_a_row_with_an_id():
    batch = pa.RecordBatch.from_arrays([pa.array([None, 7, 8], pa.int64())], names=["id"])
    names = np.zeros((3, 2), np.uint64)
    assert jaccard._first_seen(batch, names, set()).tolist() == [False, True, False]


def test_null_ids_in_front_of_a_large_group(spark):
    base = words(11, 400)
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(80)]
    rows = [(None, t) for t in texts] + list(enumerate(texts))
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    got = {r["id"]: r["component_id"] for r in jaccard.near_duplicates(df, "k", "t").collect()}
    assert got == {None: None} | dict.fromkeys(range(80), 0)
