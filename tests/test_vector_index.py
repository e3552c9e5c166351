"""The vector index against a scan of all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.operators import vector_index as vi


def scan(q, x, k):
    unit = lambda a: a / np.sqrt((a * a).sum(axis=1, keepdims=True))
    out = {}
    for i, s in enumerate((unit(q)[:, None, :] * unit(x)[None, :, :]).sum(axis=2)):
        out[i] = [(int(j), round(float(s[j]), 9)) for j in np.lexsort((np.arange(len(x)), -s))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    return out


def table(spark, x, names="vec_id int, embedding array<double>"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], names).repartition(3)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_exact_and_fewer_pairs(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(vi, "ROWS", 40)
    monkeypatch.setattr(vi, "QUERIES", 7)
    r = np.random.default_rng(3)
    middle = r.normal(size=(12, 8))
    x = middle[r.integers(0, 12, 600)] + spread * r.normal(size=(600, 8))
    x[100:110] = x[5]  # ties
    q = x[::20] * 3
    vi.build(table(spark, x)).save(str(tmp_path / "i"))
    index = vi.Index.load(spark, str(tmp_path / "i"))
    queries = table(spark, q, "query_id int, q array<double>")
    assert found(vi.search(queries, index, 7)) == scan(q, x, 7)
    pairs = vi.search(queries, index, 7, counted=True).first()[0]
    assert pairs < 600 * len(q) * (0.5 if spread < 1 else 1.01)


@pytest.mark.parametrize("second", [False, True])
def test_asked_cells_come_in_bounded_batches(monkeypatch, second):
    """Where vectors are spread evenly every query asks every cell: a batch of queries must not become one batch of them all."""
    monkeypatch.setattr(vi, "COMPONENTS", 400, raising=False)
    r = np.random.default_rng(2)
    x, centres = r.normal(size=(600, 8)), r.normal(size=(40, 8))
    centres /= np.sqrt((centres * centres).sum(axis=1, keepdims=True))

    class Shared:
        value = (np.arange(40) + 5, centres, np.full(40, 2.0), np.full(40, 3))

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array(list(x)), pa.array(np.full(600, 2.0))], names=["query_id", "q", "worst"])
    out = list(vi._asked(Shared, 8, 7, pa.int64(), second)(iter([batch])))
    assert max(b.num_rows for b in out) <= 50
    got = pa.Table.from_batches(out)
    pairs = list(zip(got.column("query_id").to_pylist(), got.column("cell").to_pylist()))
    assert len(pairs) == len(set(pairs)) == 600 * (37 if second else 3)
    for i in range(0, len(pairs), 97):
        q, c = got.column("q")[i].as_py(), centres[pairs[i][1] - 5]
        assert np.allclose(q, x[pairs[i][0]] / np.sqrt((x[pairs[i][0]] ** 2).sum())) and np.isclose(got.column("gap")[i].as_py(), np.sqrt(((q - c) ** 2).sum()))


def test_odd_vectors(spark):
    kinds, asks = "vec_id int, embedding array<double>", "query_id int, q array<double>"
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, [float("nan"), 1.0]), (8, [-1e200, 1e200])]
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], asks)
    got = found(vi.search(queries, vi.build(spark.createDataFrame(rows, kinds)), 5))
    assert got == {1: [(1, 1.0), (2, 1.0), (8, round(-(0.5**0.5), 9))]}
    empty = vi.build(spark.createDataFrame([], kinds))
    assert vi.search(queries, empty, 3).collect() == []
    assert vi.search(queries.limit(0), vi.build(spark.createDataFrame(rows, kinds)), 3).collect() == []
