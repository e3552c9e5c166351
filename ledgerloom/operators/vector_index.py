"""An index of inverted lists for exact nearest neighbours: vectors by their nearest centre, and cells that the triangle inequality rules out are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import keep

#: Centres are a sample of the vectors: the root of their number, bounded so that all centres take at most this many bytes.
CENTRE_BYTES = 64 << 20
#: Vectors and queries that meet in a task.
ROWS, QUERIES = 4096, 1024
#: Components of vectors in a batch that a task gives back: 8 MB.
COMPONENTS = 1 << 20
#: More than rounding can change a distance or score by.
SLACK = 1e-7


@dataclass
class Index:
    """``rows`` (vec_id, unit, cell, far) and ``cells`` (cell, centre, radius, n): far is a vector's distance to its centre, radius the greatest one."""

    rows: DataFrame
    cells: DataFrame

    def save(self, folder: str) -> None:
        """Publish both tables; rows of one cell lie together."""
        self.rows.repartitionByRange("cell").sortWithinPartitions("cell", "far").write.mode("overwrite").parquet(f"{folder}/rows")
        self.cells.write.mode("overwrite").parquet(f"{folder}/cells")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        return Index(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/cells"))


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of those with so many components, all numbers, and a direction."""
    vectors = [(i, v) for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == dims and None not in v]
    at, x = np.array([i for i, _ in vectors], np.int64), np.array([v for _, v in vectors], np.float64).reshape(len(vectors), dims)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def _placed(shared, dims: int):
    """Unit vectors with their nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for b in batches:
            at, x = _units(b.column("embedding"), dims)
            cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for lo in range(0, len(x), ROWS):
                part = x[lo : lo + ROWS]
                cell[lo : lo + ROWS] = (part @ centres.T).argmax(axis=1)
                gap = part - centres[cell[lo : lo + ROWS]]
                far[lo : lo + ROWS] = np.sqrt((gap * gap).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), _lists(x), pa.array(cell), pa.array(far)], names=["vec_id", "unit", "cell", "far"])

    return run


def build(chunks: DataFrame, cells: int | None = None) -> Index:
    """An index over chunks (vec_id, embedding) of unique ids.

    Vectors that are null, have gaps, no direction, or another length than most have no place in it and are never found. Centres are those vectors whose ids have the least hashes;
    any choice gives exact results, a poor one reads more cells.
    """
    spark = chunks.sparkSession
    lengths = chunks.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    dims, n = (most["d"], most["n"]) if most else (0, 0)
    cells = max(1, min(cells or int(np.ceil(np.sqrt(n))), CENTRE_BYTES // (8 * max(dims, 1))))
    sample = chunks.filter(F.size("embedding") == dims).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select("embedding").toArrow()
    centres = np.unique(_units(sample.column("embedding"), dims)[1], axis=0)
    if not len(centres):
        centres = np.zeros((1, dims))
    kind = dict(chunks.dtypes)["vec_id"]
    rows = keep(chunks.select("vec_id", "embedding").mapInArrow(_placed(spark.sparkContext.broadcast(centres), dims), f"vec_id {kind}, unit array<double>, cell long, far double"))
    where = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(centres))), "centre": pa.array(list(centres), pa.list_(pa.float64()))}))
    about = rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    return Index(rows, where.join(about, "cell"))


def _asked(shared, dims: int, k: int, kind: pa.DataType, second: bool):
    """Cells that a query reads: first the nearest ones that hold k vectors; then all others that may hold one as near as the k-th found (``worst``, a distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, centres, radius, n = shared.value
        step = max(1, COMPONENTS // max(dims, 1))
        for b in batches:
            at, x = _units(b.column("q"), dims)
            ids = b.column("query_id")
            worst = b.column("worst").to_numpy(zero_copy_only=False)[at] if second else np.full(len(x), np.inf)
            for lo in range(0, len(x), 256):
                gap = np.sqrt(np.maximum(2 - 2 * (x[lo : lo + 256] @ centres.T), 0))
                order = np.argsort(gap, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                first = np.zeros(gap.shape, bool)
                np.put_along_axis(first, order, held - n[order] < k, axis=1)
                read = first if not second else ~first & (gap - radius[None, :] <= worst[lo : lo + 256, None] + SLACK)
                asking, asked = np.nonzero(read)
                for i in range(0, len(asking), step):  # a query may ask every cell
                    q, c = asking[i : i + step], asked[i : i + step]
                    row = q + lo
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[row])), _lists(x[row]), pa.array(cell[c], pa.int64()), pa.array(gap[q, c]), pa.array(worst[row])], names=["query_id", "q", "cell", "gap", "worst"])

    return run


def _scan(k: int, names: tuple[pa.DataType, pa.DataType]):
    """The k best of a cell's vectors for each query, and how many pairs were scored. Scores are summed alike for equal vectors; the matrix product only chooses."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if len(left) and len(right):
            q, x = (np.array(t.column(c).to_pylist()) for t, c in ((left, "q"), (right, "unit")))
            far, gap, worst = right.column("far").to_numpy(), left.column("gap").to_numpy(), left.column("worst").to_numpy()
            order = np.argsort(far)
            x, far, ids = x[order], far[order], np.array(right.column("vec_id").to_pylist())[order]
            near, lo, hi = q @ x.T, np.searchsorted(far, gap - worst - SLACK), np.searchsorted(far, gap + worst + SLACK, side="right")
            for i, key in enumerate(left.column("query_id").to_pylist()):
                mine = near[i, lo[i] : hi[i]]
                best = np.flatnonzero(mine >= np.partition(mine, len(mine) - k)[len(mine) - k] - SLACK) if len(mine) > k else np.arange(len(mine))
                best = best + lo[i]
                score = (x[best] * q[i]).sum(axis=1)
                top = np.lexsort((ids[best], -score))[:k]
                for column, values in zip(out, ([key] * len(top), ids[best[top]].tolist(), score[top].tolist(), [0] * len(top))):
                    column += values
                if len(top):
                    out[3][-1] = int(hi[i] - lo[i])
        return pa.table([pa.array(c, t) for c, t in zip(out, (*names, pa.float64(), pa.int64()))], names=["query_id", "vec_id", "score", "pairs"])

    return cell


def search(queries: DataFrame, index: Index, k: int, counted: bool = False) -> DataFrame:
    """(query_id, vec_id, rank, score): the k nearest vectors by cosine of each query (query_id, q), exactly; ties by id. ``counted``: (pairs,) that were scored, in place of them.

    Each query first reads the nearest cells that hold k vectors. The k-th best found is a bound: a cell is ruled out where the query's distance to the centre, less the radius, is above it, and so is,
    within a cell, a vector whose distance to the centre is too far from the query's. Cells of many vectors and many queries meet in blocks; centres (a bounded number) are
    sent to all tasks. Queries without a direction find nothing.
    """
    spark = queries.sparkSession
    told = index.cells.orderBy("cell").toArrow()
    dims = len(told.column("centre")[0]) if len(told) else 0
    centres = np.array(told.column("centre").to_pylist(), np.float64).reshape(len(told), dims)
    shared = spark.sparkContext.broadcast((told.column("cell").to_numpy(), centres, told.column("radius").to_numpy(), told.column("n").to_numpy()))
    asked = keep(queries.select("query_id", "q"))
    blocks = -(-max(asked.count(), 1) // QUERIES)
    kinds = dict(asked.dtypes)["query_id"], dict(index.rows.dtypes)["vec_id"]
    names = tuple(df.select(c).limit(0).toArrow().schema.field(0).type for df, c in ((asked, "query_id"), (index.rows, "vec_id")))
    parts = index.cells.select("cell", F.ceil(F.col("n") / ROWS).cast("int").alias("parts"))
    at = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n, c: F.explode(F.sequence(F.lit(0), n - 1)).alias(c)
    rows = index.rows.join(F.broadcast(parts), "cell").select("vec_id", "unit", "far", "cell", at("vec_id", F.col("parts")).alias("part"), every(F.lit(blocks), "block"))

    def scanned(q: DataFrame, second: bool) -> DataFrame:
        plan = q.mapInArrow(_asked(shared, dims, k, names[0], second), f"query_id {kinds[0]}, q array<double>, cell long, gap double, worst double")
        plan = plan.join(F.broadcast(parts), "cell").select("query_id", "q", "gap", "worst", "cell", at("query_id", F.lit(blocks)).alias("block"), every(F.col("parts"), "part"))
        key = ["cell", "part", "block"]
        return plan.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_scan(k, names), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double, pairs long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    first = keep(scanned(asked, False))
    kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
    bound = kth.select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("worst"))
    rest = asked.join(bound, "query_id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
    both = first.unionByName(scanned(rest, True))
    if counted:
        return both.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "score")
