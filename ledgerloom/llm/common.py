"""Helpers that the operators of this subpackage share: shared storage, components, and text as byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def unused(name: str, *tables: DataFrame) -> str:
    """The name, with as many further marks as it takes to be no column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint and the number of its rows, from one job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Connected components of an undirected graph as (id, component), component being the least id.

    Any orderable id type. Each round maps a vertex to its least neighbour, squares these steps until all end in local minima, and
    contracts the edges to these; steps grow with the logarithm of a chain's length. Only vertices with an edge to another vertex are returned; null ends are dropped.
    """
    rest, left = counted_cut(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct())
    out = rest.select(F.col("lo").alias("id"), F.col("hi").alias("component")).limit(0)
    first = True
    while left:
        near = rest.select(F.col("lo").alias("id"), F.col("hi").alias("to")).unionAll(rest.select(F.col("hi").alias("id"), F.col("lo").alias("to")))
        top = _tops(cut(near.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("up"))))
        if first:
            out, first = top.select("id", F.col("up").alias("component")), False
        else:
            out = cut(out.join(top.select(F.col("id").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        lo = top.select(F.col("id").alias("lo"), F.col("up").alias("lo2"))
        hi = top.select(F.col("id").alias("hi"), F.col("up").alias("hi2"))
        moved = rest.join(lo, "lo").join(hi, "hi").filter("lo2 <> hi2")
        rest, left = counted_cut(moved.select(F.least("lo2", "hi2").alias("lo"), F.greatest("lo2", "hi2").alias("hi")).distinct())
    return out


def _tops(step: DataFrame) -> DataFrame:
    """Where steps (id, up) from vertex to vertex end, those that stay at one place."""
    while True:
        seen = Observation()
        twice = step.join(step.select(F.col("id").alias("up"), F.col("up").alias("then")), "up").select("id", "up", "then")
        step = cut(twice.observe(seen, F.count(F.when(F.col("then") != F.col("up"), 1)).alias("moved")).select("id", F.col("then").alias("up")))
        if not seen.get["moved"]:
            return step


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back what memory a task has freed, as Python workers outlive tasks and the stages of a pipeline add up."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key counts as the text of a null-free empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def by_bytes(batch: pa.RecordBatch, column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about this many bytes of text; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def utf8_like(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8), offsets


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of True that lie within one row."""
    n = len(inside)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end]; equal ranges hash alike wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(MULTIPLIER, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(_BYTE[data], starts, ends)


#: ASCII upper case to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
