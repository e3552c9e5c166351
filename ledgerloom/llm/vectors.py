"""Near-duplicate embeddings by collision-counting projections.

Vectors are projected on many random directions. Two vectors collide on a direction if one's projection lies in the window centred on
the other's; vectors at the threshold's distance collide on a known share of directions, so a pair is verified, by its exact cosine in
double precision, if it collides on at least as many of the counting directions as all but a share ``miss`` of such pairs do (a binomial quantile).

Counting all pairs would be quadratic. So pairs are counted only where several leading directions' sorted projections put them in one run: each of
T tables cuts ``c`` leading directions' orders into stretches at random offsets, and rows with the same stretches meet. c grows with the logarithm of the number
of vectors and with how close unrelated ones are, by the distances in a sample of SAMPLE vectors, and T is calibrated so that a pair at the threshold meets in some table with probability 1 - ``miss``. A pair is counted in the
first table where it meets only.

Equal vectors are one class with a weight. Groups are read as a sorted stream; those over ``BLOCK`` rows are split into blocks and pairs of
blocks. A block gives, for each row with links, their number and one edge to the least id of its component within the block, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, cut, mixed

BLOCK = 1024
#: Widths of stretches of leading directions, and half the width of windows of counting directions, in standard deviations of random unit vectors' projections.
STRETCH, WINDOW, COUNTING = 1.6, 0.5, 16
#: Vectors whose distances the tables are calibrated by, and how many comparisons a vector's copy in one more table is worth.
SAMPLE, COPY = 1024, 700
_SPLIT_BROADCAST = 100_000


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _staying(distances: np.ndarray) -> np.ndarray:
    """The probability that two vectors at a distance lie within one stretch of a direction: E max(0, 1 - |N(0, d)| / STRETCH)."""
    grid = np.linspace(-8, 8, 4001)
    weight = np.exp(-grid**2 / 2)
    known = np.linspace(0, 2, 201)
    share = [float((np.maximum(0, 1 - np.abs(grid) * d / STRETCH) * weight).sum() / weight.sum()) for d in known]
    return np.interp(distances, known, share)


def calibrate(n: int, threshold: float, miss: float, apart: np.ndarray | None = None) -> tuple[int, int, int]:
    """(directions per table, tables, collisions needed) for n vectors, of which pairs are as far ``apart`` as those of a sample; without one, as random directions.

    More directions leave fewer pairs that meet by chance, but take more tables, and so copies, to find all links: their number is the one of least cost, a copy counted as COPY pairs.
    """
    near = math.sqrt(2 - 2 * threshold)
    apart = np.array([math.sqrt(2)]) if apart is None else apart[apart > near]
    stay, close = _staying(apart), float(_staying(np.array([near]))[0])
    tables_for = lambda c: math.ceil(math.log(miss) / math.log(1 - close**c))
    chance = lambda c: float((stay**c).mean()) if len(stay) else 0.0
    c = min(range(2, 25), key=lambda c: tables_for(c) * (COPY + n * chance(c)))
    p = 2 * _phi(WINDOW / near) - 1
    below, need = 0.0, 0
    for k in range(COUNTING + 1):
        below += math.comb(COUNTING, k) * p**k * (1 - p) ** (COUNTING - k)
        if below > miss:
            need = k
            break
    return c, tables_for(c), need


def _distances(sample: DataFrame) -> np.ndarray | None:
    """Distances between the unit vectors of a bounded sample, of those of one length."""
    rows = sample.toArrow().column("v").combine_chunks()
    sizes = np.asarray(rows.value_lengths())
    found = []
    for d in np.unique(sizes).tolist():
        x = _unit(_matrix(rows.take(pa.array(np.flatnonzero(sizes == d)))))
        i, j = np.triu_indices(len(x), 1)
        found.append(np.sqrt(np.maximum(2 - 2 * (x @ x.T)[i, j], 0)))
    return np.concatenate(found) if found and sum(map(len, found)) else None


class _Directions:
    def __init__(self, dims: int, c: int, tables: int, seed: int):
        r = np.random.default_rng([seed, dims])
        self.c, self.tables = c, tables
        self.lead = r.normal(size=(dims, c * tables))
        self.offset = r.random(c * tables) * STRETCH
        self.count = r.normal(size=(dims, COUNTING))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The group of each row in each table."""
        cell = np.floor((x @ self.lead + self.offset) / STRETCH).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.c)
        out = np.full((len(x), self.tables), x.shape[1], np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(self.c):
            out = mixed(out + cell[:, :, k])
        return out.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, as squares of very large or small components are out of a double's range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(c: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, _Directions] = {}
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                sizes = np.asarray(batch.column("v").value_lengths())
                for d in np.unique(sizes).tolist():
                    pick = np.flatnonzero(sizes == d)
                    part = batch.take(pa.array(pick))
                    x = _unit(_matrix(part.column("v")))
                    keys = made.setdefault(d, _Directions(d, c, tables, seed)).keys(x)
                    take = pa.array(np.repeat(np.arange(len(pick)), tables))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(pick))), pa.array(keys.ravel()), *(part.column(n).take(take) for n in ("rep", "w", "v"))], names=["t", "key", "rep", "w", "v"])

    return run


def _local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _count(c: int, tables: int, need: int, threshold: float, seed: int):
    made: dict[int, _Directions] = {}

    def links(x: np.ndarray, t: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one group that are links and meet in no earlier table; with sides, pairs across them only."""
        d = made.setdefault(x.shape[1], _Directions(x.shape[1], c, tables, seed))
        p = (x @ d.count).astype(np.float32)
        a, b = (np.arange(len(x)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        hits = np.zeros((len(a), len(b)), np.int8)
        for k in range(COUNTING):
            hits += np.abs(p[a, k][:, None] - p[b, k][None, :]) <= WINDOW
        i, j = np.nonzero(hits >= need)
        i, j = a[i], b[j]
        if side is None:
            i, j = i[i < j], j[i < j]
        near = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, max(1, len(i)), 65536)]) >= threshold
        i, j = i[near], j[near]
        if t and len(i):
            keys = d.keys(x)[:, :t]
            first = ~(keys[i] == keys[j]).any(axis=1)
            i, j = i[first], j[first]
        return i, j

    def group(t: int, x: np.ndarray, rep: list, w: np.ndarray, side: np.ndarray | None) -> tuple[list, np.ndarray, list]:
        i, j = links(x, t, side)
        n = np.bincount(i, w[j], len(x)) + np.bincount(j, w[i], len(x))
        label = _local_components(len(x), i, j)
        at = np.flatnonzero(n > 0)
        # The least id of a component, ids being of any type.
        least: dict[int, object] = {}
        for k in at.tolist():
            c_ = int(label[k])
            least[c_] = min(least.get(c_, rep[k]), rep[k])
        return [rep[k] for k in at.tolist()], n[at].astype(np.int64), [least[int(label[k])] for k in at.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kind = None

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """All groups of a table of sorted rows."""
            table = table.combine_chunks()
            code = [table.column(n).to_numpy() for n in ("t", "key", "one", "two")]
            new = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([v[1:] != v[:-1] for v in code]))))
            ends = np.append(new[1:], len(table))
            keep = [(a, b) for a, b in zip(new.tolist(), ends.tolist()) if b - a > 1]
            if not keep:
                return
            column = table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v")
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            reps, ws, sides = table.column("rep").to_pylist(), table.column("w").to_numpy(), table.column("side").to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for a, b in keep:
                x = _unit(_matrix(column.slice(a, b - a)))
                ids, n, least = group(int(code[0][a]), x, reps[a:b], ws[a:b], sides[a:b] if code[2][a] != code[3][a] else None)
                out[0].extend(ids)
                out[1].extend(n.tolist())
                out[2].extend(least)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names=["rep", "n", "least"])

        for batch in batches:
            if not len(batch):
                continue
            kind = batch.schema.field("rep").type
            held.append(batch)
            last = [batch.column(n)[len(batch) - 1].as_py() for n in ("t", "key", "one", "two")]
            start = len(batch)
            columns = [batch.column(n).to_numpy() for n in ("t", "key", "one", "two")]
            while start and all(int(v[start - 1]) == x for v, x in zip(columns, last)):
                start -= 1
            if start:
                yield from finish(pa.Table.from_batches([*held[:-1], batch.slice(0, start)]))
                held = [batch.slice(start)]
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run


def near_duplicates(vectors: DataFrame, key: str, vector: str, threshold: float = 0.95, miss: float = 0.01, seed: int = 3) -> DataFrame:
    """One row per row: id, n_links (other rows of cosine ``threshold`` or more that were found), component_id (least id reachable by links), kept.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; nor do vectors of different lengths with each other. Equal
    vectors always link. A null id links with nothing and has a null component. Rows that repeat an id count as rows of their own.
    Other columns are ignored, and an empty table gives an empty result.
    """
    kind = vectors.schema[key].dataType.simpleString()
    # Floats are doubles without loss; anything else is read as doubles.
    element = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    base = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{element}>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    plain = F.transform("v", lambda e: e + F.lit(0.0).cast(element))  # -0.0 to 0.0
    base = base.withColumn("v", F.when(sound, plain)).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    names = base.select("id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2"))
    classes = cut(base.filter("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")))
    sample = classes.orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(SAMPLE).select("v")
    c, tables, need = calibrate(classes.count(), threshold, miss, _distances(sample))
    # A class is named by its least id; rows that repeat an id with different vectors share a name, and so their links.
    keyed = classes.select("rep", "w", "v").mapInArrow(_spread(c, tables, seed), f"t int, key long, rep {kind}, w long, v array<{element}>")
    sizes = classes.select("rep", "w", "v").mapInArrow(_spread(c, tables, seed), f"t int, key long, rep {kind}, w long, v array<{element}>").groupBy("t", "key").count().filter("count > 1")
    large = cut(sizes.filter(f"count > {BLOCK}").select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    few = large.count() <= _SPLIT_BROADCAST
    split = keyed.join(F.broadcast(large) if few else large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("t", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "w", "v")
    found = split.repartition("t", "key", "one", "two").sortWithinPartitions("t", "key", "one", "two").mapInArrow(_count(c, tables, need, threshold, seed), f"rep {kind}, n long, least {kind}")
    found = cut(found)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select("rep", "least").distinct(), "rep", "least")
    told = classes.select("h1", "h2", "rep", "w").join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = names.join(told, ["h1", "h2"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
