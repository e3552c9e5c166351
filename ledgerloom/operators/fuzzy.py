"""Pairs of alike names of one type by an inverted index of rare tokens; no pair that may reach the threshold is lost.

A ratio of t over names of a and b characters needs M >= t (a + b) / 2 matched characters. What is matched falls into at most a + b - 2 M + 1 blocks, so at least
3 M - (a + b) - 1 pairs of adjoining characters are in both names, repeats counted. Names whose sets of numbered tokens share at least c of n tokens share one of the first
n - c + 1 in any common order; the order is from rare to frequent, so few names meet. Where c is not positive (names of a few characters, or a low threshold), single
characters are the tokens, of which M are shared. Names that meet are compared by lengths and by parities of their tokens, many at a time, before a pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells in which tokens are counted; the table of counts has this size whatever the input.
CELLS = 1 << 16
#: Names of one token that meet in a task; more are dealt to pairs of groups.
GROUP = 4096
#: Names of a group that are compared at a time.
ROWS = 256
#: Words of 64 bits for parities of single characters and of pairs of characters.
WORDS = (2, 6)
#: Lengths of the pieces by which a name that lies within another is found.
PIECES = (1, 3, 6)

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def matched(total: np.ndarray | int, threshold: float) -> np.ndarray:
    """The least number of matched characters with which names of so many characters together reach the threshold."""
    return np.ceil(np.asarray(total) * threshold / 2 - 1e-9).astype(np.int64)


def shared_pairs(total: np.ndarray | int, threshold: float) -> np.ndarray:
    """The pairs of adjoining characters that such names share at least; not positive where none is sure."""
    return 3 * matched(total, threshold) - np.asarray(total) - 1


@lru_cache(maxsize=4096)
def _needs(n: int, threshold: float) -> tuple[int, int]:
    """What a name of n characters shares at least with any partner that it may have: pairs of characters, and characters where no pair is sure; 0 where there is no such partner."""
    other = np.arange(max(1, int(np.floor(n * threshold / (2 - threshold)))), int(np.ceil(n * (2 - threshold) / threshold)) + 1)
    total = n + other
    other = matched(total, threshold) <= np.minimum(n, other)
    pairs, single = shared_pairs(total, threshold)[other], matched(total, threshold)[other]
    return int(pairs[pairs > 0].min(initial=1 << 40)) % (1 << 40), int(single[pairs <= 0].min(initial=1 << 40)) % (1 << 40)


class _Names:
    """Numbered tokens of many names."""

    def __init__(self, kinds: list[str], names: list[str]):
        self.size = np.array([len(s) for s in names], np.int64)
        self.points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.row = np.repeat(np.arange(len(names)), self.size)
        salt = {k: np.frombuffer((k + "\0" * 8).encode()[: max(8, len(k.encode()) // 8 * 8)], np.uint64) for k in set(kinds)}
        salt = {k: _mixed(np.add.reduce(v * _STEP ** np.arange(1, len(v) + 1, dtype=np.uint64), keepdims=True))[0] for k, v in salt.items()}
        self.salt = np.array([salt[k] for k in kinds], np.uint64)

    def pieces(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of all q characters in a row."""
        n = len(self.points) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(q):
            key = key * _STEP + self.points[j : j + n] + np.uint64(1)
        inside = self.row[:n] == self.row[q - 1 :]
        row = self.row[:n][inside]
        return row, _mixed(key[inside] + self.salt[row] + np.uint64(q))

    def tokens(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) by row, where a piece's second occurrence in a name differs from its first."""
        row, key = self.pieces(q)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        again = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        return row, _mixed(key + again.astype(np.uint64) * _STEP)


def _cell(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(48)).astype(np.int64)


def _parities(row: np.ndarray, token: np.ndarray, n: int, words: int) -> list[bytes]:
    """For each name the parities of its tokens' numbers in cells. Of two names' tokens, at least as many are in one name only as parities differ."""
    bits = words * 64
    odd = (np.bincount(row * bits + (token % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1).astype(bool)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[i * words * 8 : (i + 1) * words * 8] for i in range(n)]


def _slices(batches: Iterator[pa.RecordBatch], at_most: int = 4096) -> Iterator[tuple[list[str], list[str], list[int]]]:
    for b in batches:
        for lo in range(0, len(b), at_most):
            part = b.slice(lo, at_most)
            yield tuple(part.column(c).to_pylist() for c in ("type", "norm", "side"))


def _counts(kinds: tuple[int, ...], numbered: bool):
    """Numbers of names by cell of their tokens, for each length of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(kinds), CELLS), np.int64)
        for types, norms, _ in _slices(batches):
            names = _Names(types, norms)
            for i, q in enumerate(kinds):
                row, key = names.tokens(q) if numbered else names.pieces(q)
                one = np.unique(row * CELLS + _cell(key))
                table[i] += np.bincount(one % CELLS, minlength=CELLS)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table.ravel()[at])], names=["cell", "n"])

    return run


def _frequencies(d: DataFrame, kinds: tuple[int, ...], numbered: bool) -> np.ndarray:
    """The sums of these tables over all tasks: a fixed number of cells comes to the driver."""
    out = np.zeros(len(kinds) * CELLS, np.int64)
    sums = d.mapInArrow(_counts(kinds, numbered), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(len(kinds), CELLS)


def _postings(threshold: float, shared):
    """A row for each rare token of a name, with what it is compared by; frequent tokens' names are dealt to groups that meet pairwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for types, norms, sides in _slices(batches):
            names = _Names(types, norms)
            n = len(norms)
            needs = np.array([_needs(int(s), threshold) for s in names.size], np.int64).reshape(n, 2)
            by_kind, parities = [], []
            for i, q in ((0, 1), (1, 2)):
                row, token = names.tokens(q)
                parities.append(_parities(row, token, n, WORDS[i]))
                order = np.lexsort((token, often[i][_cell(token)], row))
                row, token = row[order], token[order]
                start = np.searchsorted(row, np.arange(n))
                size = np.bincount(row, minlength=n)
                need = needs[:, 1 - i]
                first = np.where(need > 0, np.maximum(size - need + 1, 0), 0)
                rare = np.arange(len(row)) - start[row] < first[row]
                by_kind.append((row[rare], token[rare], often[i][_cell(token[rare])]))
            row, token, count = (np.concatenate(x) for x in zip(*by_kind))
            groups = np.maximum(1, -(-count // GROUP))
            names_hash = np.array([_hash(x) for x in norms] if (groups > 1).any() else [0] * n, np.uint64)
            mine = (_mixed(token ^ names_hash[row]) % groups.astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(row)), groups)
            other = np.arange(len(each)) - np.repeat(np.cumsum(groups) - groups, groups)
            row, token, mine = row[each], token[each], mine[each]
            at = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([types[r] for r in at], pa.string()), pa.array(token.view(np.int64)), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine),
                    pa.array([norms[r] for r in at], pa.string()), pa.array([sides[r] for r in at], pa.int32()), pa.array([parities[0][r] + parities[1][r] for r in at], pa.binary()),
                ],
                names=["type", "token", "i", "j", "own", "norm", "side", "parities"],
            )

    return run


def _hash(s: str) -> int:
    """A 64-bit hash that is the same in every process."""
    x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return int(_mixed(np.array([(x * _mixed(np.arange(1, len(x) + 1, dtype=np.uint64))).sum(dtype=np.uint64)]))[0])


def _near(norms: list[str], own: np.ndarray, side: np.ndarray, parities: np.ndarray, cross: bool, threshold: float) -> list[tuple[int, int]]:
    """Pairs of a group that lengths and parities leave possible."""
    size = np.array([len(s) for s in norms], np.int64)
    order = np.argsort(size, kind="stable")
    size, own, side, parities = size[order], own[order], side[order], parities[order]
    out = []
    for lo in range(0, len(order), ROWS):
        a = slice(lo, min(lo + ROWS, len(order)))
        hi = int(np.searchsorted(size, np.floor(size[a].max() * (2 - threshold) / threshold + 1e-9), side="right"))
        for at in range(lo, hi, 4 * ROWS):
            b = slice(at, min(at + 4 * ROWS, hi))
            total = size[a][:, None] + size[b][None, :]
            least = matched(total, threshold)
            maybe = np.minimum(size[a][:, None], size[b][None, :]) >= least
            maybe &= np.arange(lo, a.stop)[:, None] < np.arange(at, b.stop)[None, :]
            maybe &= ((side[a][:, None] & 1) & (side[b][None, :] >> 1)) | ((side[a][:, None] >> 1) & (side[b][None, :] & 1)) > 0
            if cross:
                maybe &= own[a][:, None] != own[b][None, :]
            x, y = np.nonzero(maybe)
            total, least = total[x, y], least[x, y]
            x, y = x + lo, y + at
            apart = np.bitwise_count(parities[x, : WORDS[0]] ^ parities[y, : WORDS[0]]).sum(axis=1)
            keep = apart <= total - 2 * least
            x, y, total, least = x[keep], y[keep], total[keep], least[keep]
            apart = np.bitwise_count(parities[x, WORDS[0] :] ^ parities[y, WORDS[0] :]).sum(axis=1)
            keep = apart <= total - 2 - 2 * (3 * least - total - 1)
            out += zip(order[x[keep]].tolist(), order[y[keep]].tolist())
    return out


def _compare(threshold: float):
    """Possible pairs from postings in the order of their keys; one key's rows are held at a time."""

    def settle(key: tuple, rows: list[tuple]) -> list[tuple[str, str, str]]:
        own, norms, side, parities = zip(*rows)
        words = np.frombuffer(b"".join(parities), np.uint64).reshape(len(rows), sum(WORDS))
        found = _near(list(norms), np.array(own), np.array(side), words, key[2] != key[3], threshold)
        return [(key[0], min(norms[a], norms[b]), max(norms[a], norms[b])) for a, b in found if norms[a] != norms[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            found = []
            for *this, own, norm, side, parities in zip(*(b.column(c).to_pylist() for c in ("type", "token", "i", "j", "own", "norm", "side", "parities"))):
                if this != key:
                    if len(held) > 1:
                        found += settle(tuple(key), held)
                    key, held = this, []
                held.append((own, norm, side, parities))
            yield _pairs(found)
        if len(held) > 1:
            yield _pairs(settle(tuple(key), held))

    return run


def _pairs(found: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*dict.fromkeys(found))) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["type", "x", "y"])


def alike(d: DataFrame, threshold: float) -> DataFrame:
    """(type, x, y), x before y: all pairs of different names of one type whose ratio may reach the threshold, and few others.

    ``d`` has one row for each (type, norm) and a column ``side``: 1 and 2 for names of the two sides that are to meet, 3 for both. Empty names and those without a type
    have no partners.
    """
    spark = d.sparkSession
    d = d.filter("norm <> '' and type is not null").select("type", "norm", F.col("side").cast("int").alias("side"))
    often = spark.sparkContext.broadcast(_frequencies(d, (1, 2), True))
    keys = ["type", "token", "i", "j"]
    posts = d.mapInArrow(_postings(threshold, often), "type string, token long, i long, j long, own long, norm string, side int, parities binary")
    return posts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "type string, x string, y string").distinct()


def _anchors(shared):
    """For each name its rarest piece (as the shorter one), and all its pieces (as the longer one), by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for types, norms, sides in _slices(batches):
            names = _Names(types, norms)
            level = np.searchsorted(PIECES, names.size, side="right") - 1
            for i, q in enumerate(PIECES):
                row, key = names.pieces(q)
                one = np.unique(np.stack((row.astype(np.uint64), key)), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
                row, key = one[0].astype(np.int64), one[1]
                order = np.lexsort((key, often[i][_cell(key)], row))
                rarest = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                rarest = rarest[level[row[rarest]] == i]
                for rows, short in ((rarest, True), (np.arange(len(row)), False)):
                    at = row[rows].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([types[r] for r in at], pa.string()), pa.array(key[rows].view(np.int64)), pa.array([norms[r] for r in at], pa.string()), pa.array([sides[r] for r in at], pa.int32()), pa.array([short] * len(at), pa.bool_())], names=["type", "piece", "norm", "side", "short"])

    return run


def contained(d: DataFrame) -> DataFrame:
    """(type, short, long): names of one type of which one lies within another, by an equi-join of the shorter one's rarest piece with the longer one's pieces. ``side`` as in ``alike``, if there is one."""
    side = F.col("side").cast("int") if "side" in d.columns else F.lit(3)
    d = d.filter("norm <> '' and type is not null").select("type", "norm", side.alias("side"))
    often = d.sparkSession.sparkContext.broadcast(_frequencies(d, PIECES, False))
    posts = d.mapInArrow(_anchors(often), "type string, piece long, norm string, side int, short boolean")
    short = posts.filter("short").select("type", "piece", F.col("norm").alias("short"), F.col("side").alias("one"))
    long = posts.filter("not short").select("type", "piece", F.col("norm").alias("long"), F.col("side").alias("two"))
    found = short.join(long, ["type", "piece"]).filter(F.expr("(((one & 1) & (two >> 1)) | ((one >> 1) & (two & 1))) > 0"))
    return found.filter(F.col("long").contains(F.col("short")) & (F.length("long") > F.length("short"))).select("type", "short", "long")
