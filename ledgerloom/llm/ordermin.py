"""Document fingerprints by order MinHash: likeness that is sensitive to edit distance, not only to what a text holds.

Each of ``draws`` hash functions selects the ``picked`` least among a text's k-mers, where repeats of a k-mer count as k-mers of their own; what is picked is put
back into the order of the text and hashed as a tuple. Texts agree in a draw where they share the same k-mers in the same order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_bytes, mixed, shared_folder, tidy

K, PICKED, DRAWS = 8, 2, 64
#: K-mers that are numbered at a time; of longer texts, one range of hashes after another.
LIMIT = 1 << 19
#: K-mers whose hashes under all draws are held at a time, and bytes of text in a slice of a batch.
STEP, SLICE = 4096, 8 << 20

_PLACE = np.uint64(20)  # bits for places within a pass; LIMIT and what a range has above its share must fit
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint32(0xFFFFFFFF)
_TABLE: dict[int, np.ndarray] = {}
_FACTORS: dict[int, np.ndarray] = {}


def _factors(n: int) -> np.ndarray:
    """An odd factor for each hash function; what it is applied to is mixed before."""
    return ((mixed(np.arange(1, n + 1, dtype=np.uint64) * _STEP) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]


def _windows(p: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k values in a row, from those of half as many."""
    if k == 1:
        return p
    half = k // 2
    h = _windows(p, half)
    h = h[:-half] * (_STEP + np.uint64(2 * half)) + h[half:]
    return h if k % 2 == 0 else h[:-1] * (_STEP + np.uint64(2 * k)) + p[k - 1 :]


def kmers(points: np.ndarray, k: int, start: int, end: int) -> np.ndarray:
    """Hashes of the k-mers of code points that begin in a range; a text shorter than k is one k-mer."""
    k = min(k, len(points))
    return mixed(_windows(points[start : end + k - 1].astype(np.uint64) + np.uint64(1), k) + np.uint64(k))


def _passes(points: np.ndarray, k: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of a text's k-mers, all those of a range of hashes at a time, in the order of the text."""
    n = max(len(points) - k + 1, min(len(points), 1))
    if n <= limit:
        if n:
            yield kmers(points, k, 0, n), np.arange(n)
        return
    parts = np.uint64(-(-2 * n // limit))
    for r in range(int(parts)):
        hashes, places = [], []
        for at in range(0, n, limit):
            h = kmers(points, k, at, min(n, at + limit))
            mine = np.flatnonzero(h % parts == r)
            hashes.append(h[mine])
            places.append(mine + at)
        yield np.concatenate(hashes), np.concatenate(places)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes that tell a k-mer's first, second, … occurrence apart."""
    if len(h) < 1 << int(_PLACE):  # one sort of hashes with their places; it tells k-mers apart by 44 bits
        packed = np.sort((h & ~np.uint64((1 << int(_PLACE)) - 1)) | np.arange(len(h), dtype=np.uint64))
        order, kind = (packed & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64), packed >> _PLACE
    else:  # many repeats of few k-mers
        order = np.argsort(h, kind="stable")
        kind = h[order] >> _PLACE
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    if new.all():
        return mixed(h)
    first = np.flatnonzero(new)
    times = np.empty(len(h), np.uint64)
    times[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mixed(h + times * _STEP)


def signature(text: str, k: int = K, picked: int = PICKED, draws: int = DRAWS, limit: int = LIMIT) -> np.ndarray:
    """One 32-bit value for each draw. Equal texts have equal signatures; that of an empty text is all zeros."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    factor = _FACTORS.setdefault(draws, _factors(draws))
    rows = np.arange(draws)
    best, kept, at = [], [], []  # a column for each k-mer picked from a part of the text
    for hashes, places in _passes(points, k, limit):
        x = (numbered(hashes) >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(x), STEP):
            n = min(STEP, len(x) - lo)
            table = _TABLE.setdefault(draws, np.empty((draws, STEP), np.uint32))[:, :n]
            np.multiply(x[lo : lo + n], factor, out=table)
            for _ in range(min(picked, n)):
                least = table.argmin(axis=1)
                best.append(table[rows, least])
                kept.append(hashes[lo + least])
                at.append(places[lo + least])
                table[rows, least] = _TOP
    if not at:
        return np.zeros(draws, np.uint32)
    kept, at = np.array(kept), np.array(at)
    if len(at) > picked:  # the least of all parts; ties go to the earlier place
        order = np.lexsort((at, np.array(best)), axis=0)[:picked]
        kept, at = kept[order, rows], at[order, rows]
    kept = kept[np.argsort(at, axis=0), rows]
    out = np.zeros(draws, np.uint64)
    for picks in kept:
        out = mixed(out * _STEP + picks)
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of draws in which two signatures agree."""
    return float(np.mean(a == b))


def as_text(signature: np.ndarray) -> str:
    """Eight lowercase hexadecimal digits for each draw."""
    return _packed(signature).hex()


def _packed(signature: np.ndarray) -> bytes:
    return signature.astype(">u4").tobytes()


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _compare(rows: Iterator[tuple[object, str, str]], **how: int) -> Iterator[tuple]:
    """Results of (id, text, the next row's text); a text that has just been the next one is not signed again."""
    last: tuple[str, np.ndarray] | None = None
    for key, text, following in rows:
        own = last[1] if last is not None and last[0] == text else signature(text, **how)
        last = following, own if following == text else signature(following, **how)
        changed = _edited(text, following)
        other = own if changed == text else signature(changed, **how)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
        yield key, len(text), sha, _packed(own), _packed(other), likeness(own, other), likeness(own, last[1])


RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ARROW = [pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * 2]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, as they are dealt out whole; ``tie`` orders rows of one key."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in by_bytes(batch, "text", SLICE):
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), part.column("row"), pa.array([zip_.compress(t) for t in texts], pa.binary())], names=["id", "tie", "row", "packed"])


def _in_order(kind: pa.DataType, **how: int):
    """Results of all rows of a sorted partition but its last, and two rows with texts: its first (edge 0) and its last (edge 1), which meets the next partition's first."""
    names = ["id", *RESULT, "text", "edge", "part"]

    def batch(results: list[tuple], texts: list[str | None], edge: int | None, part: int) -> pa.RecordBatch:
        columns = list(zip(*results))
        values = [pa.array(columns[0], kind)] + [pa.array(c, t) for c, t in zip(columns[1:], _ARROW)]
        return pa.RecordBatch.from_arrays(values + [pa.array(texts, pa.string()), pa.array([edge] * len(results), pa.int32()), pa.array([part] * len(results), pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        unzip = zstandard.ZstdDecompressor()
        held: tuple | None = None

        def met(rows: pa.RecordBatch) -> Iterator[tuple[object, str, str]]:
            nonlocal held
            for key, packed in zip(rows.column("id").to_pylist(), rows.column("packed").to_pylist()):
                text = unzip.decompress(packed).decode("utf-8", "surrogatepass")
                if held is not None:
                    yield *held, text
                held = key, text

        for rows in batches:
            if held is None and len(rows):
                first = unzip.decompress(rows.column("packed")[0].as_py()).decode("utf-8", "surrogatepass")
                yield batch([(rows.column("id")[0].as_py(), *[None] * 6)], [first], 0, part)
            found = list(_compare(met(rows), **how))
            if found:
                yield batch(found, [None] * len(found), None, part)
        if held is not None:
            yield batch([(held[0], *[None] * 6)], [held[1]], 1, part)

    return run


def _at_edges(kind: pa.DataType, **how: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_compare(zip(*(b.column(c).to_pylist() for c in ("id", "text", "following"))), **how))
            columns = list(zip(*found)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind)] + [pa.array(c, t) for c, t in zip(columns[1:], _ARROW)], names=["id", *RESULT])

    return run


def fingerprints(docs: DataFrame, key: str, text: str, k: int = K, picked: int = PICKED, draws: int = DRAWS, limit: int = LIMIT) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones, or all, of the row that follows by descending key; the first row
    follows the last. ``near_`` columns are the shares of draws in which the fingerprint agrees with that of the edited text and of the next row's text.

    Null texts are empty; an empty text has the fingerprint of zeros and is like empty ones only. A text shorter than k is one k-mer. Rows of equal keys follow one
    another by a hash of their texts, null keys come last; a row alone follows itself; an empty table has no rows. Long texts take one range of k-mers after another, so
    beside 4 bytes a character they need no more memory than short ones. Other columns are left out, and their names do not matter.

    Rows are dealt by ranges of keys once; each partition keeps its last row open, and these rows, one a partition, meet the first rows of the partitions that follow.
    """
    how = {"k": k, "picked": picked, "draws": draws, "limit": limit}
    read = docs.select(docs[key].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("row")]
    name = read.schema["id"].dataType.simpleString()
    packed = read.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).mapInArrow(tidy(_pack), f"id {name}, tie long, row long, packed binary")
    dealt = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = read.select("id").limit(0).toArrow().schema.field("id").type
    folder = f"{shared_folder(docs.sparkSession)}/fingerprints-{uuid.uuid4().hex}"
    dealt.select("id", "packed").mapInArrow(tidy(_in_order(kind, **how)), f"id {name}, {_TYPES}, text string, edge int, part int").write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder)
    parts = Window.orderBy("part")  # as many rows as partitions
    around = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("part").over(parts), F.max("part").over(around))
    ring = found.filter("edge = 0").select("part").withColumn("before", before)
    first = found.filter("edge = 0").select("part", F.col("text").alias("following")).join(ring, "part")
    meet = found.filter("edge = 1").select("id", "text", F.col("part").alias("before")).join(first, "before").select("id", "text", "following")
    out = found.filter("edge is null").select("id", *RESULT).unionByName(meet.mapInArrow(tidy(_at_edges(kind, **how)), f"id {name}, {_TYPES}"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in RESULT[1:4]})
