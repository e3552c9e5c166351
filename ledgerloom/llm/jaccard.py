"""Exact Jaccard self-join of word-shingle sets by universe-partition pigeonhole.

Two sets of r and s tokens with a Jaccard similarity of t or more differ in H = (r + s)(1 - t)/(1 + t) tokens at most. For each band of
set sizes (a factor of four) the universe of token hashes is partitioned into m ranges, the segments. What a set holds in a segment is its
subset there, an item of weight 1. Put the items of all sets of a band in one order; of two sets that differ in at most H tokens, the
items before the first one that they share weigh at most H on either side. So a set indexes its items until their weight exceeds H. In
bands where too few items are rare, a fixed quarter of the segments are indexed with their one-deletion neighbourhoods: their place in the order
depends on the segment alone, they are shared if the subsets differ by one token, and count twice.

1. Sets: one pass hashes words and shingles to 64 bits with numpy. Equal sets form a class, named by 128 bits of hashes of the whole set. The same
   pass counts signatures of items over all documents in cells of a table of fixed size, that is, it estimates what each would cost.
2. Allocation: items are put in order of their cell's count, so that those of frequent passages come last and are rarely indexed.
3. Signatures are packed into one block of bytes for each slice and partition, with the class, its size, and the number of one-token items
   before (its place). Each of these before the first shared item is a token in which the two sets differ, so places that sum to more than H
   make no candidate. All pairs of a group of up to GROUP equal signatures are considered. A larger group is listed: its first member is paired with each other one.
4. Verification: each class carries the parities of its tokens over a bitmap in proportion to its size. Two parity bitmaps differ in no more
   bits than the sets in tokens, so pairs whose bitmaps differ in more than H bits are no links. For the others, intersections of whole sets
   are computed from arrays joined to the pairs. Links are contracted to components.
5. Large groups with members of several components are read again, in blocks: members of different components whose places, sizes
   and bitmaps allow a link are verified, but not again where they have met in a large group just before. A link within a component changes nothing, so no others are needed.

Pairs are anchored in the band of the smaller set; a set takes part in the band below its own too if a partner may lie there. Sizes below 64
have a segment for each token. Signatures so frequent that one task should not gather them are listed without being gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, by_bytes, counted_cut, cut, mixed, range_hashes, runs, tidy, utf8, utf8_like, word_hashes, unused
from ledgerloom.operators.graph import contracted

SLICE, ROWS = 1 << 21, 2048
#: Sizes from 4 ** SMALL on have SEGMENTS * 4 ** band segments.
SMALL, SEGMENTS = 3, 64
#: Bands of sizes; cells of the table of costs for each, and how many are sent together.
BANDS, CELLS, CHUNK = 12, 1 << 17, 1 << 12
#: All pairs of a group of up to so many equal signatures are considered.
GROUP = 16
#: A task packs so many signatures at a time.
PACK = 1 << 21
#: Signatures whose cells count more than this, and over 16 times the band's median, are listed without being gathered.
HOT = 1 << 16
#: A cell is cheap if its count is up to this many times the band's median.
COSTLY = 8
#: Members of a large group are compared in blocks of so many.
BLOCK = 4096
#: So many ids are broadcast at most: 16 MB.
BROADCAST_IDS = 1_000_000
_CODE = np.arange(256)
_WORD = ~((_CODE == 32) | ((_CODE >= 9) & (_CODE <= 13)))
_SHIFT = np.array([0 if b < SMALL else 64 - (SEGMENTS.bit_length() - 1) - 2 * b for b in range(BANDS)], np.uint64)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the bounds of the rows. Fewer than k words are one shingle, no words none."""
    n = len(offsets) - 1
    s, e, row = runs(_WORD[data], offsets)
    words = np.bincount(row, minlength=n)
    base = np.cumsum(words) - words
    size = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    first = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(base, size)
    hashes = word_hashes(LOWER[data], s, e) if len(s) else np.zeros(0, np.uint64)
    tokens = range_hashes(hashes, first, first + np.repeat(np.minimum(words, k), size)) if len(first) else hashes
    ends = np.cumsum(size)
    for a, b in zip((ends - size).tolist(), ends.tolist()):
        tokens[a:b].sort()
    of = np.repeat(np.arange(n), size)
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
    return tokens[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=n))))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _names(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each set."""
    n = np.diff(bounds).astype(np.uint64)
    return np.stack([mixed(_sums(mixed(tokens), bounds) + n), mixed(_sums(mixed(tokens ^ np.uint64(0x5DEECE66D1234567)), bounds) ^ n)], axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one length, as binary."""
    rows = np.ascontiguousarray(rows).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.py_buffer(rows)])


def bands_of(size: np.ndarray) -> np.ndarray:
    """floor(log4 size), BANDS - 1 at most; sizes are above 0."""
    return np.minimum((np.frexp(size.astype(np.float64))[1] - 1) // 2, BANDS - 1)


def most_apart(r: np.ndarray, s: np.ndarray, percent: int) -> np.ndarray:
    """H: in so many tokens may linked sets of these sizes differ."""
    return (r + s) * (100 - percent) // (100 + percent)


def _partners(size: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(taking part, anchor band, H) of each set, as a member of its own band and of the band below."""
    band = bands_of(np.maximum(size, 1))
    low = 4 ** band.astype(np.int64)
    least = -(-size * percent // 100)
    return [(size > 0, band, most_apart(size, size * 100 // percent, percent)), ((size > 0) & (least < low), np.maximum(band - 1, 0), most_apart(size, low - 1, percent))]


def _items(tokens: np.ndarray, bounds: np.ndarray, pick: np.ndarray, band: np.ndarray):
    """Subsets of the picked sets: (tokens of these sets, starts of the subsets in them, row, segment, signature, tokens held)."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    if not pick.all():
        inside = pick[row]
        tokens, row = tokens[inside], row[inside]
    # Tokens are sorted, and so are their ranges.
    segment = tokens >> _SHIFT[band[row]]
    starts = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (row[1:] != row[:-1])))) if len(row) else np.zeros(0, np.int64)
    held = np.diff(np.append(starts, len(row)))
    row, segment = row[starts], segment[starts]
    return tokens, starts, row, segment, mixed(np.add.reduceat(mixed(tokens), starts) + _salt(segment, band[row])), held


def _salt(segment: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mixed(segment + (band.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _cell(sign: np.ndarray) -> np.ndarray:
    return (sign >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _parities(tokens: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set a bitmap of 64 bits or more, the parity of the number of its tokens with the same value modulo the number of bits."""
    size = np.diff(bounds)
    bits = np.maximum(64, 4 ** (bands_of(np.maximum(size, 1)).astype(np.int64) + 1))
    base = np.concatenate(([0], np.cumsum(bits)))
    row = np.repeat(np.arange(len(size)), size)
    at = base[row] + (tokens & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(bool), bitorder="little")
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(base // 8), pa.py_buffer(data)]).cast(pa.binary())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, "text", SLICE):
            for at in range(0, len(part), ROWS):
                yield part.slice(at, ROWS)


def _first_seen(part: pa.RecordBatch, names: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows of classes that the task has not met. Rows without an id stand for no set."""
    named = np.asarray(part.column("id").is_valid())
    return np.array([ok and not (c in seen or seen.add(c)) for ok, c in zip(named.tolist(), names[:, 0].tolist())], bool)


def _describe(k: int, percent: int):
    """Rows of sets (band is null) and of counted cells (id is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        seen: set[int] = set()
        kind = None
        for part in _slices(batches):
            kind = part.schema.field("id").type
            tokens, bounds = shingle_sets(*utf8(part.column("text")), k)
            names = _names(tokens, bounds)
            size = np.diff(bounds)
            new = _first_seen(part, names, seen)
            for joins, band, _ in _partners(size, percent):
                if (joins & new).any():
                    _, _, row, _, sign, _ = _items(tokens, bounds, joins & new, band)
                    cell = band[row] * CELLS + _cell(sign)
                    for b in np.unique(band[joins & new]).tolist():
                        table = counts.setdefault(b, np.zeros(CELLS, np.uint32))
                        table += np.bincount(cell[cell // CELLS == b] - b * CELLS, minlength=CELLS).astype(np.uint32)
            none = pa.nulls(len(part), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), _binary(names), pa.array((names[:, 0] & _LOW).view(np.int64)), _parities(tokens, bounds), none, none, pa.nulls(len(part), pa.binary())], names=COLUMNS)
        for b, table in counts.items():
            at = [c for c in range(CELLS // CHUNK) if table[c * CHUNK : (c + 1) * CHUNK].any()]
            none, nothing = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())
            packed = pa.array([zlib.compress(table[c * CHUNK : (c + 1) * CHUNK].tobytes(), 1) for c in at], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), none, nothing, none, nothing, pa.array([b] * len(at), pa.int32()), pa.array(at, pa.int32()), packed], names=COLUMNS)

    return run


COLUMNS = ["id", "n", "class", "name", "parities", "band", "chunk", "cells"]


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk's counts, as levels: eight times the binary logarithm of one more."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for b, c, packed in zip(*(batch.column(x).to_pylist() for x in ("band", "chunk", "cells"))):
            total = sums.setdefault((b, c), np.zeros(CHUNK, np.int64))
            total += np.frombuffer(zlib.decompress(packed), np.uint32)
    levels = [np.minimum(np.round(8 * np.log2(1.0 + t)), 255).astype(np.uint8).tobytes() for t in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sums], pa.int32()), pa.array([c for _, c in sums], pa.int32()), pa.array(levels, pa.binary())], names=["band", "chunk", "cells"])


@dataclass
class Plan:
    """What allocation decides, of a fixed size: the level of each cell, from which level on a signature is hot, and what bands have neighbourhoods at what level."""

    levels: np.ndarray
    hot: np.ndarray
    deep: np.ndarray
    middle: np.ndarray


def allocate(cells: DataFrame, percent: int) -> Plan:
    """Sums the counted cells on the executors; a byte for each of BANDS * CELLS cells comes to the driver, however many documents there are."""
    found = cells.select("band", "chunk", "cells").repartition("band", "chunk").mapInArrow(_add_up, "band int, chunk int, cells binary").collect()
    levels = np.zeros((BANDS, CELLS), np.uint8)
    for r in found:
        levels[r["band"], r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["cells"], np.uint8)
    hot, middle, deep = np.full(BANDS, 256), np.zeros(BANDS, np.int64), np.zeros(BANDS, bool)
    for b in range(BANDS):
        if levels[b].any():
            used = levels[b][levels[b] > 0].astype(np.int64)
            count = 2.0 ** (used / 8) - 1
            half = float(np.median(count))
            hot[b] = 8 * np.log2(max(HOT, 16 * half))
            middle[b] = 8 * np.log2(1 + COSTLY * max(half, 1.0))
            # What a set has to index at least, of what is cheap.
            deep[b] = count[used <= middle[b]].sum() < 1.5 * (100 - percent) / percent * count.sum()
    return Plan(levels, hot, deep, middle)


def _pack(sign: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray) -> bytes:
    """Signatures and names as 48 bits, sizes and places as 16."""
    low = np.uint64(0xFFFFFFFF)
    parts = [(sign & low).astype("<u4"), (name & low).astype("<u4"), (sign >> np.uint64(32)).astype("<u2"), (name >> np.uint64(32)).astype("<u2"), size, place]
    return b"".join(p.tobytes() for p in parts)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n = len(blob) // 16
    low = np.frombuffer(blob, "<u4", 2 * n)
    high = np.frombuffer(blob, "<u2", 4 * n, 8 * n)
    sign, name = (low[i * n : (i + 1) * n].astype(np.int64) | high[i * n : (i + 1) * n].astype(np.int64) << 32 for i in (0, 1))
    return sign, name, high[2 * n : 3 * n], high[3 * n :]


def _size_code(size: np.ndarray) -> np.ndarray:
    """Sizes as steps of a 2048th of a power of two, rounded down."""
    return np.floor(np.log2(np.maximum(size, 1)) * 2048 + 1e-6).astype(np.uint16)


def _may_link(size_a: np.ndarray, size_b: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """Whether codes of sizes and the sum of places allow a link."""
    least, most = np.minimum(size_a, size_b).astype(np.float64), np.maximum(size_a, size_b).astype(np.float64)
    upper = lambda code: 2.0 ** ((code + 1) / 2048) + 1e-6
    return (upper(least) * 100 >= 2.0 ** (most / 2048) * (1 - 1e-9) * percent) & (places <= (upper(least) + upper(most)) * (100 - percent) / (100 + percent))


def _indexed(tokens: np.ndarray, bounds: np.ndarray, pick: np.ndarray, band: np.ndarray, most: np.ndarray, plan: Plan):
    """What the picked sets index: (row, signature of 64 bits, place, whether it is hot)."""
    inner, starts, row, segment, sign, held = _items(tokens, bounds, pick, band)
    of = band[row]
    level = plan.levels[of, _cell(sign)].astype(np.int64)
    salt = _salt(segment, of)
    deep = plan.deep[of] & (salt % np.uint64(4) == 0)
    # A place in the order depends on the signature alone, or on the segment alone where neighbourhoods are indexed.
    key = row.astype(np.uint64) << np.uint64(53) | np.where(deep, plan.middle[of], level).astype(np.uint64) << np.uint64(45) | np.where(deep, mixed(salt), mixed(sign)) >> np.uint64(19)
    order = np.argsort(key)
    key, row, sign, held, deep, level = key[order], row[order], sign[order], held[order], deep[order], level[order]
    weight = 1 + (deep & (held > 1))
    first = np.searchsorted(row, row)
    ahead = lambda x: (s := np.cumsum(x) - x) - s[first]
    before, place = ahead(weight), ahead((held == 1).astype(np.int64))
    for i in np.flatnonzero(key[1:] == key[:-1]).tolist():
        before[i + 1], place[i + 1] = before[i], place[i]
    take = np.flatnonzero(before <= most[row])
    out = [(row[take], sign[take], place[take], level[take] >= plan.hot[band[row[take]]])]
    less = take[deep[take] & (held[take] > 1)]
    if len(less):
        at = starts[order[less]]
        n = held[less]
        of_item = np.repeat(np.arange(len(less)), n)
        token = inner[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.add.reduceat(mixed(inner), starts)[order[less]]
        out.append((row[less][of_item], mixed(total[of_item] - mixed(token) + salt[order[less]][of_item]), place[less][of_item], np.zeros(len(of_item), bool)))
    # Sets with too few segments for their H, and any that may be linked with one, have a signature in common.
    total = np.bincount(row, weight, minlength=len(bounds) - 1)
    poor = np.flatnonzero(pick & (total <= 2 * most))
    out.append((poor, mixed(band[poor].astype(np.uint64) + np.uint64(0x1234567)), np.zeros(len(poor), np.int64), np.zeros(len(poor), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sign(k: int, percent: int, plan: Plan, parts: int):
    """Packed signatures of the items that sets index, by partition; hot ones apart, spread over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        for part in _slices(batches):
            tokens, bounds = shingle_sets(*utf8(part.column("text")), k)
            names = _names(tokens, bounds)
            size = np.diff(bounds)
            code = _size_code(size)
            new = _first_seen(part, names, seen)
            for joins, band, most in _partners(size, percent):
                if (joins & new).any():
                    row, sign, place, hot = _indexed(tokens, bounds, joins & new, band, most, plan)
                    held.append((sign & _LOW, names[row, 0] & _LOW, code[row], np.minimum(place, 65535).astype(np.uint16), hot))
            if sum(len(x[0]) for x in held) >= PACK:
                yield _packed(held, parts)
                held = []
        if held:
            yield _packed(held, parts)

    return run


def _packed(held: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    sign, name, size, place, hot = (np.concatenate(x) for x in zip(*held))
    part = (np.where(hot, mixed(sign ^ mixed(name)), sign) % np.uint64(parts)).astype(np.int64) * 2 + hot
    order = np.argsort(part, kind="stable")
    at, begin = np.unique(part[order], return_index=True)
    blobs = [_pack(*(x[o] for x in (sign, name, size, place))) for o in np.split(order, begin[1:])]
    return pa.RecordBatch.from_arrays([pa.array(at // 2, pa.int32()), pa.array(at % 2 == 1), pa.array(blobs, pa.binary())], names=["part", "hot", "blob"])


def _groups(percent: int):
    """Of a partition's signatures: candidates (sign is null, a, b) of groups of up to GROUP classes, members (sign, a, size, place) of larger and of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for hot, blob in zip(batch.column("hot").to_pylist(), batch.column("blob")):
                entries = _unpack(blob.as_buffer())
                if hot:
                    yield _members(*entries)
                else:
                    found.append(entries)
        if found:
            yield from grouped(*(np.concatenate(x) for x in zip(*found)), percent)

    return run


def grouped(sign: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(sign)
    s = sign[order]
    same = s[1:] == s[:-1]
    met = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    if not len(met):
        return
    # Entries of one class, from several tasks, are one.
    met = met[np.lexsort((place[met], size[met], name[met], sign[met]))]
    sign, name, size, place = sign[met], name[met], size[met], place[met].astype(np.int64)
    new = np.ones(len(met), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (name[1:] != name[:-1]) | (size[1:] != size[:-1])
    sign, name, size, place = sign[new], name[new], size[new], place[new]
    start = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
    many = np.diff(np.append(start, len(sign)))
    group = np.repeat(np.arange(len(start)), many)
    small = (many <= GROUP)[group]
    pairs = []
    for d in range(1, GROUP):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:]) if len(group) > d else np.zeros(0, np.int64)
        i = i[_may_link(size[i], size[i + d], place[i] + place[i + d], percent)]
        pairs.append(np.stack([name[i], name[i + d]]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    n = pairs.shape[1]
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=_MET)
    yield _members(sign[~small], name[~small], size[~small], place[~small])


_MET = ["sign", "a", "b", "size", "place"]


def _members(sign: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sign), pa.array(name), pa.nulls(len(sign), pa.int64()), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], names=_MET)


def _alike(maps: list[tuple[np.ndarray, np.ndarray]], rows: tuple[np.ndarray, np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether two bitmaps, the larger one folded to the size of the other, differ in no more bits than this."""
    sizes = np.stack([np.diff(o)[r] for (_, o), r in zip(maps, rows)])
    keep = np.zeros(len(most), bool)
    for la, lb in np.unique(sizes, axis=1).T.tolist():
        at = np.flatnonzero((sizes[0] == la) & (sizes[1] == lb))
        least = min(la, lb)
        for some in np.array_split(at, len(at) * max(la, lb) // (1 << 24) + 1):
            x, y = (np.bitwise_xor.reduce(d[o[r[some]][:, None] + np.arange(n)].reshape(len(some), n // least, least), axis=1) for (d, o), r, n in zip(maps, rows, (la, lb)))
            keep[some] = np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most[some]
    return keep


def _close(percent: int):
    """Pairs whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            rows = np.arange(len(batch))
            keep = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
            at = np.flatnonzero(keep)
            keep[at] = _alike([utf8_like(batch.column(c)) for c in ("xa", "xb")], (rows[at], rows[at]), most_apart(na[at], nb[at], percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


#: A class's large groups before one.
_EARLIER = ["before1", "before2", "before3", "before4"]


def _across(percent: int):
    """Of rows sorted by (sign, x, y), a cell of two blocks of a group: pairs of classes of different components that may be linked.

    A cell has 2 * BLOCK rows at most, or somewhat more by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0] if len(batch) else batch
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("sign", "x", "y")])
            start = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))).tolist()
            for a, b in zip(start, start[1:]):
                yield from _cell_pairs(batch.slice(a, b - a), percent)
            rest = batch.slice(start[-1])
        if rest is not None:
            yield from _cell_pairs(rest, percent)

    return run


def _cell_pairs(cell: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    n, place, block = (cell.column(c).to_numpy() for c in ("n", "place", "block"))
    component = np.unique(np.array(cell.column("component").to_pylist(), dtype="S16"), return_inverse=True)[1] if len(cell) else n
    one = cell.column("x")[0] == cell.column("y")[0]
    earlier = [cell.column(c).to_numpy() for c in _EARLIER]
    maps = utf8_like(cell.column("parities"))
    at = np.arange(len(cell))
    for lo in range(0, len(cell), 256):
        i = at[lo : lo + 256, None]
        may = (component[i] != component) & (at > i) & (one | (block[i] != block))
        may &= (place[i] + place <= most_apart(n[i], n, percent)) & (np.minimum(n[i], n) * 100 >= np.maximum(n[i], n) * percent)
        a, b = np.nonzero(may)
        a += lo
        if len(a):
            again = np.zeros(len(a), bool)
            for x in earlier:
                for y in earlier:
                    again |= (x[a] == y[b]) & (x[a] >= 0)
            a, b = a[~again], b[~again]
        keep = pa.array(_alike([maps, maps], (a, b), most_apart(n[a], n[b], percent)))
        name = cell.column("class")
        if len(a):
            yield pa.RecordBatch.from_arrays([name.take(pa.array(x).filter(keep)) for x in (a, b)], names=["a", "b"])


def _arrays(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            tokens, bounds = shingle_sets(*utf8(part.column("text")), k)
            yield pa.RecordBatch.from_arrays([_binary(_names(tokens, bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens.view(np.int64)))], names=["class", "tokens"])

    return run


class _Join:
    """The steps of one self-join; each writes what it finds to the shared folder."""

    def __init__(self, docs: DataFrame, key: str, text: str, k: int, percent: int):
        self.k, self.percent = k, percent
        self.kind = docs.schema[key].dataType.simpleString()
        self.slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        described = cut(self.slim.mapInArrow(tidy(_describe(k, percent)), f"id {self.kind}, n long, class binary, name long, parities binary, band int, chunk int, cells binary"))
        self.rows = described.filter("band is null").select("id", "n", "class")
        self.plan = allocate(described.filter("band is not null"), percent)
        sets = described.filter("band is null and n > 0 and id is not null")
        self.classes = cut(sets.groupBy("class").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("parities").alias("parities"), F.max("name").alias("name")))

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Pairs of names (a, b), which may repeat, and members (sign, name, size, place) of large groups."""
        parts = int(self.slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        signed = self.slim.filter("id is not null").mapInArrow(tidy(_sign(self.k, self.percent, self.plan, parts)), "part int, hot boolean, blob binary")
        met = cut(signed.repartitionById(parts, "part").mapInArrow(tidy(_groups(self.percent)), "sign long, a long, b long, size int, place int"))
        large = met.filter("sign is not null").select("sign", F.col("a").alias("name"), "size", "place")
        lead = large.groupBy("sign").agg(F.min(F.struct("place", "name", "size")).alias("lead"))
        upper = lambda c: F.pow(F.lit(2.0), (F.col(c) + 1) / 2048) + 1e-6
        near = F.col("place") + F.col("lead.place") <= (upper("size") + upper("lead.size")) * ((100 - self.percent) / (100 + self.percent))
        star = large.join(lead, "sign").filter(near & (F.col("name") != F.col("lead.name"))).select(F.col("lead.name").alias("a"), F.col("name").alias("b"))
        # Names of 48 bits may be those of several classes.
        twins = self.classes.groupBy("name").count().filter("count > 1").select(F.col("name").alias("a"), F.col("name").alias("b"))
        return met.filter("sign is null").select("a", "b").unionAll(star).unionAll(twins), large

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of classes with these names that sizes and bitmaps leave as possible links."""
        p = pairs.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
        side = lambda c, by: self.classes.select(F.col("name").alias(by), F.col("class").alias(c), F.col("n").alias("n" + c), F.col("parities").alias("x" + c))
        p = p.join(side("a", "p"), "p").join(side("b", "q"), "q").filter((F.col("p") != F.col("q")) | (F.col("a") < F.col("b")))
        return p.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(tidy(_close(self.percent)), "a binary, b binary")

    def links(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Those of the pairs whose sets are similar enough, and their number."""
        pairs = cut(pairs.distinct())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        wanted, n = counted_cut(wanted.join(self.classes, "class").select(F.col("rep").alias("id")).distinct())
        texts = self.slim.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "id").select("text")
        sets = cut(texts.mapInArrow(tidy(_arrays(self.k)), "class binary, tokens array<long>").dropDuplicates(["class"]))
        a = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
        b = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
        return counted_cut(both.filter(F.col("common") * (100 + self.percent) >= self.percent * (F.size("ta") + F.size("tb"))).select("a", "b"))

    def across(self, large: DataFrame, joined: DataFrame) -> DataFrame:
        """Pairs of classes in large groups that are in different components and may be linked."""
        every = large.join(self.classes.select("name", "class"), "name").groupBy("sign", "class").agg(F.min("place").alias("place"))
        every = cut(every.join(joined.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")))
        several = every.groupBy("sign").agg(F.count("*").alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sign", "many")
        # The large groups that a class is in just before: who meets there need not be compared here again.
        ordered = Window.partitionBy("class").orderBy("place", "sign")
        dealt = every.join(several, "sign").withColumns({c: F.coalesce(F.lag("sign", i + 1).over(ordered), F.lit(-1)) for i, c in enumerate(_EARLIER)})
        blocks = F.ceil(F.col("many") / BLOCK).cast("int")
        dealt = dealt.withColumn("block", F.pmod(F.hash("class"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("sign", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "class", "component", "place", *_EARLIER)
        dealt = dealt.join(self.classes.select("class", "n", "parities"), "class").repartition("sign", "x", "y").sortWithinPartitions("sign", "x", "y")
        return dealt.mapInArrow(tidy(_across(self.percent)), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _components(links: DataFrame) -> DataFrame:
    """(id, component) of links (a, b), contracted in the tasks that read them: few steps, as the driver keeps what each task of a step has reported."""
    return contracted(links.select(F.col("a").alias("name"), F.col("b").alias("up"))).select(F.col("name").alias("id"), "component")


def near_duplicates(docs: DataFrame, key: str, text: str, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (size of its set) and component_id (the least id reachable by links, its own included).

    Rows link when their sets' Jaccard similarity is at least ``percent`` / 100. Null and empty texts have empty sets and link with nothing.
    A row with a null id has a null component and links with nothing. Repeated rows are in one component; rows that repeat an id with
    different texts each have the component of their text, if these are not linked. An empty table gives an empty result; other columns are ignored.
    """
    join = _Join(docs, key, text, k, percent)
    pairs, large = join.candidates()
    links, _ = join.links(join.fitting(pairs))
    joined = _components(links)
    more, n = join.links(join.across(large, joined))
    if n:
        # Of links, what they have joined is enough.
        joined = _components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
    classes = join.classes.select("class", "rep")
    lowest = joined.join(classes, joined["id"] == classes["class"]).groupBy("component").agg(F.min("rep").alias("least"))
    found = classes.join(joined.select(F.col("id").alias("class"), "component"), "class", "left").join(lowest, "component", "left").select("class", F.coalesce("least", "rep").alias("component_id"))
    own = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return join.rows.join(found, "class", "left").select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicate(docs: DataFrame, key: str, text: str, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that with the least id, and of rows that repeat this id one. Rows with a null id stay, and of
    rows without shingles that repeat an id and a text one."""
    repeated, n = counted_cut(docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key))
    if not n:
        found = near_duplicates(docs, key, text, k, percent)
        gone, n = counted_cut(found.filter("component_id <> id").select(F.col("id").alias(key)))
        return docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, key, "left_anti").select(*docs.columns)
    # An id that repeats does not tell its rows apart, so rows are numbered.
    row = unused("__row", docs)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    named = numbered.filter(F.col(key).isNotNull())
    found = near_duplicates(named, row, text, k, percent).select(F.col("id").alias(row), "component_id")
    first = named.select(row, F.col(key).alias("key_")).join(found, row).groupBy("component_id").agg(F.min(F.struct("key_", row)).alias("x")).select(f"x.{row}")
    kept = named.join(cut(first), row, "left_semi").drop(row).select(*docs.columns)
    once = kept.join(repeated, key, "left_semi").select(*docs.columns).dropDuplicates([key, text])
    return kept.join(repeated, key, "left_anti").select(*docs.columns).unionByName(once).unionByName(numbered.filter(F.col(key).isNull()).drop(row))
