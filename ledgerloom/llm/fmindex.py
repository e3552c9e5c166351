"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of bounded size. Its words become symbols: each word of the test phrases has a symbol of its own, and every
maximal run of other words, which no phrase can cross, becomes one barrier, as does each document's end. Over these symbols the shard gets

- a suffix array by prefix doubling (barriers are unequal to all else, so doubling ends at the longest repeated stretch between barriers),
- the Burrows-Wheeler transform in a wavelet tree over the symbols' bits with block counts for ranks,
- samples of the suffix array at every ``step``-th place and behind each barrier.

All test phrases are searched backward together, one symbol at a time, by ranks in the wavelet tree; occurrences are located by stepping
back to a sampled place; their spans are merged and give the hit words of each document. A document longer than a shard is cut into
pieces that overlap by one word less than a phrase, so that no occurrence is lost and none counts twice. Shards are built inside Arrow
batches: memory is bounded by the shard's size, nothing is shuffled, and a lost executor costs its own shards.

The test phrases, windows of consecutive words of the benchmark's items, are gathered part by part and sent along with the tasks of a pass;
``max_phrases`` bounds a part: a larger benchmark is searched in as many passes as needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, by_bytes, cut, runs, tidy, unused, utf8, word_hashes

#: Bytes of the words of this contract: all but the ASCII characters that are neither letters nor digits.
_CODE = np.arange(256)
WORD_BYTE = (_CODE >= 128) | ((_CODE >= 48) & (_CODE <= 57)) | ((_CODE >= 97) & (_CODE <= 122)) | ((_CODE >= 65) & (_CODE <= 90))
WORD_BYTE[96] = False
SHARD_BYTES = 1 << 21


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word."""
    low = LOWER[data]
    s, e, row = runs(WORD_BYTE[data], offsets)
    return (word_hashes(low, s, e) if len(s) else np.zeros(0, np.uint64)), s, e, row


class WaveletTree:
    """Ranks of symbols in a sequence: one bit plane per level, each plane sorted stably by the bits above."""

    BLOCK = 64

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        s = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // self.BLOCK + 1) * self.BLOCK, dtype=bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.planes.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(len(bit) - int(bit.sum()))
            s = np.concatenate((s[~bit], s[bit]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.planes[level][block] & mask)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of symbols before lo and before hi: both less the first value returned, the start of the symbol's leaf."""
        start = np.zeros_like(lo)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b, c = self._ones(k, start), self._ones(k, lo), self._ones(k, hi)
            start = np.where(one, self.zeros[k] + a, start - a)
            lo = np.where(one, self.zeros[k] + b, lo - b)
            hi = np.where(one, self.zeros[k] + c, hi - c)
        return start, lo, hi

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros_like(at)
        start = np.zeros_like(at)
        for k in range(self.levels):
            one = (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(k, start), self._ones(k, at)
            symbol = symbol << 1 | one
            start = np.where(one, self.zeros[k] + a, start - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return symbol, at - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; only suffixes that still tie are sorted again. A symbol 0 is a barrier: barriers differ, in the order of their places."""
    n = len(symbols)
    rank = symbols.astype(np.int64).copy()
    barrier = np.flatnonzero(rank == 0)
    rank[rank > 0] += len(barrier) - 1
    rank[barrier] = np.arange(len(barrier))
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    width = 1
    while width < n:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        head = rank[own]
        key = np.lexsort((rank[np.minimum(own + width, n)], head))
        own = own[key]
        second = rank[np.minimum(own + width, n)]
        head = rank[own]
        order[at] = own
        first = np.concatenate(([True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])))
        new[at] = first
        rank[own] = np.maximum.accumulate(np.where(first, at, 0))
        width *= 2
    return order


class FMIndex:
    """Symbols 1..sigma-1 with 0 as the barrier. Places are those of the symbols given."""

    def __init__(self, symbols: np.ndarray, sigma: int, step: int = 8):
        symbols = np.append(symbols, 0)  # the end is a barrier; so is what comes before the start
        suffixes = suffix_array(symbols)
        self.tree = WaveletTree(symbols[suffixes - 1], sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        self.step = step
        # Walks end at the latest behind a barrier: barriers are told apart by their places, so stepping back over one is undefined.
        sampled = (suffixes % step == 0) | (symbols[suffixes - 1] == 0)
        self.marks = WaveletTree(sampled.astype(np.int64), 2)
        self.samples = suffixes[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, which are rows of symbols padded at the front; symbols are above 0."""
        width = phrases.shape[1]
        last = phrases[:, -1]
        lo, hi = self.before[last], self.before[last + 1]
        alive = np.flatnonzero(hi > lo)
        for k in range(1, width):
            alive = alive[(hi[alive] > lo[alive])]
            now = alive[lengths[alive] > k]
            if not len(now):
                continue
            symbol = phrases[now, width - 1 - k]
            start, a, b = self.tree.rank(symbol, lo[now], hi[now])
            lo[now], hi[now] = self.before[symbol] + a - start, self.before[symbol] + b - start
        return lo, np.maximum(hi, lo)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and place of every occurrence."""
        n = hi - lo
        phrase = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        place = np.full(len(at), -1, np.int64)
        open_ = np.arange(len(at))
        walked = np.zeros(len(at), np.int64)
        for _ in range(self.step):
            if not len(open_):
                break
            marked, rank = self.marks.step(at[open_])
            done = marked == 1
            place[open_[done]] = self.samples[rank[done]] + walked[open_[done]]
            open_ = open_[~done]
            symbol, rank = self.tree.step(at[open_])
            at[open_] = self.before[symbol] + rank
            walked[open_] += 1
        return phrase, place


@dataclass(frozen=True)
class Phrases:
    """Distinct test phrases as rows of symbols, and the items that hold them."""

    vocabulary: np.ndarray  # sorted hashes; a word's symbol is its place plus one
    symbols: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray  # pairs (phrase, item), sorted by phrase
    item_ids: np.ndarray
    window: int


def phrases(items: list[tuple], window: int) -> Phrases:
    """Windows of consecutive words of (id, text) items; an item with fewer words, but not none, is one window. Null ids and texts have none."""
    items = [(i, t) for i, t in items if i is not None and t is not None]
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    hashes, _, _, row = split_words(data, offsets)
    vocabulary = np.unique(hashes)
    symbol = np.searchsorted(vocabulary, hashes) + 1
    bounds = np.searchsorted(row, np.arange(len(items) + 1))
    size = np.diff(bounds)
    # Where a window begins: at each word that has enough words behind it, and at the first word of a shorter item.
    start = np.flatnonzero(np.arange(len(row)) <= bounds[row] + np.maximum(size[row] - window, 0))
    of, length = row[start], np.minimum(size[row[start]], window)
    back = length[:, None] - window + np.arange(window)  # the place in its window that a column holds, negative in front of a short one
    table = np.where(back >= 0, symbol[np.minimum(start[:, None] + np.maximum(back, 0), max(len(symbol) - 1, 0))] if len(symbol) else 0, 0).astype(np.int64)
    table, phrase = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
    both = np.unique(phrase.ravel().astype(np.int64) << 32 | of)
    pairs = np.column_stack([both >> 32, both & 0xFFFFFFFF])
    return Phrases(vocabulary, table, (table > 0).sum(axis=1), pairs, np.array([str(i) for i, _ in items], dtype=object), window)


def passes(benchmark: DataFrame, item: str, text: str, window: int, max_phrases: int) -> Iterator[Phrases]:
    """The benchmark's phrases in parts of about ``max_phrases``, an item whole in one part. Items come to the driver partition by partition, and no more than a part of them is kept."""
    part, size = [], 0
    for i, t in benchmark.select(F.col(item), F.col(text)).filter(F.col(item).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        part.append((i, t))
        size += len(t) // 2 + 1  # a word and the gap behind it have two characters at least
        if size > max_phrases:
            yield phrases(part, window)
            part, size = [], 0
    if part:
        yield phrases(part, window)


def _spans(p: Phrases, hashes: np.ndarray, row: np.ndarray, shard_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place in words) of every occurrence, from one index per shard."""
    if not len(hashes) or not len(p.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol = np.searchsorted(p.vocabulary, hashes)
    known = p.vocabulary[np.minimum(symbol, len(p.vocabulary) - 1)] == hashes
    symbol = np.where(known, symbol + 1, 0)
    out = []
    for at in range(0, len(hashes), shard_words):
        to = min(len(hashes), at + shard_words)
        # What begins in this shard may end in the next one.
        end = min(len(hashes), to + p.window - 1)
        s, r = symbol[at:end], row[at:end]
        new_text = np.concatenate(([False], r[1:] != r[:-1]))
        barrier = s == 0
        kept = ~barrier | np.concatenate(([True], ~barrier[:-1]))
        place = np.flatnonzero(kept)
        value = s[place]
        # A text that begins with a known word right after another one gets a barrier in front.
        gap = np.flatnonzero(new_text[place] & (value > 0) & (np.concatenate(([0], value[:-1])) > 0))
        value, place = np.insert(value, gap, 0), np.insert(place, gap, -1)
        index = FMIndex(value, len(p.vocabulary) + 1)
        phrase, where = index.locate(*index.search(p.symbols, p.lengths))
        where = place[where]
        inside = where < to - at
        out.append((phrase[inside], where[inside] + at))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _search(p: Phrases, shard_words: int, first: bool, finish: Callable | None):
    """One pass. Rows carry the words that are hit (``marks``, begins and ends in turn) and the ``items`` found so far; the last pass makes the result of them by ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SHARD_BYTES):
                data, offsets = utf8(part.column("text"))
                n = len(offsets) - 1
                hashes, start, end, row = split_words(data, offsets)
                bounds = np.searchsorted(row, np.arange(n + 1))
                cover = np.zeros(len(hashes) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(n)] if first else [set(x) for x in part.column("items").to_pylist()]
                if not first:
                    marks = part.column("marks")
                    sizes = marks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    at = marks.flatten().to_numpy(zero_copy_only=False) + np.repeat(bounds[:-1], sizes)
                    np.add.at(cover, at[::2], 1)
                    np.add.at(cover, at[1::2], -1)
                phrase, place = _spans(p, hashes, row, shard_words)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + p.lengths[phrase], -1)
                lo, hi = np.searchsorted(p.item_of[:, 0], [phrase, phrase + 1])
                each = hi - lo
                pick = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
                for x in np.unique(np.repeat(row[place], each) << 32 | p.item_of[pick, 1]).tolist():
                    items[x >> 32].add(p.item_ids[x & 0xFFFFFFFF])
                hit, listed = np.cumsum(cover)[:-1] > 0, [sorted(x) for x in items]
                if finish is not None:
                    yield finish(part, data, offsets, start, end, row, bounds, hit, listed)
                    continue
                s, e, r = runs(hit, bounds)
                flat = (np.column_stack([s, e]) - bounds[r][:, None]).ravel()
                ends = np.concatenate(([0], np.cumsum(2 * np.bincount(r, minlength=n)))).astype(np.int32)
                state = {"marks": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())), "items": pa.array(listed, pa.list_(pa.string()))}
                kept = {f.name: part.column(f.name) for f in part.schema if f.name not in state}
                yield pa.RecordBatch.from_pydict(kept | state)

    return run


def _finish(keep_spans: bool):
    def make(part, data, offsets, start, end, row, bounds, hit, listed) -> pa.RecordBatch:
        n = len(listed)
        columns = {
            "id": part.column("id"),
            "n_words": pa.array(np.diff(bounds), pa.int64()),
            "n_hit": pa.array(np.bincount(row[hit], minlength=n), pa.int64()),
            "n_items": pa.array([len(x) for x in listed], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()),
        }
        if keep_spans:
            s, e, r = runs(hit, bounds)
            spans: list[list[dict]] = [[] for _ in range(n)]
            # Bytes to code points: continuation bytes do not count.
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            base = points[offsets[:-1]]
            for a, b, k in zip(start[s].tolist(), end[e - 1].tolist(), r.tolist()):
                spans[k].append({"start": int(points[a] - base[k]), "end": int(points[b] - base[k])})
            columns["name"] = part.column("name")
            columns["items"] = pa.array(listed, pa.list_(pa.string()))
            columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_pydict(columns)

    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, window: int = 10, keep_spans: bool = False, max_phrases: int = 2_000_000, shard_words: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256 and, with ``keep_spans``, a hash that names the text, items and merged spans of code points.

    A benchmark of more than about ``max_phrases`` windows is searched in passes over the documents, each of which writes its state to the
    shared folder; the driver and a task hold the phrases of one pass (the driver those of the next one too), whatever the benchmark's size.
    Words are compared after lower-casing A-Z. Null and empty texts have no words and no hits; repeated rows are judged each by itself; an empty
    benchmark or table gives no hits or no rows; a null item is none. Other columns of either table are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *([F.xxhash64(text).alias("name")] if keep_spans else []))
    carried = f"id {kind}, text {docs.schema[text].dataType.simpleString()}, " + ("name long, " if keep_spans else "") + "marks array<long>, items array<string>"
    todo, first = passes(benchmark, item, item_text, window, max_phrases), True
    p = next(todo, None) or phrases([], window)
    while (after := next(todo, None)) is not None:
        state = cut(state.mapInArrow(tidy(_search(p, shard_words, first, None)), carried))
        p, first = after, False
    schema = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string" + (", name long, items array<string>, spans array<struct<start:long,end:long>>" if keep_spans else "")
    return state.mapInArrow(tidy(_search(p, shard_words, first, _finish(keep_spans))), schema)


def without_spans(docs: DataFrame, found: DataFrame, key: str, text: str, most: float) -> DataFrame:
    """``docs`` without those of which more than the share ``most`` of words is hit, and with the spans cut from the others' texts.

    Only rows with hits are joined: their keys are few against the corpus, and are broadcast if ``found`` has at most a million. Rows that
    repeat a key are cut by their own text's spans.
    """
    name, share, spans = (unused(c, docs) for c in ("__name", "__share", "__spans"))
    hit = cut(found.filter("n_hit > 0").select(F.col("id").alias(key), F.col("name").alias(name), (F.col("n_hit") / F.col("n_words")).alias(share), F.col("spans").alias(spans)).distinct())
    few = hit.count() <= 1_000_000
    named = docs.withColumn(name, F.xxhash64(text))
    joined = named.join(F.broadcast(hit) if few else hit, [key, name], "left").filter(F.coalesce(share, F.lit(0.0)) <= most)
    pieces = F.aggregate(
        spans,
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(F.col(text), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))).alias("text"), s["end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text), acc["at"].cast("int") + 1, F.length(text))),
    )
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), pieces).otherwise(F.col(text))).select(*docs.columns)
