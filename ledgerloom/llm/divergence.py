"""Source divergence audit: how far the word use of each source lies from that of other sources and of its language.

Tasks turn texts into counts by a byte-level tokenizer; shares, sums and ranks are whole numbers, so results do not depend on the order of work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, cut, runs, tidy, utf8

#: Bytes of terms: ASCII letters and all bytes of other characters.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[65:91] = TERM_BYTE[97:123] = TERM_BYTE[128:] = True
#: The bytes of terms in lower case, and spaces for all others.
SPACED = np.where(TERM_BYTE, LOWER, 32).astype(np.uint8)
#: Bytes of text that are counted at a time.
CHUNK = 8 << 20
#: Entries of a block of the term-by-source matrix, and sources of a side of it.
ENTRIES, SIDE = 1 << 15, 256
#: Parts in which shares are counted.
SCALE = 1_000_000_000
#: Parts into which a join by group deals the rows of each group, as one group may hold a third of all.
SALT = 64

_COUNTS = "lang string, source string, term string, n long, docs long"


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Whether the slices that begin at a and at b, of one byte at least, hold the same bytes."""
    same = size_a == size_b
    at = np.flatnonzero(same)
    ends = np.cumsum(size_a[at])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block, side="right")))
        part = at[lo:hi]
        n = size_a[part]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        differs = data[np.repeat(a[part], n) + step] != data[np.repeat(b[part], n) + step]
        same[part] = ~np.logical_or.reduceat(differs, first)
        lo = hi
    return same


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each slice the number of its term, and for each term a slice that holds it. What lies between slices are ASCII spaces, and no slice holds one.

    Slices of one hash are compared byte by byte with the first of them; those that differ become terms of their own.
    """
    raw = data.tobytes()
    hashes = np.fromiter(map(digest, raw.split()), np.uint64, len(starts))
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    model = first[term]
    others: dict[bytes, int] = {}
    models = []
    for i in np.flatnonzero(~same_bytes(data, starts, starts[model], size, size[model])).tolist():
        word = raw[starts[i] : ends[i]]
        if word not in others:
            others[word] = len(first) + len(others)
            models.append(i)
        term[i] = others[word]
    return term, np.concatenate((first, np.array(models, first.dtype)))


def chunks(data: np.ndarray, offsets: np.ndarray, budget: int = CHUNK) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, start, end) of ranges of about this many bytes: several whole texts, or a part of one that ends where no term goes on."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + budget, side="right")) - 1)
        at, end = int(offsets[row]), int(offsets[to])
        while end - at > budget:  # one long text
            edge = at + budget
            while edge < end and TERM_BYTE[data[edge]]:
                edge += 1
            yield row, to, at, edge
            at = edge
        yield row, to, at, end
        row = to


def _rows(lang: pa.Array, source: pa.Array, words: list[bytes], n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    term = pa.array(words, pa.binary()).view(pa.string())
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by group for each chunk of texts, and one row without a term for each group."""
    for batch in batches:
        lang, source = batch.column("lang"), batch.column("source")
        kinds: dict[tuple[str, str], int] = {}
        group = np.array([kinds.setdefault(k, len(kinds)) for k in zip(lang.to_pylist(), source.to_pylist())], np.int64)
        langs, sources = (pa.array([k[i] for k in kinds], pa.string()) for i in (0, 1))
        nothing = pa.nulls(len(kinds), pa.string())
        zero = pa.array(np.zeros(len(kinds), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, nothing, zero, zero], names=["lang", "source", "term", "n", "docs"])
        data, offsets = utf8(batch.column("text"))
        long: Counter[bytes] = Counter()
        for row, to, start, end in chunks(data, offsets):
            ends = np.clip(offsets[row : to + 1], start, end) - start
            # Lower case, with a space after each text and in place of all that is no term.
            part = np.full(end - start + to - row, 32, np.uint8)
            part[np.arange(end - start) + np.repeat(np.arange(to - row), np.diff(ends))] = SPACED[data[start:end]]
            a, b, of = runs(TERM_BYTE[part], np.append(ends[:-1] + np.arange(to - row), len(part)))
            raw = part.tobytes()
            whole = start == offsets[row] and end == offsets[to]
            if len(a):
                term, model = grouped(part, a, b)
                words = [raw[a[i] : b[i]] for i in model.tolist()]
                if whole:
                    one, times = np.unique(of * len(words) + term, return_counts=True)  # a term of a text
                    key, back = np.unique(group[row + one // len(words)] * len(words) + one % len(words), return_inverse=True)
                    n, docs = np.bincount(back, weights=times).astype(np.int64), np.bincount(back)
                    g = pa.array(key // len(words))
                    yield _rows(langs.take(g), sources.take(g), [words[i] for i in (key % len(words)).tolist()], n, docs)
                else:
                    long.update(dict(zip(words, np.bincount(term).tolist())))
            if long and end == offsets[to]:
                g = pa.array([int(group[row])] * len(long))
                yield _rows(langs.take(g), sources.take(g), list(long), np.array(list(long.values())), np.ones(len(long), np.int64))
                long = Counter()


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept))


def _excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / size), three digits at a time, so that counts above 2^33 fit as well."""
    whole, rest = np.divmod(n + 1, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return whole + 1


def _diverge(table: pa.Table) -> pa.Table:
    """What a block of terms and two sides of sources adds to the divergence of each ordered pair of sources.

    With p0 and q0 the shares of absent terms, f summed over all terms is the sum over b's terms of f(p0, q), plus the sum over a's terms of
    f(p, q) - f(p0, q), plus f(p0, q0) for each term that b lacks. The first two are summed here, over rows of a sparse matrix; the last is added later.
    """
    lang, side, other = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
    column = lambda t, c: t.column(c).to_numpy()
    present = table.column("term").is_valid()
    heads = table.filter(table.column("term").is_null()).sort_by("s")
    source, size = column(heads, "s"), column(heads, "size")
    found = table.filter(present).select(["s", "size", "n", "term"]).combine_chunks()
    size = np.maximum(size, 1)
    absent = shares(np.zeros(len(size), np.int64), size)
    row = np.searchsorted(source, column(found, "s"))
    term = found.column("term").combine_chunks().dictionary_encode()
    term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(row, kind="stable")
    row, term = row[order], term[order]
    p = shares(column(found, "n")[order], size[row])
    start = np.searchsorted(row, np.arange(len(source) + 1))
    full = np.flatnonzero(np.diff(start))  # reduceat would read on in an empty row
    f = lambda x, y: (x - y) * (x - y) // y
    of = column(heads, "side")
    q = np.empty(int(term.max()) + 1 if len(term) else 0, np.int64)
    a_out, b_out, v_out = [], [], []
    for b in range(len(source)):
        own = slice(start[b], start[b + 1])
        q[:] = absent[b]
        q[term[own]] = p[own]
        values, times = np.unique(p[own], return_counts=True)
        total = (f(absent[:, None], values[None, :]) * times).sum(axis=1)
        if len(full):
            at = q[term]
            total[full] += np.add.reduceat(f(p, at) - f(absent[row], at), start[full])
        a = np.flatnonzero((of == (other if of[b] == side else side)) & (np.arange(len(source)) != b))
        a_out.append(source[a])
        b_out.append(np.full(len(a), source[b]))
        v_out.append(total[a])
    out = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in (("a", a_out), ("b", b_out), ("value", v_out))}
    return pa.table({"lang": pa.array([lang] * len(out["a"]), pa.string()), **{k: pa.array(v.astype(np.int64)) for k, v in out.items()}})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200, entries_each: int = ENTRIES, sources_each: int = SIDE) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of one language and source.

    Terms are runs of letters of ASCII, in lower case, and of all other characters. A language keeps the V terms that ``least`` of its documents hold. A term
    with count c among the N kept occurrences of a group, or of the language, has the share p = 1 + floor(10^9 (c + 1) / (N + V)), and f = floor((p - q)^2 / q).
    ``pair`` rows give f from each group to each other source of its language, summed over all kept terms; ``term`` rows the ``top`` terms of the group whose
    share lies above the language's. Ranks count from 1, by value from above and then by the bytes of the item.

    Null text, language or source is an empty one. Empty texts and texts without a kept term still make a group, whose shares are all alike; a language
    without kept terms has pairs of value 0 and no term rows. Long texts are counted in parts, and need memory for their distinct terms only. Repeated rows count
    each as a document. An empty table has no rows. Further columns are not read.
    """
    read = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = read.mapInArrow(tidy(_count), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    alike = Window.partitionBy("lang", "term")
    known = counts.withColumns({"held": F.sum("docs").over(alike), "all_n": F.sum("n").over(alike), "leads": F.min("source").over(alike) == F.col("source")})
    entries = cut(known.filter(F.col("term").isNull() | (F.col("held") >= least)).select("lang", "source", "term", "n", "all_n", "leads"))
    by_lang = Window.partitionBy("lang")
    real = F.col("term").isNotNull()
    groups = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("term").alias("held"), F.count_if(real & F.col("leads")).alias("led"))
    groups = groups.withColumns({"kept": F.sum("led").over(by_lang), "lang_size": F.sum("size").over(by_lang), "lang_held": F.sum("held").over(by_lang)})
    groups = groups.withColumn("s", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1).drop("led")
    groups = cut(groups.withColumn("sides", F.floor(F.max("s").over(by_lang) / sources_each).cast("int")))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    placed = entries.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")).join(salted, ["lang", "source", "salt"])

    p, q = _share(F.col("n"), F.col("size"), F.col("kept")), _share(F.col("all_n"), F.col("lang_size"), F.col("kept"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = placed.filter(real).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = over.select("lang", "source", F.lit("term").alias("part"), "item", _excess(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("lang_held") / entries_each)).cast("int")
    block = F.when(real, F.array(F.pmod(F.xxhash64("term", F.lit(1)), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
    dealt = placed.select("lang", "s", "term", "n", (F.col("size") + F.col("kept")).alias("size"), F.explode(block).alias("block"), F.floor(F.col("s") / sources_each).cast("int").alias("side"), "sides")
    dealt = dealt.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("sides"))))
    dealt = dealt.select("lang", "block", F.least("side", "facing").alias("i"), F.greatest("side", "facing").alias("j"), "side", "s", "size", "n", "term")
    parts = dealt.groupBy("lang", "block", "i", "j").applyInArrow(_diverge, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    absent = _share(F.lit(0), F.col("size"), F.col("kept"))
    rows = groups.select("lang", F.col("s").alias("a"), "source", F.when(F.col("kept") > 0, absent).alias("p0"))
    columns = groups.select("lang", F.col("s").alias("b"), F.col("source").alias("item"), F.when(F.col("kept") > 0, absent).alias("q0"), (F.col("kept") - F.col("held")).alias("lacks"))
    value = F.when(F.col("q0").isNull(), 0).otherwise(F.col("value") + F.col("lacks") * _excess(F.col("p0"), F.col("q0")))
    pairs = parts.join(rows, ["lang", "a"]).join(columns, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranks)).unionByName(terms)
