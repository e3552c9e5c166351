"""Quality classifier: a generalised additive model with pairwise interactions.

Features are statistics of a whole text. The model is an intercept, a lookup table over quantile bins for each feature, and a table over
coarser bins for each selected pair. Cyclic boosting fits them: round by round each feature in turn gets a small regression tree of its
bins (three leaves) on the logistic loss' gradients, added to its table at a small rate; then pairs are ranked by the gain of a four-leaf tree on
the residuals and the best are boosted in the same way. A score is a sum of table entries: vectorised bin additions.

Features take one pass over Arrow batches in bounded slices. The model is fitted on a bounded sample of the labelled rows (``sample``, those
with the least hashes); everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, by_bytes, runs, tidy, utf8, word_hashes

FEATURES = ["log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "marks", "pipes", "high_bytes", "log_lines", "line_length", "distinct_words", "repeated_lines", "top_word", "capital_words", "word_spread", "repeated_pairs"]
SLICE = 1 << 21
_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_SYMBOL = np.isin(_CODE, [ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"])
_MARK = np.isin(_CODE, [ord(c) for c in "!\"'(),-.:;?"])
_SPACE = (_CODE == 32) | ((_CODE >= 9) & (_CODE <= 13))


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values and the count of the most frequent one, by row; of a 64-bit hash 43 bits tell values of one row apart."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    v = np.sort(row.astype(np.uint64) << np.uint64(43) | value >> np.uint64(21))  # a slice has fewer than 2 ** 21 rows
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    r = (v[first] >> np.uint64(43)).astype(np.int64)
    size = np.diff(np.append(first, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, r, size)
    return np.bincount(r, minlength=n).astype(float), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros in all but none."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)

    s, e, row = runs(~_SPACE[data], offsets)
    words = np.bincount(row, minlength=n).astype(float)
    length = (e - s).astype(float)
    mean = np.bincount(row, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, n) / np.maximum(words, 1) - mean**2, 0))
    hashes = word_hashes(LOWER[data], s, e) if len(s) else np.zeros(0, np.uint64)
    kinds, top = _distinct(row, hashes, n)
    same = row[1:] == row[:-1]
    pairs = (hashes[1:] * np.uint64(3) + hashes[:-1])[same] if len(s) > 1 else np.zeros(0, np.uint64)
    pair_row = row[1:][same] if len(s) > 1 else np.zeros(0, np.int64)
    n_pairs = np.bincount(pair_row, minlength=n)
    pair_kinds, _ = _distinct(pair_row, pairs, n)
    capital = np.bincount(row, _UPPER[data[s]] if len(s) else None, n) if len(s) else np.zeros(n)
    ls, le, lrow = runs(data != 10, offsets)
    lines = np.bincount(lrow, minlength=n).astype(float)
    line_kinds, _ = _distinct(lrow, word_hashes(data, ls, le) if len(ls) else np.zeros(0, np.uint64), n)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(_CODE == 124), share(_CODE >= 128), np.log1p(lines), size / np.maximum(lines, 1),
        kinds / np.maximum(words, 1), 1 - line_kinds / np.maximum(lines, 1), top / np.maximum(words, 1), capital / np.maximum(words, 1), spread, 1 - pair_kinds / np.maximum(n_pairs, 1),
    ])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, "text", SLICE):
            x = features(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.float64()) for c in x.T)], names=["id", *FEATURES])


def extract(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, FEATURES) of every row over its whole text, however long; null texts count as empty, repeated rows give equal rows, an empty table none. Other columns are ignored."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} double" for c in FEATURES)
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(tidy(_extract), schema)


@dataclass
class Model:
    intercept: float = 0.0
    #: upper edges of all bins but the last, by feature.
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: (feature, feature, coarse edges, coarse edges, table)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of a small tree on the bins of one feature: best splits first."""
    cuts = [0, len(g)]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    while len(cuts) - 1 < leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = value(a, at) + value(at, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(at[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return step


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best four-leaf tree on a grid that cuts both features once: its gain and its step."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    score = lambda a, b: a * a / (b + ridge)
    g1, g2, g3 = G[:-1, :-1], G[:-1, -1:] - G[:-1, :-1], G[-1:, :-1] - G[:-1, :-1]
    h1, h2, h3 = H[:-1, :-1], H[:-1, -1:] - H[:-1, :-1], H[-1:, :-1] - H[:-1, :-1]
    g4, h4 = G[-1, -1] - g1 - g2 - g3, H[-1, -1] - h1 - h2 - h3
    gain = score(g1, h1) + score(g2, h2) + score(g3, h3) + score(g4, h4) - score(G[-1, -1], H[-1, -1])
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty_like(g)
    for rows, cols, a, b in ((slice(0, i + 1), slice(0, j + 1), g1, h1), (slice(0, i + 1), slice(j + 1, None), g2, h2), (slice(i + 1, None), slice(0, j + 1), g3, h3), (slice(i + 1, None), slice(j + 1, None), g4, h4)):
        step[rows, cols] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, rounds: int = 300, rate: float = 0.08, n_pairs: int = 8, pair_rounds: int = 100, ridge: float = 5.0) -> Model:
    """Fit to rows of features and labels 0 or 1. With one class only, or no row, the model is its intercept."""
    m = Model()
    rate_of_one = (y.sum() + 0.5) / (len(y) + 1)
    m.intercept = float(np.log(rate_of_one / (1 - rate_of_one)))
    m.edges = [_edges(c, bins) if len(y) else np.zeros(0) for c in x.T]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    if not len(y) or y.min() == y.max():
        return m
    at = [np.searchsorted(e, c) for e, c in zip(m.edges, x.T)]
    f = np.full(len(y), m.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(at):
            g, h = gradients()
            step = rate * _tree(np.bincount(b, g, len(m.tables[k])), np.bincount(b, h, len(m.tables[k])), 3, ridge)
            m.tables[k] += step
            f += step[b]
    small = [_edges(c, coarse) for c in x.T]
    low = [np.searchsorted(e, c) for e, c in zip(small, x.T)]
    g, h = gradients()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = (len(small[i]) + 1, len(small[j]) + 1)
            cell = low[i] * shape[1] + low[j]
            ranked.append((_cross(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), ridge)[0], -i, -j))
    chosen = [(-i, -j) for gain, i, j in sorted(ranked, reverse=True)[:n_pairs] if gain > 0]
    m.pairs = [(i, j, small[i], small[j], np.zeros((len(small[i]) + 1, len(small[j]) + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, _, _, table in m.pairs:
            g, h = gradients()
            cell = low[i] * table.shape[1] + low[j]
            step = rate * _cross(np.bincount(cell, g, table.size).reshape(table.shape), np.bincount(cell, h, table.size).reshape(table.shape), ridge)[1]
            table += step
            f += step.ravel()[cell]
    return m


def decide(m: Model, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), m.intercept)
    for e, t, c in zip(m.edges, m.tables, x.T):
        f += t[np.searchsorted(e, c)]
    for i, j, a, b, t in m.pairs:
        f += t[np.searchsorted(a, x[:, i]), np.searchsorted(b, x[:, j])]
    return 1 / (1 + np.exp(-f))


def train(found: DataFrame, labels: DataFrame, key: str, label: str, sample: int = 20000, **options) -> Model:
    """Fit on at most ``sample`` labelled rows, those with the least hashes of their keys. Null labels and keys are left out; of rows that repeat a key the one with the least features is taken. An empty table gives a model that is only its intercept."""
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    one = found.join(given, "id").groupBy("id", "y").agg(F.min(F.struct(*FEATURES)).alias("x"))
    rows = one.orderBy(F.xxhash64("id"), "id").limit(sample).select("y", "x.*", "id").orderBy("id").toPandas()
    return fit(rows[FEATURES].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float), **options)


def _apply(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(decide(m, x))], names=["id", "score"])

    return run


def score(found: DataFrame, m: Model) -> DataFrame:
    """(id, score) of every row: 0 to 1, higher the likelier the label 1. Null and empty texts have the features of an empty text and a score too."""
    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(_apply(m), f"id {kind}, score double")
