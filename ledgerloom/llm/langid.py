"""Language ID by multilingual mixture inference.

Learning counts byte trigrams around each letter per language (letters: ASCII letters in lower case and all bytes above 127; anything else is
a word boundary) and smooths them. A document is a mixture of languages: each word is drawn from one of them, with its trigrams'
likelihood. Expectation-maximisation estimates the proportions. The set of languages is selected by penalised likelihood: from the single
best language to all of them, in the order of the full mixture's proportions, each further one must raise the log-likelihood by
``penalty * ln(words) / 2``. The prediction is the language with the largest proportion in the selected set, its score that proportion.

Learning is one pass that sums counts per (language, trigram) on the cluster, so the model is as large as the languages' alphabets, not as
the corpus. Prediction is one pass over Arrow batches in bounded slices, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, by_bytes, runs, tidy, unused, utf8

#: Letters keep their (lower-case) byte, everything else is 32.
_LETTER = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)
SLICE = 1 << 21
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: log probability by trigram bucket and language, float32.
    weights: np.ndarray
    penalty: float


def _trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter bytes and the bucket of the trigram centred on each byte; texts are set apart by boundaries."""
    b = _LETTER[data]
    wide = b.astype(np.uint32)
    before = np.empty_like(wide)
    before[:1] = 32
    before[1:] = wide[:-1]
    after = np.empty_like(wide)
    after[-1:] = 32
    after[:-1] = wide[1:]
    filled = offsets[1:][np.diff(offsets) > 0]
    before[offsets[:-1][np.diff(offsets) > 0]] = 32
    after[filled - 1] = 32
    code = (before << np.uint32(16)) | (wide << np.uint32(8)) | after
    return b, (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                data, offsets = utf8(part.column("text"))
                b, gram = _trigrams(data, offsets, bits)
                lang = part.column("lang").dictionary_encode()
                names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
                of = np.repeat(codes, np.diff(offsets))
                inside = b != 32
                both = np.bincount(of[inside].astype(np.int64) << bits | gram[inside], minlength=len(names) << bits)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + both[k << bits : (k + 1) << bits]
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "gram", "n"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = 16, smoothing: float = 0.5, penalty: float = 4.0) -> Model:
    """Learn from all rows with a language. Languages are ordered by name; a table without any gives a model that predicts ``und``."""
    given = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = given.mapInArrow(tidy(_count(bits)), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), 1 << bits))
    at = {name: i for i, name in enumerate(languages)}
    counts[sums["lang"].map(at).to_numpy(dtype=np.int64), sums["gram"].to_numpy()] = sums["n"].to_numpy()
    counts += smoothing
    weights = np.log(counts / counts.sum(axis=1, keepdims=True))
    return Model(languages, np.ascontiguousarray(weights.T, dtype=np.float32), penalty)


def _mixture(like: list[np.ndarray], share: np.ndarray, row: np.ndarray, first: np.ndarray, words: np.ndarray, steps: int) -> np.ndarray:
    """Proportions (languages, rows) after some steps from ``share``; a language with none keeps none. like: relative to each word's best language."""
    live = [k for k in range(len(like)) if share[k].any()]
    for _ in range(steps):
        parts = [like[k] * share[k][row] for k in live]
        scale = 1 / np.maximum(sum(parts), 1e-30)
        for k, part in zip(live, parts):
            share[k][row[first]] = np.add.reduceat(part * scale, first) / words[row[first]]
    return share


def infer(model: Model, data: np.ndarray, offsets: np.ndarray, steps: int = 6, resteps: int = 3) -> np.ndarray:
    """Proportions of each language by row; a row without letters has only zeros."""
    n, k = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, k))
    if not len(data) or not k:
        return out
    bits = int(np.log2(len(model.weights)))
    b, gram = _trigrams(data, offsets, bits)
    starts, ends, row = runs(b != 32, offsets)
    if not len(starts):
        return out
    logs = []
    for j in range(k):
        sums = np.zeros(len(data) + 1)
        np.cumsum(model.weights[:, j][gram], out=sums[1:])
        logs.append((sums[ends] - sums[starts]).astype(np.float32))
    best = np.maximum.reduce(logs)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    single = np.full((n, k), -np.inf)
    for j in range(k):
        logs[j] -= best
        single[row[first], j] = np.add.reduceat(logs[j], first, dtype=np.float64)
    like = [np.exp(x) for x in logs]
    words = np.bincount(row, minlength=n).astype(np.float32)
    has = words > 0
    full = _mixture(like, np.full((k, n), 1 / k, np.float32), row, first, words, steps)
    order = np.argsort(-full.T, axis=1, kind="stable")
    top = np.where(has, single.argmax(axis=1), 0)
    value = np.where(has, single[np.arange(n), top], 0)
    out[has, top[has]] = 1
    cost = model.penalty * np.log(np.maximum(words, 2)) / 2
    for size in range(2, k + 1):
        share = full
        if size < k:
            allowed = np.zeros((n, k), bool)
            np.put_along_axis(allowed, order[:, :size], True, axis=1)
            share = np.where(allowed.T, np.maximum(full, 1e-6), 0).astype(np.float32)
            share = _mixture(like, share / share.sum(axis=0), row, first, words, resteps)
        fit = np.zeros(n)
        fit[row[first]] = np.add.reduceat(np.log(np.maximum(sum(x * y[row] for x, y in zip(like, share)), 1e-30)), first, dtype=np.float64)
        better = has & (fit - (size - 1) * cost > value)
        value = np.where(better, fit - (size - 1) * cost, value)
        out[better] = share.T[better]
    return out


def _predict(model: Model, own: str):
    from_id = model.languages + [UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, own, SLICE):
                data, offsets = utf8(part.column(own))
                share = infer(model, data, offsets)
                k = len(model.languages)
                pick = share.argmax(axis=1) if k else np.zeros(len(share), np.int64)
                score = share[np.arange(len(share)), pick] if k else np.zeros(len(share))
                letters = pc.fill_null(pc.match_substring_regex(part.column(own), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                pick = np.where((score > 0) & letters, pick, k)
                score = np.where(pick < k, np.clip(score, 0, 1), 0.0)
                names = pa.array(from_id, pa.string()).take(pa.array(pick))
                kept = [part.column(i) for i, f in enumerate(part.schema) if f.name != own]
                yield pa.RecordBatch.from_arrays([*kept, names, pa.array(score, pa.float64())], names=[*(f.name for f in part.schema if f.name != own), "lang_pred", "lang_score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all others than lang_pred and lang_score if None) with lang_pred and lang_score.

    Whole texts are judged. Null texts and texts without a letter get ``und`` and 0; a text whose letters are none that the model
    has words of, as none is left without a model, too. Repeated rows are judged alike; equal proportions go to the first name.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")] if keep is None else keep
    fields = docs.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, lang_score double"
    own = unused("__text", docs)
    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(tidy(_predict(model, own)), schema)
