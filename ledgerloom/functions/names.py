"""Names: normalisation and similarity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ledgerloom.sources.schemas import CONTAINMENT, LEGAL_WORDS

_WORDS = "|".join(w.replace(".", r"\.") for w in LEGAL_WORDS)


def normalize_name(name: Column, strip_dash: bool = False) -> Column:
    """Lower case, without legal words and punctuation, single spaces. Java's regexes need (?U) for Unicode spaces and borders of words."""
    n = F.regexp_replace(F.lower(name), r"(?U)^\s+|\s+$", "")
    n = F.regexp_replace(n, rf"(?U)\b({_WORDS})\b\.?", "")
    n = F.regexp_replace(n, r"[.,\-]" if strip_dash else "[.,]", "")
    n = F.regexp_replace(n, r"(?U)\s+", " ")
    return F.regexp_replace(n, r"(?U)^\s+|\s+$", "")


def contains(a: Column, b: Column, least: int = 1) -> Column:
    """Whether the shorter of two names, of ``least`` characters at least, lies within the other."""
    return (b.contains(a) & (F.length(a) >= least)) | (a.contains(b) & (F.length(b) >= least))


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def score(a: str, b: str, least: int = 1) -> float:
    """1 for equal names, else the ratio, at least CONTAINMENT where one contains the other."""
    if a == b:
        return 1.0
    s = ratio(a, b)
    return max(s, CONTAINMENT) if (len(a) >= least and a in b) or (len(b) >= least and b in a) else s


@pandas_udf(DoubleType())
def ratio_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratios, for pairs that cheap bounds could not decide. Not symmetric: the order of the pair counts."""
    for a, b in batches:
        yield pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def bag_overlap(a: Column, b: Column) -> Column:
    """Characters in common with multiplicity: no less than what any matching of blocks can match."""
    left, right = F.length(a), F.length(b)
    count = lambda s, n, c: n - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(F.least(count(a, left, c), count(b, right, c))))


def may_match(a: Column, b: Column, threshold: float, least: int = 1) -> Column:
    """False only for pairs whose score is surely below the threshold: by lengths, then by characters in common; containment passes."""
    la, lb = F.length(a), F.length(b)
    total = la + lb
    by_length = 2 * F.least(la, lb) >= threshold * total
    by_bag = 2 * bag_overlap(a, b) >= threshold * total
    near = by_length & by_bag
    return near | contains(a, b, least) if threshold <= CONTAINMENT else near
