"""The divergence audit against sums over all terms in plain Python, hash collisions and long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from ledgerloom.llm import divergence as d

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(FOLD))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    kept = {g: sorted(t for t, n in held[g].items() if n >= 3) for g in {k[0] for k in counts}}
    share = lambda n, size, v: 1 + 10**9 * (n + 1) // (size + v)
    out = []
    for lang, terms in kept.items():
        sources = sorted(s for g, s in counts if g == lang)
        n = {s: [counts[lang, s][t] for t in terms] for s in sources}
        p = {s: [share(x, sum(n[s]), len(terms)) for x in n[s]] for s in sources}
        every = [sum(x) for x in zip(*n.values())]
        q = [share(x, sum(every), len(terms)) for x in every]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            over = [(t, f(a, b)) for t, a, b, c in zip(terms, p[s], q, n[s]) if c and a > b]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def documents(seed, n, sources=7, words=60):
    rand = random.Random(seed)
    vocab = ["".join(rand.choice("abcÉß日Z") for _ in range(rand.randrange(1, 12))) for _ in range(words)]
    out = []
    for _ in range(n):
        s = rand.randrange(sources)
        mine = vocab[s * 3 :][: words // 2]
        text = "".join(rand.choice(mine) + rand.choice([" ", "\n", "1", "--", "\x7f", "@"]) for _ in range(rand.randrange(40)))
        out.append((rand.choice([text, text, text, None, ""]), rand.choice(["en", "en", "de", None, ""]), rand.choice([None, f"s{s}", f"s{s}"])))
    return out + [("only once", "xx", "a"), (None, "yy", "b"), ("1 2 3", "yy", "c")]


def found(df):
    return sorted(tuple(r) for r in df.collect())


KINDS = "text string, lang string, source string"


def test_audit_term_by_term(spark):
    rows = documents(1, 300)
    got = found(d.audit(spark.createDataFrame(rows, KINDS).repartition(5)))
    assert got == plain(rows) and {r[2] for r in got} == {"pair", "term"}
    assert found(d.audit(spark.createDataFrame(rows, KINDS), top=2)) == plain(rows, 2)


def test_blocks_of_terms_and_sides_of_sources(spark):
    rows = documents(2, 500, sources=13)
    for side in (1, 4):
        assert found(d.audit(spark.createDataFrame(rows, KINDS).repartition(5), entries_each=20, sources_each=side)) == plain(rows)


def test_terms_of_one_hash_are_told_apart():
    rand = random.Random(3)
    words = [bytes(rand.choices(b"ab\xc3\xa9", k=rand.randrange(1, 5))) for _ in range(500)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for digest in (lambda b: 7, lambda b: len(b), hash):
        term, model = d.grouped(data, starts, ends, lambda b: digest(b) & 0xFFFFFFFFFFFFFFFF)
        raw = data.tobytes()
        named = [raw[starts[i] : ends[i]] for i in model]
        assert [named[t] for t in term] == words and len(set(named)) == len(named)


def test_same_bytes_in_blocks():
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    a, b = np.array([0, 0, 0]), np.array([3, 6, 5])
    size = np.array([3, 3, 5])
    for block in (1, 4, 100):
        assert d.same_bytes(data, a, b, size, size, block).tolist() == [False, True, False]
    assert d.same_bytes(data, a, b, size, size - 1).tolist() == [False] * 3


def test_long_texts_in_parts():
    data = np.frombuffer(b"ab cd " * 50 + b"x" * 40 + b" e", np.uint8)
    offsets = np.array([0, 6, 12, 12, len(data)])
    got = list(d.chunks(data, offsets, 20))
    assert got[0] == (0, 3, 0, 12) and got[1][:3] == (3, 4, 12) and got[-1][3] == len(data)
    assert all(x[3] == y[2] for x, y in zip(got, got[1:]))
    assert all(not (d.TERM_BYTE[data[x[3] - 1]] and d.TERM_BYTE[data[x[3]]]) for x in got[1:-1])


def test_odd_tables(spark):
    assert found(d.audit(spark.createDataFrame([], KINDS))) == []
    rows = [("word " * 2_500_000 + "tail", "en", "a"), ("word tail", "en", "b"), ("tail word", "en", "b"), ("word", "en", "b")]
    assert found(d.audit(spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS + ", term int, part string"))) == plain(rows)


def test_shares_of_large_counts():
    n, size = np.array([0, 5, 10**13]), np.array([3, 6, 10**13 + 17])
    assert d.shares(n, size).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), size.tolist())]
