"""N-gram Jaccard join, decontamination, embeddings, pieces, pipeline."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ledgerloom.llm import common, fmindex, jaccard, pieces, queries, vectors

LOWER = {c: c + 32 for c in range(65, 91)}


def root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_jaccard(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(parent, a), root(parent, b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(parent, i)) for i, s in sets.items()}


def noisy_docs(seed, n=140):
    """Families of edited copies, of 1 to 400 words, with passages in common."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(40)]
    docs = []
    while len(docs) < n:
        w = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 8, 12, 20, 40, 70, 150, 400]))]
        if r.random() < 0.5:
            at = r.randrange(len(w))
            w[at:at] = passage
        for _ in range(r.choice([1, 1, 2, 5])):
            c = list(w)
            for _ in range(r.randint(0, max(1, len(c) // 60))):
                c[r.randrange(len(c))] = word()
            docs.append((len(docs) * 3 % 1009, " ".join(c) if r.random() < 0.9 else "  ".join(c).upper()))
    return docs


def test_jaccard_against_all_pairs(spark):
    for seed in (1, 2):
        docs = noisy_docs(seed)
        df = spark.createDataFrame(docs, "k long, t string").repartition(3)
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, "k", "t").collect()}
        assert got == brute_jaccard(docs)


def found_components(df):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, "k", "t").collect()}


def test_jaccard_with_neighbourhoods(spark, monkeypatch):
    """One-deletion neighbourhoods in all bands, and few segments, find the same links."""
    docs = noisy_docs(5)
    plain = jaccard.allocate

    def deep(cells, percent):
        plan = plain(cells, percent)
        plan.deep[:] = True
        return plan

    monkeypatch.setattr(jaccard, "allocate", deep)
    assert found_components(spark.createDataFrame(docs, "k long, t string")) == brute_jaccard(docs)


def test_neighbourhoods_of_few_segments(monkeypatch):
    """Two sets that differ in at most H tokens index a common signature, whatever the segments and the order."""
    r = np.random.default_rng(2)
    for shift in (60, 58, 56, 0):
        monkeypatch.setattr(jaccard, "_SHIFT", np.full(jaccard.BANDS, shift, np.uint64))
        plan = jaccard.Plan(r.integers(0, 5, (jaccard.BANDS, jaccard.CELLS)).astype(np.uint8), np.full(jaccard.BANDS, 256), np.ones(jaccard.BANDS, bool), np.full(jaccard.BANDS, 2))
        for _ in range(60):
            n = int(r.integers(1, 200))
            base = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            sets = []
            for _ in range(2):
                lost = base[r.random(n) > r.choice([0.0, 0.03, 0.1])]
                sets.append(np.unique(np.append(lost, r.integers(0, 1 << 63, int(r.integers(0, n // 12 + 1)), dtype=np.uint64))))
            x, y = sets
            common = len(np.intersect1d(x, y))
            if not common or 100 * common < 75 * (len(x) + len(y) - common):
                continue
            tokens, bounds = np.concatenate(sets), np.array([0, len(x), len(x) + len(y)])
            h = (len(x) + len(y)) * 25 // 175
            rows = [jaccard._indexed(tokens, bounds, j, b, m, plan) for j, b, m in jaccard._partners(np.diff(bounds), 75)]
            every = [{}, {}]
            for row, sign, place, _ in rows:
                for i in (0, 1):
                    for s, p in zip(sign[row == i].tolist(), place[row == i].tolist()):
                        every[i][s] = min(p, every[i].get(s, p))
            assert any(every[0][s] + every[1][s] <= h for s in every[0].keys() & every[1].keys())


@pytest.mark.parametrize("limits", [{"GROUP": 2}, {"GROUP": 2, "BLOCK": 8}, {"HOT": 1}, {"BROADCAST_IDS": 0}])
def test_jaccard_beyond_its_limits(spark, monkeypatch, limits):
    """Large groups, several blocks, hot signatures and joins without broadcasts find the same links."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    if "HOT" in limits:
        plain = jaccard.allocate

        def hot(cells, percent):
            plan = plain(cells, percent)
            plan.hot[:] = 20
            return plan

        monkeypatch.setattr(jaccard, "allocate", hot)
    r = random.Random(3)
    docs = noisy_docs(4, 90)
    base = [f"w{r.randrange(60)}" for _ in range(200)]
    for i in range(60):
        c = list(base)
        for _ in range(r.randint(0, 14)):
            c[r.randrange(len(c))] = f"x{r.randrange(400)}"
        docs.append((2000 + i, " ".join(c)))
    assert found_components(spark.createDataFrame(docs, "k long, t string").repartition(3)) == brute_jaccard(docs)


def test_jaccard_of_awkward_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, None), (3, ""), (4, " \t"), (5, text), (5, text), (None, text), (6, "one two"), (7, "ONE two"), (8, "é" * 300_000), (9, text + " x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k long, t string, n_shingles int")
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(df, "k", "t").collect())
    assert got == {(1, 96, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 96, 1): 2, (None, 96, None): 1, (6, 1, 6): 1, (7, 1, 6): 1, (8, 1, 8): 1, (9, 97, 1): 1}
    kept = jaccard.deduplicate(df, "k", "t")
    assert kept.columns == df.columns and sorted(str(r["k"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "None"]
    assert jaccard.near_duplicates(df.limit(0), "k", "t").count() == 0


def test_groups_of_signatures():
    """Packed and unpacked, small groups give all their pairs and large ones their members."""
    r = np.random.default_rng(1)
    for _ in range(100):
        n = int(r.integers(1, 200))
        sign, name = r.integers(0, int(r.integers(1, 12)), n) << 40 | 3, r.integers(0, 40, n) << 41
        size, place = np.full(n, 5 * 2048), r.integers(0, 3, n)
        blobs = [jaccard._pack(sign[c].astype(np.uint64), name[c].astype(np.uint64), size[c].astype(np.uint16), place[c].astype(np.uint16)) for c in np.array_split(np.arange(n), 3)]
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 3), pa.array([False] * 3), pa.array(blobs, pa.binary())], names=["part", "hot", "blob"])
        rows = [tuple(q.values()) for x in jaccard._groups(75)(iter([batch])) for q in x.to_pylist()]
        pairs, members = set(), collections.Counter()
        for s in set(sign.tolist()):
            g = sorted(set(name[sign == s].tolist()))
            first = {a: int(place[(sign == s) & (name == a)].min()) for a in g}
            if len(g) <= jaccard.GROUP:
                pairs.update((a, b) for a, b in itertools.combinations(g, 2) if first[a] + first[b] <= 9)
            else:
                members.update((s, a, None, 5 * 2048, first[a]) for a in g)
        assert {x[1:3] for x in rows if x[0] is None} == pairs and collections.Counter(x for x in rows if x[0] is not None) == members


def test_components_of_chains(spark):
    for ids in (list(range(80)), random.Random(1).sample(range(1000), 80)):
        e = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5000, 5000), (6000, 5001)], "src long, dst long")
        got = dict(common.components(e).collect())
        assert got == dict.fromkeys(ids, min(ids)) | {6000: 5001, 5001: 5001}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window):
    words = lambda s: WORD.findall((s or "").translate(LOWER))
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k : k + window])].add(str(i))
    out = {}
    for i, t in docs:
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if items_ := phrases.get(tuple(w[k : k + n])):
                    found |= items_
                    hit[k : k + n] = [1] * n
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_decontamination_against_scans(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "a", "Éa", "x1", "B", "cc", "-d-", "ee!"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (3, None), (4, ""), (5, text(2)), (6, "unseen words only here"), (None, text(4)), (11, text(9))]
    docs = [(i, text(r.randint(0, 60)) + (" " + items[0][1] if i % 5 == 0 else "")) for i in range(60)] + [(100, None), (101, ""), (102, text(3000)), (103, "ünseen x1 of")]
    d, b = spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(items, "i long, s string")
    want = brute_hits(docs, [x for x in items if x[0] is not None], 5)
    for shard in (1 << 20, 50):
        got = {r_["id"]: tuple(r_)[1:] for r_ in fmindex.decontaminate(d, b, "k", "t", "i", "s", 5, shard_words=shard).collect()}
        assert got == want
    assert {r_["id"]: tuple(r_)[1:4] for r_ in fmindex.decontaminate(d, b, "k", "t", "i", "s", 5, max_phrases=3).collect()} == {i: w[:3] for i, w in want.items()}
    assert fmindex.decontaminate(d.limit(0), b, "k", "t", "i", "s").count() == 0
    assert {r_["n_hit"] for r_ in fmindex.decontaminate(d, b.limit(0), "k", "t", "i", "s").collect()} == {0}


def test_passes_over_a_large_benchmark(spark):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("abcdef") for _ in range(n))
    items = [(i % 25, text(r.randint(0, 9))) for i in range(30)]  # some ids repeat, in one pass or in several
    docs = [(i, text(r.randint(0, 40))) for i in range(40)] + [(40, None), (41, ""), (42, text(2000))]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "k long, t string, marks string")
    b = spark.createDataFrame(items, "i long, s string")
    want = brute_hits(docs, items, 4)
    whole = {q["id"]: q for q in fmindex.decontaminate(d, b, "k", "t", "i", "s", 4, keep_spans=True).collect()}
    assert {i: tuple(q)[1:5] for i, q in whole.items()} == want
    parts = list(fmindex.passes(b, "i", "s", 4, 12))
    assert len(parts) > 5 and max(len(p.lengths) for p in parts) <= 12
    for size in (12, 60):
        got = fmindex.decontaminate(d, b, "k", "t", "i", "s", 4, keep_spans=True, max_phrases=size, shard_words=100)
        assert {q["id"]: q for q in got.collect()} == whole


def test_suffix_array_and_index():
    r = np.random.default_rng(3)
    for n, sigma in ((1, 3), (40, 3), (400, 6), (300, 2)):
        s = r.integers(0, sigma, n)
        barrier = np.cumsum(s == 0) - 1
        key = lambda i: [(0, int(barrier[k])) if s[k] == 0 else (1, int(s[k])) for k in range(i, n)]
        assert fmindex.suffix_array(s).tolist() == sorted(range(n), key=key)
        index = fmindex.FMIndex(s, sigma, step=4)
        for length in (1, 2, 4):
            grams = np.unique(r.integers(1, sigma, (10, length)), axis=0)
            phrase, place = index.locate(*index.search(grams, np.full(len(grams), length)))
            got = sorted(zip(phrase.tolist(), place.tolist()))
            assert got == sorted((p, i) for p, g in enumerate(grams.tolist()) for i in range(n - length + 1) if s[i : i + length].tolist() == g)


def test_cutting_spans(spark):
    docs = [(1, "Aé keep. ONE two Three four, end"), (2, "one two three four"), (3, None), (4, "clean text"), (1, "other text")]
    d = spark.createDataFrame([(*x, 9) for x in docs], "k long, t string, n_hit int")
    b = spark.createDataFrame([(1, "one two three four")], "i long, s string")
    found = fmindex.decontaminate(d, b, "k", "t", "i", "s", 4, keep_spans=True)
    got = fmindex.without_spans(d, found, "k", "t", 0.6)
    assert got.columns == d.columns and sorted(((r["k"], r["t"]) for r in got.collect()), key=str) == sorted([(1, "Aé keep. , end"), (1, "other text"), (3, None), (4, "clean text")], key=str)


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 64))
    x = np.concatenate([c + r.normal(size=(k, 64)) * 0.15 for c, k in zip(centres, [120] + [5] * 20 + [1] * 39)]).astype(np.float32)
    x[7] = x[8] = x[300 % len(x)] if len(x) > 300 else x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, []), (9004, [1.0, None]), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (None, x[0].tolist())]
    df = spark.createDataFrame([(*p, 1) for p in rows + odd], "k long, v array<float>, n_links int")
    got = {q["id"]: q for q in vectors.near_duplicates(df, "k", "v").collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    want = near.sum(1) - 1
    have = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.98 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (9000, 9001, 9002, 9003, 9004))
    assert got[9006]["component_id"] == 9005 and not got[9006]["kept"] and got[None]["component_id"] is None
    assert vectors.near_duplicates(df.limit(0), "k", "v").count() == 0


def test_vectors_that_share_a_direction(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 48)) + 1.6  # a mean cosine of about 0.72 and few links
    x[1500:1520] = x[:20] + 0.25 * r.normal(size=(20, 48))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cosines = u @ u.T
    assert 0.65 < cosines.mean() < 0.8
    apart = np.sqrt(np.maximum(2 - 2 * cosines[np.triu_indices(600, 1)], 0))
    met = lambda c, t: t * float((vectors._staying(apart[apart > 0.32]) ** c).mean())
    by_sample, without = vectors.calibrate(100_000, 0.95, 0.01, apart), vectors.calibrate(100_000, 0.95, 0.01)
    assert without[:2] == (7, 13) and by_sample[0] > without[0] and met(*by_sample[:2]) < 0.6 * met(*without[:2])
    got = {q["id"]: q["n_links"] for q in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), "k", "v").collect()}
    want = (cosines >= 0.95).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.98 * want.sum() > 0


def test_vectors_of_extreme_lengths(spark):
    rows = [(1, [1e200] * 4), (2, [1.0000001e200] * 4), (3, [1e-200] * 4), (4, [1.1e-200] * 4), (5, [5e-324, 0.0, 0.0, 0.0]), (6, [1e300, 1e-300, 0.0, 0.0]), (7, [0.0, 0.0, 1.0, 0.0])]
    got = {q["id"]: (q["n_links"], q["component_id"]) for q in vectors.near_duplicates(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v").collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_vectors_of_other_numbers(spark):
    rows = [(1, [100_000_001, 0]), (2, [100_000_000, 0]), (3, [0, 7]), (4, None), (5, [0, 0])]
    df = spark.createDataFrame(rows, "k long, v array<int>")
    for kind in ("int", "decimal(20,3)"):
        got = {q["id"]: q["component_id"] for q in vectors.near_duplicates(df.selectExpr("k", f"cast(v as array<{kind}>) v"), "k", "v").collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_vectors_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = (r.normal(size=64) + r.normal(size=(200, 64)) * 0.05).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "k long, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 32)
    got = vectors.near_duplicates(df, "k", "v").collect()
    assert {q["n_links"] for q in got} == {199} and {q["component_id"] for q in got} == {0}


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(queries.tokenizer_path())


def segmentations(v, s):
    w = {t: (int(i), float(x)) for t, i, x in zip(v.texts, v.ids, v.weights)}
    s = "▁" + s.replace(" ", "▁")

    def rec(p):
        if p == len(s):
            yield (), 0.0
            return
        for n in range(1, len(s) - p + 1):
            if s[p : p + n] in w:
                i, x = w[s[p : p + n]]
                yield from (((i, *a), x + b) for a, b in rec(p + n))
        if s[p] not in w:
            raw = s[p].encode()
            yield from (((*(int(v.byte_ids[x]) for x in raw), *a), b + len(raw) * v.byte_weight) for a, b in rec(p + 1))

    found = dict(rec(0))
    z = np.logaddexp.reduce(list(found.values()))
    return {a: b - z for a, b in found.items()}


def test_samples_against_all_segmentations(vocabulary):
    v, n = vocabulary, 6000
    v = pieces.Vocabulary.of(v.texts, v.ids, v.weights * 0.15, v.byte_ids, v.byte_weight * 0.15)
    d = segmentations(v, "ab é☃")
    found = pieces.segment(v, ["ab é☃"] * n, [str(i) for i in range(n)], 3)
    first, second = collections.Counter(), collections.Counter()
    for x in found:
        assert len({tuple(s.ids) for s in x}) == 3 and all(abs(d[tuple(s.ids)] - s.log_prob) < 1e-9 for s in x) and x[0].value >= x[1].value >= x[2].value
        first[tuple(x[0].ids)] += 1
        second[tuple(x[1].ids)] += 1
    p = {a: np.exp(b) for a, b in d.items()}
    then = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for a in p:
        assert abs(first[a] / n - p[a]) < 0.03 and abs(second[a] / n - then[a]) < 0.03
    # With inclusion probabilities as weights, the samples' probabilities sum to 1 on the average.
    assert abs(np.mean([sum(np.exp(s.log_prob) / s.inclusion for s in x) for x in found]) - 1) < 0.05


def test_samples_do_not_depend_on_neighbours(vocabulary):
    texts = ["some words here", "", "▁x  ▁ y\n\t☃", "日本語" * 30, "y" * 2000]
    together = pieces.segment(vocabulary, texts, list("abcde"), 3)
    for k, t in enumerate(texts):
        alone = pieces.segment(vocabulary, [t], ["abcde"[k]], 3)[0]
        assert [s.ids for s in alone] == [s.ids for s in together[k]] and all(vocabulary.decode(s.ids) == t for s in alone)


def test_encode_and_decode(spark):
    rows = [(1, "a text  with spaces \n"), (2, None), (3, ""), (1, "a text  with spaces \n"), (None, "x"), (4, "Éa ☃ " * 3000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "id long, text string, rank int")
    got = pieces.encode(df, "id", "text", queries.tokenizer_path(), k=2)
    back = pieces.decode(got, queries.tokenizer_path()).collect()
    assert {r["text"] for r in back if r["id"] == 1} == {rows[0][1]} and {r["text"] for r in back if r["id"] == 4} == {rows[5][1]}
    assert [r["n_pieces"] for r in back if r["id"] in (2, 3)] == [0, 0] and all(0 <= r["inclusion"] <= 1 for r in back)
    assert pieces.encode(df, "id", "text", queries.tokenizer_path(), digest=True).filter("not lossless and id > 2").count() == 0
    assert pieces.encode(df.limit(0), "id", "text", queries.tokenizer_path()).count() == 0


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).toPandas()
    want = brute_jaccard(list(zip(docs.doc_id, docs.text)))
    letters = {i for i, t in zip(docs.doc_id, docs.text) if any(c.isalpha() for c in t)}
    heads = {i for i, (_, c) in want.items() if i == c} & letters
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    hits = brute_hits(list(zip(docs.doc_id, docs.text)), list(zip(items.item_id, items.text)), 10)
    assert set(out.doc_id) == {i for i in heads if hits[i][1] <= 0.5 * hits[i][0]}
    assert out.groupby("doc_id").size().max() <= 2
