"""Models and scans against plain, slow versions of themselves."""

import collections
import itertools
import math
import random
import re

import numpy as np

from ledgerloom.llm import langid, licenses, pii, quality


def as_bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def plain_features(text):
    b = text.encode()
    words = re.findall(rb"[^ \t-\r]+", b)
    low = [w.lower() for w in words]
    pairs = list(zip(low, low[1:]))
    lines = re.findall(rb"[^\n]+", b)
    share = lambda pattern: len(re.findall(pattern, b)) / max(len(b), 1)
    n, sizes = max(len(words), 1), [len(w) for w in words]
    mean = sum(sizes) / n
    return [
        math.log1p(len(b)), math.log1p(len(words)), mean, share(rb"[A-Z]"), share(rb"[0-9]"), share(rb"[#$%&*+/<=>@\\^_`{}~\[\]]"), share(rb"[!\"'(),\-.:;?]"), share(rb"\|"), share(rb"[\x80-\xff]"),
        math.log1p(len(lines)), len(b) / max(len(lines), 1), len(set(low)) / n, 1 - len(set(lines)) / max(len(lines), 1), max(collections.Counter(low).values(), default=0) / n,
        sum(w[:1].isupper() for w in words) / n, math.sqrt(max(sum(x * x for x in sizes) / n - mean**2, 0)), 1 - len(set(pairs)) / max(len(pairs), 1),
    ]


def test_quality_features_by_plain_counts():
    r = random.Random(5)
    pieces = ["a", "B", "the", "The", " ", " ", " ", "\n", "\t", "é", "Ü", "日", "|", "##", "12", "x.y", "'", "\\", "[", "~", "\x0b"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 80))) for _ in range(300)] + ["", " ", "\n\n", "word", "x " * 3000, "", "A"]
    got = quality.features(*as_bytes(texts))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-9)


def test_trees_by_all_cuts():
    r = np.random.default_rng(6)
    for _ in range(40):
        g, h = r.normal(size=(7, 5)), r.random((7, 5))
        value = lambda a, b: a.sum() ** 2 / (b.sum() + 2.0)
        quarters = lambda m, i, j: (m[:i, :j], m[:i, j:], m[i:, :j], m[i:, j:])
        best = max(sum(map(value, quarters(g, i, j), quarters(h, i, j))) for i in range(1, 7) for j in range(1, 5))
        gain, step = quality._cross(g, h, 2.0)
        assert math.isclose(gain, best - value(g, h)) and len(np.unique(step.round(9))) <= 4
        row, weight = g[:, 0], h[:, 0]
        cut = max(range(1, 7), key=lambda i: value(row[:i], weight[:i]) + value(row[i:], weight[i:]))
        if value(row[:cut], weight[:cut]) + value(row[cut:], weight[cut:]) - value(row, weight) <= 1e-9:
            cut = 7  # no cut gains anything
        leaf = lambda a, b: np.full(len(a), a.sum() / (b.sum() + 2.0))
        assert np.allclose(quality._tree(row, weight, 2, 2.0), np.concatenate([leaf(row[:cut], weight[:cut]), leaf(row[cut:], weight[cut:])]))


def plain_choice(model, text, steps, resteps):
    """Proportions by EM, and the number of languages by penalised likelihood, word by word."""
    data, offsets = as_bytes([text])
    b, gram = langid._trigrams(data, offsets, int(np.log2(len(model.weights))))
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", bytes(b))]
    logs = np.array([model.weights[gram[s:e]].astype(float).sum(axis=0) for s, e in words])
    like = np.exp(logs - logs.max(axis=1, keepdims=True))

    def em(p, n):
        for _ in range(n):
            q = like * p
            p = (q / q.sum(axis=1, keepdims=True)).mean(axis=0)
        return p

    k = len(model.languages)
    full = em(np.full(k, 1 / k), steps)
    single = np.log(like).sum(axis=0)
    best, value = np.eye(k)[single.argmax()], single.max()
    for size in range(2, k + 1):
        p = full
        if size < k:
            top = np.argsort(-full, kind="stable")[:size]
            p = np.zeros(k)
            p[top] = np.maximum(full[top], 1e-6)
            p = em(p / p.sum(), resteps)
        fit = np.log((like * p).sum(axis=1)).sum() - (size - 1) * model.penalty * math.log(max(len(words), 2)) / 2
        if fit > value:
            best, value = p, fit
    return best


def test_the_penalised_choice_of_languages():
    r = np.random.default_rng(8)
    weights = np.log(r.dirichlet(np.full(256, 0.3), 4) * 0.98 + 0.02 / 256).T.astype(np.float32)
    alphabets, chosen = ["abc", "cdef", "fghi", "jkla"], collections.Counter()
    texts = []
    for _ in range(150):
        part = r.choice(4, size=int(r.integers(1, 5)), replace=False)
        texts.append(" ".join("".join(r.choice(list(alphabets[int(r.choice(part))]), int(r.integers(1, 7)))) for _ in range(int(r.integers(1, 60)))))
    for penalty in (0.0, 1.0, 4.0, 30.0):
        m = langid.Model(["a", "b", "c", "d"], weights, penalty)
        got = langid.infer(m, *as_bytes(texts), steps=6, resteps=3)
        want = np.array([plain_choice(m, t, 6, 3) for t in texts])
        assert ((got > 0).sum(axis=1) == (want > 0).sum(axis=1)).all() and np.allclose(got, want, atol=2e-3)
        chosen[penalty] = (got > 0).sum()
    assert chosen[0.0] > chosen[4.0] > chosen[30.0]


def test_crf_by_all_paths():
    r = np.random.default_rng(9)
    time, k = 4, pii.TAGS
    e, trans, start = r.normal(size=(time, 2, k)), r.normal(size=(k, k)), r.normal(size=k)
    y = r.integers(0, k, (time, 2))
    paths = np.array(list(itertools.product(range(k), repeat=time)))
    loss, marginal, moved = 0.0, np.zeros_like(e), np.zeros_like(trans)
    for n in range(2):
        score = start[paths[:, 0]] + sum(e[t, n, paths[:, t]] for t in range(time)) + sum(trans[paths[:, t - 1], paths[:, t]] for t in range(1, time))
        z = np.log(np.exp(score).sum())
        p = np.exp(score - z)
        loss += (z - score[(paths == y[:, n]).all(axis=1)][0]) / 2
        for t in range(time):
            marginal[t, n] = np.bincount(paths[:, t], p, k) / 2
            marginal[t, n, y[t, n]] -= 0.5
            if t:
                np.add.at(moved, (paths[:, t - 1], paths[:, t]), p / 2)
                moved[y[t - 1, n], y[t, n]] -= 0.5
        assert (pii.viterbi(e, np.full(2, time), trans, start)[:, n] == paths[score.argmax()]).all()
        short = start[paths[:, 0]] + e[0, n, paths[:, 0]] + e[1, n, paths[:, 1]] + trans[paths[:, 0], paths[:, 1]]
        assert (pii.viterbi(e, np.full(2, 2), trans, start)[:2, n] == paths[short.argmax(), :2]).all()
    got = pii.crf_loss(e, y, trans, start)
    assert math.isclose(got[0], loss) and np.allclose(got[1], marginal) and np.allclose(got[2], moved) and np.allclose(got[3], marginal[0].sum(axis=0))


def test_gradients_of_the_network_by_differences():
    net, r = pii.Network(6, 3), np.random.default_rng(4)
    x, y = r.integers(0, pii.CLASSES + 1, (5, 9)), r.integers(0, pii.TAGS, (9, 5))
    tape = []
    _, d, _, _ = pii.crf_loss(net.emit(x, tape), y, net.p["t"], net.p["s"])
    g = net.gradients(tape, d)
    loss = lambda: pii.crf_loss(net.emit(x).astype(float), y, net.p["t"], net.p["s"])[0]
    for name in ("x", "h", "o", "b"):
        flat, slope = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[: 8].tolist() + r.integers(0, len(flat), 4).tolist():
            old = flat[i]
            flat[i] = old + 0.01
            up = loss()
            flat[i] = old - 0.01
            down, flat[i] = loss(), old
            assert abs((up - down) / 0.02 - slope[i]) < 2e-3 + 0.02 * abs(slope[i]), name


def plain_matches(segs, templates, least):
    """Best (licence, cosine) of each file among (file, words) by TF-IDF over the templates' words."""
    tf = lambda words: {w: 1 + math.log(n) for w, n in collections.Counter(words).items()}
    temps = [(name, tf(licenses.template_words(t))) for name, t in templates]
    known = {w for _, t in temps for w in t}
    df = collections.Counter(w for _, words in segs for w in set(words) if w in known)
    idf = {w: math.log(1 + len(segs) / (1 + df[w])) + 1 for w in known}
    weigh = lambda t: {w: x * idf.get(w, max(idf.values())) for w, x in t.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for file, words in segs:
        a = weigh(tf(words))
        for name, t in temps:
            b = weigh(t)
            cos = round(sum(x * b.get(w, 0.0) for w, x in a.items()) / length(a) / length(b), 9)
            if cos >= least:
                out[file] = min(out.get(file, (0.0, "")), (-cos, name))
    return out


def plain_scan(rows):
    words = lambda s: re.findall(licenses.WORD, re.sub("<[^>]*>", " ", s).lower())  # tags are no text, such as <https://fsf.org/>
    place, notes, files = {}, [], []
    for i, url, text in rows:
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        name = path.rsplit("/", 1)[-1]
        place[i] = host, path[: len(path) - len(name)], 0 if re.search(licenses.LICENCE_FILE, name) else 1 if re.search(licenses.INDEX_FILE, name) else None
        if text and re.search(licenses.CUE, text):
            whole = place[i][2] == 0
            notes += [(i, w) for s in ([text] if whole else text.split("\n")) if (whole or re.search(licenses.CUE, s)) and (w := words(s))]
            files += [(i, words(text))] if whole else []
    notices, full = plain_matches(notes, licenses.TEMPLATES, 0.6), plain_matches(files, licenses.full_texts(), licenses.FULL)
    own = {i: min(x for x in (notices.get(i), full.get(i)) if x) for i in {*notices, *full}}
    declared = {}
    for i, (less, name) in own.items():
        host, directory, rank = place[i]
        if rank is not None:
            declared[host, directory] = min(declared.get((host, directory), (9, 0.0, "")), (rank, less, name))
    out = {}
    for i, (host, directory, _) in place.items():
        if i in own:
            out[i] = own[i][1], -own[i][0], None, None
            continue
        at = directory
        while at and (host, at) not in declared:
            at = at[:-1].rpartition("/")[0] + "/" if at != "/" else ""
        out[i] = None, 0.0, declared[host, at][2] if at else None, at or None
    return out


def test_license_scan_by_plain_cosines_and_walks(spark):
    r = random.Random(12)
    filler = "alpha beta gamma delta of the and work code text file 2.0 all".split()

    def notice():
        kept = [w for w in r.choice(licenses.TEMPLATES)[1].split() if r.random() < 0.9]
        return " ".join(kept + r.choices(filler, k=r.randrange(4)))

    def body(name):
        lines = [" ".join(r.choices(filler, k=r.randrange(9))) for _ in range(r.randrange(3))]
        if name.startswith("LICENSE") and r.random() < 0.4:
            return " ".join(w for w in r.choice(licenses.full_texts())[1].split() if r.random() < 0.97)
        return "\n".join(lines + [notice()] * (r.random() < 0.35) + ["Copyright of nobody"] * (r.random() < 0.2))

    rows = []
    for i in range(160):
        path = "/" + "".join(r.choice("ab") + "/" for _ in range(r.randrange(4)))
        name = r.choice(["LICENSE", "LICENSE.txt", "index.html", "", "x.c", "y.c", "z.c", "w.c"])
        rows.append((i, f"http://{r.choice(['h', 'g', 'k'])}{path}{name}", None if i % 31 == 0 else body(name)))
    want = plain_scan(rows)
    got = {q["k"]: (q["own_license"], q["similarity"], q["inherited_license"], q["inherited_from"]) for q in licenses.scan(spark.createDataFrame(rows, "k int, u string, t string"), "k", "u", "t").collect()}
    assert len(got) == len(rows) and sum(x[0] is not None for x in want.values()) > 20 and sum(x[2] is not None for x in want.values()) > 20
    for i, (own, similarity, inherited, source) in want.items():
        assert (got[i][0], got[i][2], got[i][3]) == (own, inherited, source) and math.isclose(got[i][1], similarity, abs_tol=1e-8), rows[i]
