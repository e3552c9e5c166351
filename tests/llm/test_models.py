"""Language ID, quality, personal data."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd

from ledgerloom.llm import langid, pii, quality, queries


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_language_held_out(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    got = queries.QUERIES["op9_language_id"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and ((got.score >= 0) & (got.score <= 1)).all()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index])
    assert (got.held_out.to_numpy() == held).all()
    assert (got.lang_pred == docs.lang[got.index])[held].mean() > 0.97


def test_language_of_awkward_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "xx"), ("no language", None)], "text string, lang string")
    m = langid.train(train)
    assert m.languages == ["de", "en"]
    rows = [(1, "the dog"), (2, None), (3, ""), (4, "12 34 !!"), (5, "the cat and the dog " * 20 + "der hund und die katze " * 10), (6, "the dog"), (7, "日本"), (8, "the " * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, text string, lang_pred string")
    got = {r["id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(df, m).collect()}
    assert got[1][0] == "en" and got[1] == got[6] and got[2] == got[3] == got[4] == ("und", 0.0) and got[8][0] == "en" and got[7][0] in ("de", "en")
    assert got[5][0] == "en" and 0.55 < got[5][1] < 0.8
    assert langid.predict(df.limit(0), m).count() == 0
    none = langid.train(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}


def test_mixture_against_plain_em():
    r = np.random.default_rng(2)
    m = langid.Model(["a", "b", "c"], np.log(r.dirichlet(np.ones(256), 3)).T.astype(np.float32), 0.0)
    text = " ".join("".join(r.choice(list("abcdefgh"), int(r.integers(1, 9)))) for _ in range(200)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    got = langid.infer(m, data, offsets, steps=400, resteps=400)[0]
    logs = []
    b, gram = langid._trigrams(data, offsets, 8)
    for w in re.finditer(rb"[a-z]+", text):
        logs.append(m.weights[gram[w.start() : w.end()]].sum(axis=0))
    like = np.exp(np.array(logs, float) - np.max(logs, axis=1, keepdims=True))
    p = np.ones(3) / 3
    for _ in range(400):
        q = like * p
        p = (q / q.sum(1, keepdims=True)).mean(0)
    assert np.allclose(got, p, atol=0.01)


def test_quality_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    got = queries.QUERIES["op3_quality"](spark, sf).toPandas().set_index("doc_id")
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & got.index.isin(labels.index)]
    assert auc(held.score.to_numpy(), labels[held.index].to_numpy()) > 0.95


def test_quality_of_awkward_rows(spark):
    rows = [(1, "plain words here"), (2, None), (3, ""), (1, "plain words here"), (4, "x " * 100_000), (None, "a b c")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "k int, t string, score double")
    found = quality.extract(df, "k", "t")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (3, 0)], "k int, q int")
    m = quality.train(found, labels, "k", "q")
    got = quality.score(found, m).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["id"] == 1}) == 1
    empty = quality.train(found, labels.limit(0), "k", "q")
    assert {round(r["score"], 3) for r in quality.score(found, empty).collect()} == {0.5}
    assert quality.score(found.limit(0), m).count() == 0


def test_interactions_are_learned():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, rounds=20)
    assert auc(quality.decide(m, x), y) > 0.97


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            odd = sum(int(c) for c in d[::-1][::2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[::-1][1::2])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and odd % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_patterns():
    r = random.Random(3)
    pieces = ["@", ".", "a", "b1", "+1 (212) 555-0199", "4242424242424242", "10.0.0.1", "256.1.1.1", "00000000010.1.2.3", " ", "-", "x@y.z", "@@", "..", "1.2.3.4.5", "4242 4242 4242 4242", "é", "a@b", "%+", "9", "\n", "4242-4242-4242-4242-1"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(t) == base(t), t
    t = "a" * 20_000 + "@" + "b" * 20_000
    assert pii.base_spans(t) == []


def test_network(spark):
    net = pii.trained()
    r = np.random.default_rng(123)
    x, y = pii.samples(r, 200)
    tags = pii.viterbi(net.emit(x), np.full(200, pii.WINDOW), net.p["t"], net.p["s"])
    assert (tags == y.T).mean() > 0.96 and (tags == y.T)[y.T > 0].mean() > 0.93
    filler = "Thandon er the " * 30
    text = filler + "call 212-555-0199 now " + filler + "card 1234567812345678 or a.b@c.de " + filler
    base_, more = pii.find(net, [text])[0]
    assert [text[a:b] for a, _, b in base_] == ["a.b@c.de"] and "1234567812345678" in [text[a:b] for a, _, b in more]
    assert pii.find(net, [filler, "", "7"]) == [([], []), ([], []), ([], [])]
    # Where a span lies does not matter, across windows' borders too.
    for pad in range(60, 100, 7):
        t = "er " * pad + "1234567812345678" + " er" * 30
        assert [t[a:b] for a, _, b in pii.find(net, [t])[0][1]] == ["1234567812345678"]


def test_scan_and_redaction(spark):
    rows = [(1, "mail é x.y@z.com, 10.0.0.1"), (2, None), (3, ""), (1, "mail é x.y@z.com, 10.0.0.1"), (4, "er " * 50_000 + "q@w.de"), (None, "a")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id int, text string, spans string")
    got = pii.scan(df, "id", "text").collect()
    one = [r for r in got if r["id"] == 1]
    assert len(got) == 6 and len(one) == 2 and one[0]["spans"] == "email:7:16,ip:18:26" and one[0]["base_sha256"] == hashlib.sha256(b"email:7:16,ip:18:26").hexdigest()
    assert [r["n_email"] for r in got if r["id"] == 4] == [1] and [r["spans"] for r in got if r["id"] in (2, 3)] == ["", ""]
    red = {r["id"]: r["text"] for r in pii.redact(df, "text").collect()}
    assert red[1] == "mail é [EMAIL], [IP]" and red[2] is None and red[4].endswith("[EMAIL]") and pii.redact(df, "text").columns == df.columns
    assert pii.scan(df.limit(0), "id", "text").count() == 0
