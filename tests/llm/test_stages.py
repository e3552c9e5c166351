"""Each stage of the pipeline by its rows and texts, and columns named like those that operators use inside."""

import re

import pandas as pd
import pytest

from ledgerloom.llm import fmindex, langid, pieces, pii, queries, sharding, urls
from tests.llm.test_models import base
from tests.llm.test_search import LOWER, WORD, brute_jaccard


def without_passages(text, windows, n=10):
    """A text without the runs of words that windows cover, and the share of its words in them."""
    low = text.translate(LOWER)
    at = [m.span() for m in WORD.finditer(low)]
    words = [low[a:b] for a, b in at]
    hit = [False] * len(words)
    for size in range(1, n + 1):
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit[k : k + size] = [True] * size
    runs = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[h] for h in hit))]
    for a, b in reversed(runs):
        text = text[: at[a][0]] + text[at[b - 1][1] :]
    return text, sum(hit) / max(len(hit), 1)


def test_stages_by_plain_versions(spark, sf, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    have = {r["doc_id"]: r.asDict() for r in docs.collect()}
    after = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns and all(r["n_chars"] == len(r["text"] or "") for r in after[name])
    rows = lambda name: {r["doc_id"]: r["text"] for r in after[name]}
    want = {i: r["text"] for i, r in have.items() if any(c.isalpha() for c in r["text"] or "")}
    assert rows("language_id") == want
    groups = brute_jaccard(list(want.items()))
    want = {i: t for i, t in want.items() if groups[i][1] in (i, None)}
    assert rows("near_duplicates") == want
    windows = set()
    for text in pd.read_parquet(f"{sf}/benchmark.parquet").text.dropna():
        w = WORD.findall(text.translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    cut = {i: without_passages(t, windows) for i, t in want.items()}
    want = {i: t for i, (t, share) in cut.items() if share <= 0.5}
    assert rows("decontamination") == want and any(0 < share <= 0.5 for _, share in cut.values())
    net = pii.trained()
    masked = {}
    for i, t in want.items():
        patterns, more = pii.find(net, [t])[0]
        assert sorted(patterns) == base(t)
        out, last = "", 0
        for a, kind, b in sorted([*patterns, *more]):
            out, last = out + (t[last:a] + f"[{pii.KINDS[kind].upper()}]" if a >= last else ""), max(last, b)
        masked[i] = out + t[last:]
    assert rows("personal_data") == masked and masked != want
    sampled = pieces.decode(docs, queries.tokenizer_path()).collect()
    assert {r["doc_id"] for r in sampled} == set(masked) and all(r["text"] == masked[r["doc_id"]] for r in sampled)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in sampled}) == len(sampled) and all(0 <= r["inclusion"] <= 1 for r in sampled)  # of long texts it may be too small for a double


def test_stages_of_awkward_tables(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, __text string, __row string, ids string"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat and the dog went home " * 4000, "en", "s", 1), (4, "the cat sat", None, "s", 2), (4, "the cat sat", None, "s", 2), (None, "a dog", "en", None, 3), (5, "12 !!", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], kinds)
    for table in (docs, docs.limit(0)):
        stages = dict(pipeline.STAGES)
        for name in ("language_id", "near_duplicates", "decontamination", "personal_data"):
            out = stages[name](spark, table, sf)
            assert out.columns == docs.columns
            got = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert len(got) <= table.count() and {x for x in got if x[0] == 3} <= {(3, rows[2][1])}
            if name == "near_duplicates":
                assert len([1 for i, _ in got if i == 4]) == (1 if got else 0)
            if name in ("decontamination", "personal_data"):
                assert len(got) == table.count()
        assert {r["doc_id"] for r in stages["sampled_pieces"](spark, table, sf).collect()} == {r["doc_id"] for r in table.collect()}


def test_columns_may_have_inner_names(spark):
    names = ["__text", "__name", "__share", "__spans", "__slot", "__shard", "__rule", "__url", "inherited", "__Text_"]
    df = spark.createDataFrame([(1, "one two three a@b.cd", "http://net/es/", *range(len(names)))], "k long, t string, url string, " + ", ".join(f"`{n}` long" for n in names))
    mine = lambda out: [out.first()[n] for n in names]
    model = langid.train(spark.createDataFrame([("one two", "en")], "text string, lang string"))
    assert mine(langid.predict(df, model, "t")) == list(range(len(names)))
    out = pii.redact(df, "t")
    assert out.columns == df.columns and mine(out) == list(range(len(names))) and out.first()["t"] == "one two three [EMAIL]"
    found = fmindex.decontaminate(df, spark.createDataFrame([(1, "one two")], "i long, s string"), "k", "t", "i", "s", 2, keep_spans=True)
    out = fmindex.without_spans(df, found, "k", "t", 0.9)
    assert out.columns == df.columns and mine(out) == list(range(len(names))) and out.first()["t"] == " three a@b.cd"
    assert mine(sharding.place(df, "k", ["a", "b"], 7)) == list(range(len(names)))
    edges = spark.createDataFrame([("http://net/es/", "http://x/")], "src string, dst string")
    for redirects in (None, edges):
        assert mine(urls.judge(df, [], redirects, html=None)) == list(range(len(names)))
