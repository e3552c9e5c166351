from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from ledgerloom.functions.names import may_match, normalize_name, score
from ledgerloom.operators import graph, resolve
from tests.fixtures import pages


def plain(spark, names, dash=False):
    df = spark.createDataFrame([(x,) for x in names], "n string").select(normalize_name(F.col("n"), dash).alias("x"))
    return [r["x"] for r in df.collect()]


def test_normalisation(spark):
    assert plain(spark, ["Acme Aerospace", "Acme L.L.C.", "Acme, Inc.", "Space Group", "A Corp", "  Two  Words  Ltd. ", "A-B"]) == ["acme", "acme", "acme", "", "a", "two words", "a-b"]
    assert plain(spark, ["A-B Co"], True) == ["ab"]


def test_scores():
    for a, b, s in (("cold widget", "old widget", 0.952), ("acme avionics", "acme avionix", 0.880), ("orion systems", "orion devices", 0.538), ("orion", "orion devices", 0.9)):
        assert round(score(a, b), 3) == s
    assert score("a", "nasa goddard", least=2) < 0.5


NAMES = ["cold widget", "old widget", "acme avionics", "acme avionix", "orion", "orion devices", "orion systems", "a", "widget cold", "zzz", "bold widgets", "gadget"]


def test_cheap_bounds_lose_no_pair(spark):
    pairs = [(a, b) for a in NAMES for b in NAMES if a != b]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (0.5, 0.78, 0.85, 0.95):
        kept = {(r["a"], r["b"]) for r in df.filter(may_match(F.col("a"), F.col("b"), t)).collect()}
        assert {p for p in pairs if score(*p) >= t} <= kept


def brute(names, threshold):
    out = set()
    for a, b in combinations(names, 2):
        s = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
        s = max(s, 0.9) if a in b or b in a else s
        if s >= threshold:
            out.add((a, b, round(s, 3)))
    return out


def test_duplicates_against_all_pairs(spark):
    v = spark.createDataFrame([("T", x, i, i) for i, x in enumerate(NAMES)], "type string, name string, degree int, seq int")
    for t in (0.6, 0.78, 0.92):
        got = {(r["name_a"], r["name_b"], r["similarity"]) for r in resolve.duplicates(v, t).collect()}
        assert got == brute(NAMES, t)


def test_duplicates_of_the_fixture(spark):
    p = pages(spark)
    v = graph.vertices(graph.flatten_nodes(p), graph.flatten_edges(p))
    assert [tuple(r) for r in resolve.duplicates(v).collect()] == [("Party", "Acme Aerospace", "Acme International Inc.", 1.0, 2, 0)]


def resolved(spark, names, **o):
    df = spark.createDataFrame([("T", x, i) for i, x in enumerate(names)], "type string, name string, seq int")
    return {r["name"]: r["canonical"] for r in resolve.resolve_in_order(df, **o).collect()}


def test_resolver_in_order(spark):
    assert set(resolved(spark, ["Orion Systems", "Orion", "Orion Devices"]).values()) == {"Orion Systems"}
    assert resolved(spark, ["Orion Systems", "Orion Devices", "Orion"]) == {"Orion Systems": "Orion Systems", "Orion Devices": "Orion Devices", "Orion": "Orion Systems"}
    assert set(resolved(spark, ["Space Group", "Beta Avionics Inc", "Gamma Works"], compat=True).values()) == {"Space Group"}
    assert len(set(resolved(spark, ["Space Group", "Beta Avionics Inc", "Gamma Works"]).values())) == 3


def test_resolver_by_links_does_not_depend_on_order(spark):
    for names in (["Orion Systems", "Orion Devices", "Orion"], ["Orion", "Orion Devices", "Orion Systems"]):
        df = spark.createDataFrame([("T", x, i) for i, x in enumerate(names)] + [("U", "Orion", 9)], "type string, name string, seq int")
        got = {(r["type"], r["name"]): r["canonical"] for r in resolve.resolve_by_links(df).collect() if r["type"] == "T"}
        assert set(got.values()) == {names[0]}


def test_ties_go_to_review(spark):
    refs = spark.createDataFrame([(1, 1, "cold widget"), (2, 1, "orion devices"), (3, 1, "nothing like it"), (4, 2, "cold widget")], "ref int, revision int, title string")
    docs = spark.createDataFrame([(1, "cold widgets"), (1, "cold widgetz"), (1, "orion devices"), (2, "zebra")], "revision int, title string")
    got = {r["ref"]: (r["title"], r["verdict"]) for r in resolve.ambiguous(refs, docs).collect()}
    assert got == {1: (None, "review"), 2: ("orion devices", "suggest"), 3: (None, "review"), 4: (None, "review")}
