"""As-of joins and walks against plain loops."""

import datetime as dt
import random

import pytest

from ledgerloom.operators import asof, graph


@pytest.mark.parametrize("days", [1, 7, 10_000])
def test_as_of_join(spark, days):
    r = random.Random(days)
    day = lambda n: None if n is None else dt.datetime(1969, 12, 1) + dt.timedelta(hours=6 * n)
    key = lambda: r.choice(["a", "a", "b", "c", None])
    versions = [(key(), day(r.choice([None, *range(400)])), i, r.choice([None, "x"])) for i in range(60)] + [("a", day(50), 100, "p"), ("a", day(50), 101, "q")]
    events = [(r.choice(["a", "b", "d", None]), day(r.choice([None, 50, *range(-5, 420)])), r.randrange(3)) for _ in range(200)] + [("a", day(50), 9)] * 2
    e = spark.createDataFrame(events, "k string, at timestamp, n int")
    v = spark.createDataFrame(versions, "k string, since timestamp, revision int, note string")
    got = sorted(map(str, (tuple(x) for x in asof.as_of_join(e, v, ["k"], "at", "since", ["revision", "note"], ["revision"], days).collect())))
    want = []
    for k, at, n in events:
        fit = [x for x in versions if k is not None and x[0] == k and at is not None and x[1] is not None and x[1] <= at]
        best = max(fit, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        want.append(str((k, at, n, best[2], best[3])))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        asof.as_of_join(e, v, ["k"], "at", "since", ["k"])
    assert asof.as_of_join(e.limit(0), v, ["k"], "at", "since", ["revision"]).collect() == []
    assert {x["revision"] for x in asof.as_of_join(e, v.limit(0), ["k"], "at", "since", ["revision"]).collect()} == {None}


def reached(steps, start, hops=10**6):
    seen, front, depth = {start: 0}, [start], 0
    while front and depth < hops:
        depth += 1
        front = [b for b in dict.fromkeys(y for x in front for a, y in steps if a == x) if b not in seen]
        seen |= dict.fromkeys(front, depth)
    return {(start, k, d) for k, d in seen.items()}


def test_walks_of_any_depth_and_cycles(spark):
    r = random.Random(1)
    steps = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300)] + [(r.randrange(400, 420), r.randrange(400, 420)) for _ in range(18)]
    starts = [0, 50, 200, 202, 300, 999, *range(400, 420)]
    got = {tuple(x) for x in graph.walk(spark.createDataFrame(steps, "id int, up int"), spark.createDataFrame([(s,) for s in starts], "id int")).collect()}
    assert {x for x in got if x[0] < 400} == set().union(*(reached(steps, s) for s in starts if s < 400))
    single = {}
    for a, b in steps:
        single.setdefault(a, set()).add(b)
    assert got == set().union(*(reached(steps, s) for s in starts))


def test_expansion(spark):
    r = random.Random(2)
    edges = list({(f"v{r.randrange(30)}", f"v{r.randrange(30)}") for _ in range(45)})
    df = spark.createDataFrame([*edges, (None, "v1"), ("v2", None)], "source string, target string")
    starts = spark.createDataFrame([("v0",), ("v1",), ("nowhere",)], "name string")
    for directed in (True, False):
        e = edges if directed else edges + [(b, a) for a, b in edges]
        got = {tuple(x) for x in graph.expand(starts, df, 3, directed).collect()}
        assert got == set().union(*(reached(e, s, 3) for s in ("v0", "v1", "nowhere")))
    assert {tuple(x) for x in graph.expand(starts, df, 0).collect()} == {(s, s, 0) for s in ("v0", "v1", "nowhere")}


def test_expansion_by_bitmap(spark, monkeypatch):
    """Frontiers too large to be sent as they are; a short bitmap takes edges for others, which the join drops."""
    r = random.Random(4)
    edges = [(f"v{r.randrange(300)}", f"v{r.randrange(300)}") for _ in range(500)]
    df = spark.createDataFrame(edges + [(None, "v1"), ("v1", None)], "source string, target string").repartition(3)
    starts = spark.createDataFrame([(f"v{i}",) for i in range(0, 60, 3)], "name string")
    monkeypatch.setattr(graph, "keep", lambda df: pytest.fail("checkpoint of edges"))
    want = {tuple(x) for x in graph.expand(starts, df, 3, directed=False).collect()}
    monkeypatch.setattr(graph, "BROADCAST_NAMES", 0)
    for bits in (1 << 27, 64):
        monkeypatch.setattr(graph, "BITMAP", bits)
        assert {tuple(x) for x in graph.expand(starts, df, 3, directed=False).collect()} == want
    assert graph._perhaps_in(df.dropna(), graph._marks(starts)).count() < len(edges)
