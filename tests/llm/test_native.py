"""Sharding, URL filters and license scans."""

from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import licenses, queries, sharding, urls


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    t = sharding.lookup_table(names, 211)
    n = Counter(t)
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    less = sharding.lookup_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(t, less) if a != 6)
    assert moved < 0.3 * 211
    assert sharding.lookup_table(["one"], 2) == [0, 0]
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_lookup_table_against_turns():
    """Turn by turn, with whole preference lists."""
    import hashlib

    names, m = ["x", "y", "z"], 13
    lists = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % m, int.from_bytes(d[8:16], "big") % (m - 1) + 1
        lists.append([(offset + j * skip) % m for j in range(m)])
    want, k = {}, 0
    while len(want) < m:
        slot = next(s for s in lists[k % 3] if s not in want)
        want[slot] = k % 3
        k += 1
    assert sharding.lookup_table(names, m) == [want[i] for i in range(m)]


def test_placement_of_awkward_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("", 3), ("x" * 100_000, 4)], "k string, shard int")
    got = sharding.place(df, "k", ["p", "q", "r"], 101)
    assert got.columns == ["k", "slot", "shard"]
    rows = got.collect()
    assert len(rows) == 5 and len({r["shard"] for r in rows if r["k"] == "a"}) == 1 and len({r["slot"] for r in rows if not r["k"]}) == 1
    assert sharding.place(df.limit(0), "k", ["p"], 101).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_forms(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    c.execute(queries.ORACLES[name])
    order = [d[0] for d in c.description]
    assert sorted(map(repr, c.fetchall())) == sorted(repr(tuple(r)) for r in queries.QUERIES[name](spark, sf).select(*order).collect())


def link(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


PAGES = [
    (1, "http://EXAMPLE.com/en/a", ""), (2, "http://www.example.com/en/a", ""), (3, "http://x.net/es/a", ""), (4, "http://x.net/de/a#top", link("/es/a")),
    (5, "http://y.org/1", '<META http-equiv="Refresh" content="0; url=http://x.net/es/a">'), (6, "http://y.org/2", link("http://y.org/1")),
    (7, "http://y.org/3", link("http://www.example.com/en/a")), (8, "http://y.org/4", link("http://y.org/3") + link("x")), (9, None, link("http://x.net/es/a")),
    (10, "no scheme", ""), (11, "http://notexample.com/en/", ""), (12, "http://y.org/4", None), (13, "ftp://net/es/?q", ""), (14, "http://z.org?x", link("http://x.net/es/a")),
]


def test_url_filter(spark):
    df = spark.createDataFrame([(*p, "old") for p in PAGES], "page_id int, url string, html string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, queries.URL_RULES).collect()}
    assert got == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 4: (None, "block"), 5: (None, "block"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "allow"),
        9: (None, "allow"), 10: (None, "allow"), 11: ("com/", "allow"), 12: (None, "allow"), 13: ("net/es/", "block"), 14: (None, "block"),
    }
    hosts = {r["page_id"]: (r["host"], r["path"]) for r in urls.judge(df, queries.URL_RULES).collect()}
    assert hosts[1] == ("example.com", "/en/a") and hosts[9] == ("", "") and hosts[10] == ("", "") and hosts[13] == ("net", "/es/") and hosts[14] == ("z.org", "")
    extra = spark.createDataFrame([("http://q.org/", "http://x.net/es/a"), (None, "x")], "src string, dst string")
    more = urls.judge(spark.createDataFrame([(1, "http://q.org/#f")], "page_id int, url string"), queries.URL_RULES, extra, html=None)
    assert more.first()["verdict"] == "block"
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_license_scan(spark):
    rows = [
        (1, "http://h/a/LICENSE", "Released under the MIT License."), (2, "http://h/a/b/c.html", "<p>text</p>"), (3, "http://h/a/b/d.html", "<p>words</p><p>Licensed under CC BY-NC 4.0.</p>"),
        (4, "http://h/z.html", "nothing"), (5, "http://h/a/b/", "<p>This work is licensed under the GNU General Public License, version 3.</p>"), (6, "http://other/a/b/c.html", ""),
        (7, None, "Released under the MIT License."), (8, "http://h/q.html", None), (9, "http://h/a/x/y/z.html", "a licence of no kind " + "word " * 2000), (None, "http://h/a/n.html", "Released under the MIT License."),
        (10, "http://h/a/b/e.html", "Released under the MIT Licence for great many other things that are not at all a licence header of any kind known"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, license string")
    got = {r["page_id"]: r for r in licenses.scan(df, "page_id", "url", "html").collect()}
    assert len(got) == len(rows)
    own = {k: r["own_license"] for k, r in got.items()}
    assert own == {1: "MIT", 2: None, 3: "CC-BY-NC-4.0", 4: None, 5: "GPL-3.0", 6: None, 7: "MIT", 8: None, 9: None, None: None, 10: None}
    assert (got[2]["inherited_license"], got[2]["inherited_from"]) == ("GPL-3.0", "/a/b/")
    assert (got[9]["license"], got[9]["inherited_from"]) == ("MIT", "/a/") and got[4]["license"] is None and got[6]["license"] is None and got[3]["license"] == "CC-BY-NC-4.0"
    assert licenses.scan(df.limit(0), "page_id", "url", "html").count() == 0


def test_every_template_finds_itself(spark):
    df = spark.createDataFrame([(i, f"http://h{i}/x", "<p>before</p><p>" + t + "</p>") for i, (_, t) in enumerate(licenses.TEMPLATES)], "page_id int, url string, html string")
    got = {r["page_id"]: r["own_license"] for r in licenses.scan(df, "page_id", "url", "html").collect()}
    assert all(got[i] == name for i, (name, _) in enumerate(licenses.TEMPLATES))
