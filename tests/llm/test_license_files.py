"""Licence files with the full text of a licence."""

import os

import pytest

from ledgerloom.llm import licenses

COMMON = "/usr/share/common-licenses"
SYSTEM = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def scan(spark, rows):
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    return {r["page_id"]: r for r in licenses.scan(df, "page_id", "url", "html").collect()}


def test_full_texts_declare_their_licence(spark):
    texts = licenses.full_texts()
    head = "The Project\n\nCopyright (c) 2001-2024, The Authors of the Project <mail@example.org>\nAll rights reserved.\n\n"
    files = [(f"file {n}", f"http://h/{n}/COPYING", head + t) for n, t in texts]
    below = [(f"below {n}", f"http://h/{n}/src/a.html", "<p>words</p>") for n, _ in texts]
    inner = [("MIT file above", "http://g/LICENSE", dict(texts)["MIT"]), ("GPL file", "http://g/lib/LICENSE.txt", dict(texts)["GPL-3.0"]), ("page", "http://g/lib/x.html", "words")]
    got = scan(spark, files + below + inner)
    assert {"MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"} <= {n for n, _ in texts}
    for n, _ in texts:
        assert got[f"file {n}"]["own_license"] == n
        assert (got[f"below {n}"]["license"], got[f"below {n}"]["inherited_from"]) == (n, f"/{n}/")
    assert got["page"]["license"] == "GPL-3.0"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no texts of the system")
def test_texts_of_the_system(spark):
    got = scan(spark, [(f, f"http://{f}/LICENSE", open(f"{COMMON}/{f}", encoding="utf-8").read()) for f in SYSTEM])
    assert {f: got[f]["own_license"] for f in SYSTEM} == SYSTEM


def test_other_texts_declare_nothing(spark):
    other = "You may use this software under the licence of the Example Company if you pay for it. Copyright of all parts stays with us. " * 30
    got = scan(spark, [("other", "http://o/LICENSE", other), ("page", "http://p/a.html", dict(licenses.full_texts())["GPL-3.0"][:400])])
    assert got["other"]["own_license"] is None and got["page"]["inherited_license"] is None


def test_titles_tell_the_gnu_licences_apart(spark):
    texts = dict(licenses.full_texts())
    affero = texts["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public License", "GNU Affero General Public License")
    files = {"agpl": affero, "both": texts["LGPL-3.0"] + "\n\n" + texts["GPL-3.0"], "gpl": texts["GPL-3.0"], "two": texts["GPL-2.0"] + "\n" + texts["GPL-3.0"], "mit": texts["MIT"]}
    rows = [(n, f"http://{n}/COPYING", t) for n, t in files.items()] + [(f"{n} page", f"http://{n}/a/b.html", "words") for n in files]
    got = scan(spark, rows)
    want = {"agpl": "AGPL-3.0", "both": "LGPL-3.0", "gpl": "GPL-3.0", "two": "GPL-2.0 AND GPL-3.0", "mit": "MIT"}
    assert {n: got[n]["own_license"] for n in files} == want and {n: got[f"{n} page"]["license"] for n in files} == want


def test_odd_tables(spark):
    kinds = "page_id string, url string, html string"
    assert licenses.scan(spark.createDataFrame([], kinds), "page_id", "url", "html").collect() == []
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([], "host string, url string, html string"), "host", "url", "html")
    got = scan(spark, [("long", "http://l/LICENSE", "word " * 200_000 + "Released under the MIT License."), ("none", None, None)])
    assert got["none"]["license"] is None and got["long"]["host"] == "l"
