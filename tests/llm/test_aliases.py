"""Aliases as real pages write them."""

import pytest

from ledgerloom.llm import queries, urls

BLOCKED = "http://x.net/es/a"


@pytest.mark.parametrize(
    ("url", "html"),
    [
        ("http://y.org/1", f"""<meta http-equiv="refresh" content="0; url='{BLOCKED}'">"""),
        ("http://y.org/2", f"""<meta http-equiv='refresh' content='0;URL="{BLOCKED}"'>"""),
        ("http://y.org/3", f"""<link rel="canonical" href="http://other.org/"><link rel="canonical" href="{BLOCKED}">"""),
        ("http://y.org/4", f"""<meta http-equiv="refresh" content="9; url=http://other.org/"><meta http-equiv="refresh" content="0; url={BLOCKED}">"""),
        ("http://y.org/5", """<link rel="canonical" href="HTTP://X.Net/es/a">"""),
    ],
)
def test_a_block_reaches_the_alias(spark, url, html):
    pages = spark.createDataFrame([(1, url, html), (2, BLOCKED, ""), (3, url.replace("http://y", "HTTP://Y") + "#top", ""), (4, "http://y.org/9", "")], "page_id int, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_paths_keep_their_case(spark):
    pages = spark.createDataFrame([(1, "http://y.org/A", f'<link rel="canonical" href="{BLOCKED}">'), (2, "http://y.org/a", "")], "page_id int, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, queries.URL_RULES).collect()} == {1: "block", 2: "allow"}
