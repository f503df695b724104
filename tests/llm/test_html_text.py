"""Main text of pages: thresholds, boilerplate names, nesting, long and odd pages, and the query's columns."""

import time

from tessera.llm import html_text

LONG = [f"Part {k} of it tells, at some length, what happened; and then, of course, what came of it in the end." for k in range(3)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


def test_short_items_beside_the_article_stay_out():
    page = f"<body>{BODY}<ul><li>Home</li><li>About</li></ul></body>"
    assert html_text.main_text(page).split("\n") == LONG


def test_an_article_named_like_boilerplate_is_found():
    page = f"<body><p>x</p><div class='comment-free-text'>{BODY}</div></body>"
    assert html_text.main_text(page).split("\n") == LONG


def test_headings_and_items_between_content_stay():
    page = f"<article><h1>Head</h1>{BODY}<h2>Next</h2><ul><li>one<li>two</ul>{BODY}<hr>By line</article>"
    assert html_text.main_text(page).split("\n") == ["Head", *LONG, "Next", "one", "two", *LONG, "By line"]


def test_nesting_is_linear():
    began = time.process_time()
    assert html_text.main_text("<div>" * 100_000 + "Text, here. And more.") == "Text, here. And more."
    html_text.main_text("<li><ul>" + "<div><li>x</li>" * 50_000)
    html_text.main_text("<div>" * 50_000 + "</p>" * 50_000)
    assert time.process_time() - began < 30


def test_long_page_empty_table_and_query(spark):
    long = "".join(f"<p>Sentence {k} of a very long page, which goes on and on.</p>" for k in range(40_000))
    rows = [(1, "u", f"<nav>n</nav><article>{long}</article>", "clash"), (1, "u", "<p>&lt;b&gt; &amp; c, d.", None), (None, None, None, None), (2, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(pages).select("page_id", "text").collect(), key=lambda r: (r[0] or 0, r[1]))
    assert [r[1] for r in got[:2]] == ["", "<b> & c, d."] and got[2][1].count("\n") == 39_999 and got[3][1] == ""
    assert html_text.extract(pages.limit(0)).isEmpty()
    query = html_text.op10_html_text(spark, "/root/testdata/sf0.001")
    assert query.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert all(r["n_chars"] == len(r["text"]) for r in query.collect())
