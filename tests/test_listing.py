import json

from pyspark.sql import functions as F

from docledger.operators.listing import ListParsers, feed, paged

SHAPE = "source_id LONG, source STRING, page_url STRING, prefix STRING, body STRING"
URL = "https://h.org/list"
FEED = json.dumps([{"URL": "/a.html", "TITLE": " A "}, {"URL": "", "TITLE": "no address"}, {"TITLE": "none"}])
API = json.dumps({"data": {"results": [{"source": {"id": "7", "title": "B  b"}}, {"source": {"id": " ", "title": "no id"}}]}})
HTML = "<a href='/c.html'>C</a><a>no target</a>"


def _parsers():
    return ListParsers().register(F.col("source") == "feed", feed).register(F.col("source").startswith("api"), paged)


def _rows(df):
    return sorted(tuple(r) for r in df.select("source_id", "parser", "url", "title").collect())


def test_dispatch(spark, rows):
    pages = rows(SHAPE, [(1, "feed", URL, None, FEED), (2, "api-x", URL, "/zc", API), (3, "other", URL, None, HTML), (4, None, URL, None, HTML)])
    assert _rows(_parsers().parse(pages)) == [
        (1, 0, "https://h.org/a.html", "A"), (2, 1, "https://h.org/zc/content/content_7.html", "B b"),
        (3, 2, "https://h.org/c.html", "C"), (4, 2, "https://h.org/c.html", "C")]


def test_first_registered_wins(spark, rows):
    pages = rows(SHAPE, [(1, "feed", URL, None, FEED)])
    parsers = ListParsers().register(F.col("source") == "feed", feed).register(F.lit(True), paged)
    assert _rows(parsers.parse(pages)) == [(1, 0, "https://h.org/a.html", "A")]
    assert _rows(ListParsers().register(F.lit(True), paged).register(F.col("source") == "feed", feed).parse(pages)) == []


def test_edges(spark, rows):
    assert _rows(_parsers().parse(rows(SHAPE, []))) == []
    bad = [(1, "feed", URL, None, "not json"), (2, "feed", URL, None, None), (3, "api", URL, None, None), (4, "other", URL, None, None), (5, "other", URL, None, "")]
    assert _rows(_parsers().parse(rows(SHAPE, bad))) == []
    twice = [(1, "feed", URL, None, FEED)] * 2
    assert len(_rows(_parsers().parse(rows(SHAPE, twice)))) == 2
    assert _rows(ListParsers().parse(rows(SHAPE, [(1, "feed", URL, None, HTML)]))) == [(1, 0, "https://h.org/c.html", "C")]
