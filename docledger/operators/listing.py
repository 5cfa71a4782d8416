"""List parsers by source (registry of DSC): rows of fetched list pages go to the parser of their source.

A parser takes the pages of its sources (source_id, source, page_url, prefix, body) and returns `LINKS`. The first registered
condition that holds for a page names its parser; pages that none holds for, or whose source is null, go to the default.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import html as H, skew, text as X
from docledger.operators import discover as D
from docledger.sources import tables as S

LINKS = ("source_id", "page_url", "pos", "url", "title")
Parser = Callable[[DataFrame], DataFrame]


def anchors(pages: DataFrame) -> DataFrame:
    """HTML lists: every anchor with a target."""
    return D.page_links(pages.select("source_id", "page_url", F.col("body").alias("html"))).select(*LINKS)


def feed(pages: DataFrame) -> DataFrame:
    """JSON array feeds; a body that is none leaves no rows, an item without an address neither."""
    rows = S.feed_rows(pages.select("source_id", F.col("page_url").alias("list_url"), "body")).where("NOT broken AND url <> ''")
    return rows.select("source_id", F.col("list_url").alias("page_url"), "pos", H.normalize_url("url", "list_url").alias("url"), X.squeeze(F.col("title")).alias("title"))


def paged(pages: DataFrame) -> DataFrame:
    """Paged list answers; `prefix` leads the detail addresses."""
    asked = pages.select("source_id", F.col("page_url").alias("page"), "page_url", "prefix", "body")
    return D.parse_paged_list(asked).select("source_id", F.col("page").alias("page_url"), "pos", "url", "title")


class ListParsers:
    """Conditions on a page with their parsers, in order of registration."""

    def __init__(self, default: Parser = anchors):
        self.default, self.rules = default, []

    def register(self, holds: Column, parser: Parser) -> ListParsers:
        self.rules.append((holds, parser))
        return self

    def parse(self, pages: DataFrame) -> DataFrame:
        """`LINKS` of all pages with the number of the parser that made them (the default has the last number).

        The pages are read once and written by parser; each parser reads its own part of that table.
        """
        last = F.lit(len(self.rules))
        number = F.coalesce(*[F.when(holds, F.lit(i)) for i, (holds, _) in enumerate(self.rules)], last)
        dealt = skew.pinned(pages.withColumn("_parser", number), by="_parser")
        out = None
        for i, parser in enumerate([*[p for _, p in self.rules], self.default]):
            made = parser(dealt.where(F.col("_parser") == i).drop("_parser")).select(*LINKS).withColumn("parser", F.lit(i))
            out = made if out is None else out.unionByName(made)
        return out
