"""Line deduplication by the share of a site's pages that carry a line. DataFrame functions only.

Per host, the pages that contain a line are divided by all pages of the host. A line (trimmed of spaces and tabs) is
boilerplate where at least `least_pages` pages and more than `ratio` of all pages carry it; it is dropped wherever it
stands on that host. A host has fewer than (lines of its mean page) / ratio such lines, so they travel as one array per
host: by broadcast where all arrays together stay under `broadcast_bytes`, else by a join that splits hot hosts.

Copies of a document must not make it boilerplate. Lines that many pages carry are candidates first; a page of which
candidates make more than `REPEAT_SHARE` of the characters repeats other pages, exactly or nearly. All such pages of a host
count as one, in a line's pages as in all pages, so that a line is boilerplate for the different pages that carry it.

Defined results: a null text stays null and has no lines; blank lines are never boilerplate; null hosts form one host;
repeated rows are pages of their own; a page that loses every line keeps an empty text; an empty table stays empty.
Line breaks are \\n.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.llm.common import sealed, stored, unsealed

RATIO = 0.02
LEAST_PAGES = 3
BROADCAST_BYTES = 16 << 20


#: Share of a page's characters above which common lines make it a repetition of other pages.
REPEAT_SHARE = 0.5


def _trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t", " "))


def _side(common: DataFrame, broadcast_bytes: int) -> DataFrame:
    size = common.agg(F.sum(F.size("keys") * 8 + F.octet_length("host") + 32)).first()[0] or 0
    return F.broadcast(common) if size <= broadcast_bytes else common


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host, nohost and keys: the hashes of the host's boilerplate lines."""
    site = ["host", "nohost"]
    trimmed = F.filter(F.transform(F.split(F.col(text_col), "\n"), _trimmed), lambda x: x != "")
    rows = stored(pages.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(host_col).isNull().alias("nohost"),
                               F.array_distinct(F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("key"), F.length(x).alias("size")))).alias("lines")))

    def frequent(counts: DataFrame, totals: DataFrame) -> DataFrame:
        return counts.where(F.col("n") >= least_pages).join(totals, site).where(F.col("n") > F.col("total") * ratio) \
            .groupBy(*site).agg(F.array_sort(F.collect_list("key")).alias("keys"))

    counts = rows.select(*site, F.explode("lines.key").alias("key")).groupBy(*site, "key").agg(F.count(F.lit(1)).alias("n"))
    candidates = stored(frequent(counts, rows.groupBy(*site).agg(F.count(F.lit(1)).alias("total"))))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    marked = rows.join(_side(candidates, broadcast_bytes), site, "left") \
        .withColumn("common", F.when(F.col("keys").isNotNull(), F.filter("lines", lambda x: F.array_contains(F.col("keys"), x["key"])))) \
        .select(*site, "common.key", F.coalesce(chars(F.col("common")) > chars(F.col("lines")) * REPEAT_SHARE, F.lit(False)).alias("repeats"))
    as_one = F.count_if(~F.col("repeats")) + F.max(F.col("repeats").cast("int"))
    own = marked.groupBy(*site).agg(as_one.alias("total"))
    return frequent(marked.select(*site, "repeats", F.explode("key").alias("key")).groupBy(*site, "key").agg(as_one.alias("n")), own)


def without_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                        least_pages: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row with its text rid of boilerplate lines, n_lines and n_dropped."""
    inner = sealed(pages)
    host, text = (f"_c{pages.columns.index(c)}" for c in (host_col, text_col))
    side = _side(stored(boilerplate(inner, host, text, ratio, least_pages, broadcast_bytes)), broadcast_bytes)
    rows = inner.withColumns({"host": F.coalesce(F.col(host).cast("string"), F.lit("")), "nohost": F.col(host).isNull()})
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("keys"), F.xxhash64(_trimmed(x))))
    out = rows.join(side, ["host", "nohost"], "left") \
        .withColumn("kept", F.when(F.col("keys").isNull(), lines).otherwise(kept)) \
        .withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_kept": F.coalesce(F.size("kept"), F.lit(0)).cast("long")}) \
        .withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines")).cast("long"),
                      "n_dropped": F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines") - F.col("n_kept")).cast("long"),
                      text: F.array_join("kept", "\n")})
    return unsealed(out, pages.columns, "n_lines", "n_dropped")
