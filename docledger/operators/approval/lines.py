"""Lines, offsets, evidence and sections of approval documents (APR-1 to APR-4)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docledger.functions import skew, text as X

# ---- fixed values ----
WATERMARKS = ("投资项目在线审批监管系统", "浙江政务服务网")
HEADING = r"^[一二三四五六七八九十]+、"
HEADING_TITLE = r"^([一二三四五六七八九十]+、[^：:。]{2,25})[：:。]"
PAGES_PER_PIECE = 50
LINES_PER_ROW = 1000
SPAN_BUCKET = 2000


def line_order() -> Column:
    """Page and line number in one long."""
    return F.col("page").cast("long") * (1 << 32) + F.col("n")


def _kept(raw: DataFrame) -> DataFrame:
    """Lines without blanks, watermarks and page numbers, with their band and x."""
    # an exploded array of one: filters on a plain projection would repeat its pattern in each of their terms
    rows = raw.select(*[c for c in raw.columns if c != "text"], F.explode(F.array(X.without_space(X.text("text")))).alias("text"))
    y, digits = F.get("bbox", F.lit(1)), F.regexp_replace("text", "[—-]", "")
    edge = (digits == "") | (y < F.col("page_height") * 0.08) | ((y > F.col("page_height") * 0.8) & (digits.try_cast("int") == F.col("page")))
    number = F.col("text").rlike(r"^[—\-]*\d*[—\-]*$") & F.coalesce(edge, F.lit(False))
    rows = rows.where((F.col("text") != "") & ~number & ~F.col("text").isin(*WATERMARKS))
    return rows.withColumns({"_band": F.bround(F.get("bbox", F.lit(1)) / 3, 0), "_x": F.get("bbox", F.lit(0))})


def _identified(rows: DataFrame) -> DataFrame:
    return rows.drop("_band", "_x").withColumn("id", F.concat(F.lit("p"), "page", F.lit("-l"), "n"))


def clean_lines(raw: DataFrame) -> DataFrame:
    """Drop blanks, watermarks and page numbers; number the lines of a page by band and x (APR-1).

    `raw`: doc_id, page, text, bbox, page_height, method. A page bounds each numbering window.
    """
    return _identified(_kept(raw).withColumn("n", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("_band", "_x", "text"))))


def placed_lines(raw: DataFrame) -> DataFrame:
    """Clean lines with their offsets (APR-1 and APR-2 in one pass), written once for the operators that read them.

    The lines are shuffled and sorted once, by (document, piece of pages): both windows follow that order. What travels across
    pieces is one length per piece of a document; documents of one piece need none.
    """
    return _placed(_kept(raw))


def _placed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_piece", _piece()).repartition("doc_id", "_piece")
    n = F.row_number().over(W.partitionBy("doc_id", "_piece", "page").orderBy("_band", "_x", "text"))
    upto = F.sum(F.length("text").cast("long")).over(W.partitionBy("doc_id", "_piece").orderBy("page", "_band", "_x", "text").rowsBetween(W.unboundedPreceding, 0))
    local = skew.pinned(_identified(rows.withColumn("n", n).withColumn("_end", upto)))
    if not local.where("_piece <> 0").head(1):  # documents of the first piece only: nothing travels
        return local.withColumn("end", F.col("_end")).withColumn("start", F.col("end") - F.length("text")).drop("_piece", "_end")
    lengths = local.groupBy("doc_id", "_piece").agg(F.max("_end").alias("_length"))
    earlier = F.sum("_length").over(W.partitionBy("doc_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    before = lengths.withColumn("_before", earlier).where("_before > 0").select("doc_id", "_piece", "_before")
    out = local.join(before, ["doc_id", "_piece"], "left").withColumn("end", F.col("_end") + F.coalesce("_before", F.lit(0)))
    return out.withColumn("start", F.col("end") - F.length("text")).drop("_piece", "_end", "_before")


def documents(raw: DataFrame) -> DataFrame:
    """Clean lines with their offsets (APR-1 and APR-2), one row per document and piece of pages, written once: doc_id, _piece, _many, _lines.

    Lines meet once. Operators that get such rows (`packed`) add columns to them, so nothing is shuffled or joined again; `each_extent`
    hands documents beyond one row to them line by line. Only lines of pieces of at most LINES_PER_ROW lines (else `_many`) are placed.
    """
    piece = F.coalesce(_piece(), F.lit(-(1 << 40))).alias("_piece")  # lines without a page come first
    rows = _kept(raw)
    line = F.struct("page", "_band", "_x", F.col("text").alias("text"), "bbox", "page_height")
    docs = rows.groupBy("doc_id", piece).agg(F.sort_array(F.collect_list(line)).alias("_l"))
    page, bbox, height = (rows.schema[c].dataType.simpleString() for c in ("page", "bbox", "page_height"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(page).alias("page"), F.lit(0).alias("n"),
                    F.array().cast(f"array<struct<page:{page},n:int,text:string,bbox:{bbox},page_height:{height},start:bigint,end:bigint>>").alias("lines"))

    def row(l, n, start, end):
        return F.struct(l["page"].alias("page"), n.alias("n"), l["text"].alias("text"), l["bbox"].alias("bbox"), l["page_height"].alias("page_height"), start.alias("start"), end.alias("end"))

    def place(upto, l):
        n, end = F.when(l["page"].eqNullSafe(upto["page"]), upto["n"] + 1).otherwise(1), upto["at"] + F.length(l["text"])
        return F.struct(end.alias("at"), l["page"].alias("page"), n.alias("n"), F.concat(upto["lines"], F.array(row(l, n, upto["at"], end))).alias("lines"))
    many = F.size("_l") > LINES_PER_ROW
    nowhere = F.transform("_l", lambda l: row(l, F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")))
    return skew.pinned(docs.select("doc_id", "_piece", many.alias("_many"), F.when(many, nowhere).otherwise(F.aggregate("_l", none, place, lambda u: u["lines"])).alias("_lines")))


def packed(df: DataFrame) -> bool:
    """Does a row hold a whole document, its lines in `_lines`?"""
    return "_lines" in df.columns


def each_extent(docs: DataFrame, of, *beside: DataFrame) -> DataFrame:
    """`of` the packed documents of one row, and of the lines (as from `placed_lines`) of all others; tables `beside` go with their documents."""
    beyond = docs.where("_piece <> 0 OR _many").select("doc_id")
    short = docs.drop("_piece", "_many")
    if not beyond.head(1):
        return of(short, *beside)
    more = skew.pinned(beyond.distinct().withColumnRenamed("doc_id", "_doc"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    rows = docs.join(more, same, "left_semi").select("doc_id", F.explode("_lines").alias("l"))
    rows = rows.select("doc_id", "l.page", "l.text", "l.bbox", "l.page_height", F.bround(F.get("l.bbox", F.lit(1)) / 3, 0).alias("_band"), F.get("l.bbox", F.lit(0)).alias("_x"))
    return of(short.join(more, same, "left_anti"), *[b.join(more, same, "left_anti") for b in beside]).unionByName(
        of(_placed(rows), *[b.join(more, same, "left_semi") for b in beside]))


def line_id(line: Column) -> Column:
    return F.concat(F.lit("p"), line["page"], F.lit("-l"), line["n"])


def _order():
    return [F.col("page"), F.col("n")]


def _piece():
    return F.floor(F.col("page") / PAGES_PER_PIECE)


def line_offsets(lines: DataFrame) -> DataFrame:
    """Add start and end of each line in the joined document text (APR-2)."""
    out = skew.running_total(lines, ["doc_id"], _order(), _piece(), F.length("text").cast("long"), "end")
    return out.withColumn("start", F.col("end") - F.length("text"))


def by_extent(lines: DataFrame, short, long) -> DataFrame:
    """`short` of the documents that lie in the first piece of pages and `long` of all others."""
    beyond = (F.col("page") >= PAGES_PER_PIECE) | (F.col("page") < 0)
    if not lines.where(beyond).head(1):
        return short(lines)
    more = skew.pinned(lines.where(beyond).select("doc_id").distinct())
    return short(lines.join(more, "doc_id", "left_anti")).unionByName(long(lines.join(more, "doc_id", "left_semi")))


def document_text(lines: DataFrame) -> DataFrame:
    """The joined text of each document: doc_id, text. Documents of one piece of pages are joined in one step."""
    if packed(lines):
        return skew.held(lines, text=F.array_join(F.transform("_lines", lambda l: l["text"]), ""))
    def short(rows):
        line = F.struct("page", "n", F.col("text").alias("t"))
        return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["t"]), "").alias("text"))
    return by_extent(lines, short, lambda rows: skew.joined(rows, ["doc_id"], _order(), _piece(), "text", "", "text"))


def _buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / SPAN_BUCKET), F.floor(F.greatest(end - 1, start) / SPAN_BUCKET)))


def overlapping(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of spans and lines that overlap, joined on (document, position bucket).

    A pair sharing several buckets is kept in its first common one only, so no distinct is needed
    and a long document is spread over its buckets.
    """
    s = spans.withColumn("_b", _buckets(F.col("start"), F.col("end")))
    l = lines.select("doc_id", F.col("id").alias("line_id"), "page", "n", F.col("bbox").alias("line_bbox"), F.col("text").alias("line_text"),
                     F.col("start").alias("a"), F.col("end").alias("b")).withColumn("_b", _buckets(F.col("a"), F.col("b")))
    first = F.floor(F.greatest("start", "a") / SPAN_BUCKET)
    return s.join(l, ["doc_id", "_b"]).where((F.col("b") > F.col("start")) & (F.col("a") < F.col("end")) & (F.col("_b") == first)).drop("_b")


def evidence(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Every line a span [start, end) touches, with the quoted part (APR-3). `lines` carries offsets."""
    rows = overlapping(spans, lines)
    at = F.greatest(F.col("start") - F.col("a"), F.lit(0))
    to = F.least(F.col("b") - F.col("a"), F.col("end") - F.col("a"))
    return rows.select(*spans.columns, "line_id", "page", "n", F.col("line_bbox").alias("bbox"), F.col("line_text").substr(at.cast("int") + 1, (to - at).cast("int")).alias("quote"))


def with_evidence(cells: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add the evidence array of each cell; a cell quotes the lines of its own span. Cells that carry the packed lines of their document quote those."""
    if packed(cells):
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        rows = skew.held(cells, evidence=F.when(whole, _quoted(F.col("_lines"), F.col("start"), F.col("end"))))
        return rows.withColumn("evidence", F.when(F.size("evidence") > 0, F.col("evidence"))).drop("_lines")
    cells = skew.pinned(cells)  # searched for once, read for their spans and their other columns
    fields = ("line_id", "page", "bbox", "quote")
    e = evidence(cells.select(*keys, "start", "end").where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), lines)
    quotes = e.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(line_order().alias("_o"), *fields))).alias("_l"))
    return cells.join(quotes.select(*keys, F.transform("_l", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("evidence")), keys, "left")


def _quoted(lines: Column, start: Column, end: Column) -> Column:
    """The lines that a span touches, with the quoted part of each."""
    def quote(l):
        at, to = F.greatest(start - l["start"], F.lit(0)), F.least(l["end"], end) - l["start"]
        return F.struct(line_id(l).alias("line_id"), l["page"].alias("page"), l["bbox"].alias("bbox"), l["text"].substr(at.cast("int") + 1, (to - at).cast("int")).alias("quote"))
    return F.transform(F.filter(lines, lambda l: (l["end"] > start) & (l["start"] < end)), quote)


def _title_length(text: Column | None = None) -> Column:
    """Of a heading line the characters of its title with the mark that ends it, 0 where none ends it; NULL for other lines."""
    text = F.col("text") if text is None else text
    head = F.contains(text, F.lit("、")) & text.rlike(HEADING)
    return F.when(head, F.length(F.regexp_extract(text, HEADING_TITLE, 0)))


def sections(lines: DataFrame) -> DataFrame:
    """Numbered sections: heading, start, end and text up to the next heading, across pages (APR-4).

    The lines of a document of one piece of pages meet once; its sections are the stretches of its text between headings.
    """
    if packed(lines):
        return _packed_sections(lines)
    return by_extent(lines.where("doc_id IS NOT NULL"), _short_sections, _long_sections)


def _packed_sections(docs: DataFrame) -> DataFrame:
    """Packed documents with their sections in `_sections`; those without an id have none."""
    docs = docs if "text" in docs.columns else document_text(docs)
    titled = F.transform("_lines", lambda l: F.struct(l["start"].alias("start"), l["end"].alias("end"), l["text"].alias("t"), _title_length(l["text"]).alias("title")))
    docs = skew.held(docs, _heads=F.filter(titled, lambda l: l["title"].isNotNull()))
    return skew.held(docs, _sections=F.when(F.col("doc_id").isNotNull(), F.transform("_heads", _stretch(F.lit(0), F.length("text")))).otherwise(
        F.array().cast("array<struct<heading_start:bigint,heading:string,start:bigint,end:bigint,text:string>>"))).drop("_heads")


def _stretch(first: Column, last: Column, text: str = "text"):
    """The section of a heading among `_heads`, up to the next one or to `last`; the text begins at `first`."""
    def section(h, i):
        titled = h["title"] > 0
        start = F.when(titled, h["start"] + h["title"]).otherwise(h["end"])
        end = F.coalesce(F.get("_heads", i + 1)["start"], last)
        return F.struct(h["start"].alias("heading_start"), F.when(titled, F.substr(h["t"], F.lit(1), h["title"] - 1)).otherwise(h["t"]).alias("heading"), start.alias("start"), end.cast("long").alias("end"),
                        F.substr(text, (start - first + 1).cast("int"), (end - start).cast("int")).alias("text"))
    return section


def _short_sections(lines: DataFrame) -> DataFrame:
    # only headings carry their offsets
    own = lambda c: F.when(F.col("_title").isNotNull(), F.col(c)).alias(c)
    line = F.struct("page", "n", F.col("text").alias("t"), own("start"), own("end"), F.col("_title").alias("title"))
    docs = lines.withColumn("_title", _title_length()).groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("_l"), F.min("start").alias("_from"), F.max("end").alias("_to"))
    docs = docs.select("doc_id", F.array_join(F.transform("_l", lambda s: s["t"]), "").alias("_t"), "_from", "_to",
                       F.filter("_l", lambda s: s["title"].isNotNull()).alias("_heads")).where(F.size("_heads") > 0)
    return docs.select("doc_id", F.explode(F.transform("_heads", _stretch(F.col("_from"), F.col("_to"), "_t"))).alias("s")).select("doc_id", "s.*")


def raw_sections(raw: DataFrame) -> DataFrame:
    """Sections of raw lines: cleaned, put in order, placed and cut as `sections(placed_lines(raw))` does (APR-1, APR-2 and APR-4).

    For callers that read no lines. Lines meet once, by (document, piece of pages); one row per piece, its text and its headings, is
    written. What travels across pieces are lengths and the place of the last heading.
    """
    piece = F.coalesce(_piece(), F.lit(-(1 << 40))).alias("_piece")  # lines without a page come first
    line = F.struct("page", "_band", "_x", F.col("text").alias("t"), _title_length().alias("title"))
    docs = _kept(raw).where("doc_id IS NOT NULL").groupBy("doc_id", piece).agg(F.sort_array(F.collect_list(line)).alias("_l"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at: long, t: string, title: int>>").alias("heads"))

    def place(upto, l):
        head = F.array(F.struct(upto["at"].alias("at"), l["t"].alias("t"), l["title"].alias("title")))
        return F.struct((upto["at"] + F.length(l["t"])).alias("at"), F.when(l["title"].isNull(), upto["heads"]).otherwise(F.concat(upto["heads"], head)).alias("heads"))
    placed = docs.select("doc_id", "_piece", F.array_join(F.transform("_l", lambda s: s["t"]), "").alias("_t"), F.aggregate("_l", none, place).alias("_h"))
    pieces = skew.pinned(placed.select("doc_id", "_piece", "_t", F.col("_h.at").alias("_length"), F.col("_h.heads").alias("_heads")))
    if not pieces.where("_piece <> 0").head(1):
        return _cut(pieces)
    more = skew.pinned(pieces.where("_piece <> 0").select("doc_id").distinct())
    return _cut(pieces.join(more, "doc_id", "left_anti")).unionByName(_cut_across(pieces.join(more, "doc_id", "left_semi")))


def _cut(pieces: DataFrame, *more: str) -> DataFrame:
    """The stretches from heading to heading of each piece; places count from the start of the piece."""
    def section(h, i):
        titled = h["title"] > 0
        start = h["at"] + F.when(titled, h["title"]).otherwise(F.length(h["t"]))
        end = F.coalesce(F.get("_heads", i + 1)["at"], F.col("_length"))
        return F.struct(h["at"].alias("heading_start"), F.when(titled, F.substr(h["t"], F.lit(1), h["title"] - 1)).otherwise(h["t"]).alias("heading"), start.alias("start"), end.alias("end"),
                        F.substr("_t", (start + 1).cast("int"), (end - start).cast("int")).alias("text"))
    return pieces.where(F.size("_heads") > 0).select("doc_id", *more, F.explode(F.transform("_heads", section)).alias("s")).select("doc_id", "s.*", *more)


def _cut_across(pieces: DataFrame) -> DataFrame:
    """Sections of documents of several pieces: what stands before the first heading of a piece belongs to the last one before."""
    earlier = W.partitionBy("doc_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = pieces.select("doc_id", "_piece", "_length", F.get("_heads", F.size("_heads") - 1)["at"].alias("_last")).withColumn("_before", F.coalesce(F.sum("_length").over(earlier), F.lit(0)))
    totals = totals.withColumn("_open", F.last(F.col("_before") + F.col("_last"), ignorenulls=True).over(earlier))
    rows = pieces.join(totals.select("doc_id", "_piece", "_before", "_open"), ["doc_id", "_piece"])
    own = _cut(rows, "_piece", "_before").withColumns({c: F.col(c) + F.col("_before") for c in ("heading_start", "start", "end")}).drop("_before")
    lead = F.coalesce(F.get("_heads", F.lit(0))["at"], F.col("_length"))
    carried = rows.where(F.col("_open").isNotNull() & (lead > 0)).select(
        "doc_id", F.col("_open").alias("heading_start"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("long").alias("start"), (F.col("_before") + lead).alias("end"),
        F.substr("_t", F.lit(1), lead.cast("int")).alias("text"), "_piece")
    whole = own.unionByName(carried).groupBy("doc_id", "heading_start").agg(F.max("heading").alias("heading"), F.max("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("_piece", "text"))).alias("_l"))
    return whole.select("doc_id", "heading_start", "heading", "start", "end", F.array_join(F.transform("_l", lambda p: p["text"]), "").alias("text"))


def _long_sections(lines: DataFrame) -> DataFrame:
    titled = F.col("_title")
    mark = F.when(titled.isNotNull(), F.struct(F.col("start").alias("at"), F.when(titled > 0, F.substr("text", F.lit(1), titled - 1)).otherwise(F.col("text")).alias("heading"),
                                               F.when(titled > 0, F.col("start") + titled).otherwise(F.col("end")).alias("from")))
    rows = lines.withColumn("_ord", line_order()).withColumn("_title", _title_length())
    piece = F.floor(F.col("page") / PAGES_PER_PIECE)
    rows = skew.carried(rows, ["doc_id"], "_ord", piece, mark, "sec").where("sec IS NOT NULL")
    own = F.when(F.col("start") == F.col("sec.at"), F.col("text").substr((F.col("sec.from") - F.col("start")).cast("int") + 1, F.length("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("_own", own).withColumn("_at", F.col("sec.at"))
    # bounds and text of a section in one pass over its lines: first within each piece, then piece by piece
    line = F.struct("page", "n", F.col("_own").alias("t"))
    in_piece = rows.groupBy("doc_id", "_at", piece.alias("_p")).agg(
        F.first("sec").alias("sec"), F.max("end").alias("end"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["t"]), "").alias("t"))
    whole = in_piece.groupBy("doc_id", "_at").agg(F.first("sec").alias("sec"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("_p", "t"))).alias("_l"))
    return whole.select("doc_id", F.col("_at").alias("heading_start"), "sec.heading", F.col("sec.from").alias("start"), "end",
                        F.array_join(F.transform("_l", lambda p: p["t"]), "").alias("text"))
