"""Page to document extraction (EXT)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import html as H, skew, text as X
from docledger.operators.discover import explode_anchors


def analysis_text(docs: DataFrame, attachments: DataFrame, fan: int = 1000) -> DataFrame:
    """Body, then the text of every attachment that has one, in id order (EXT-10).

    Texts are joined in parts of `fan` attachments and the parts joined in order, so no task sorts
    an unbounded list; the result itself is one cell per document.
    """
    with_text = attachments.where(X.text("parsed_text") != "").select(
        F.col("policy_id").alias("id"), F.col("id").alias("aid"),
        F.concat(F.lit("[附件：") , X.text("name"), F.lit("]\n"), "parsed_text").alias("block"))
    joined = skew.joined(with_text, ["id"], [F.col("aid")], skew.piece_of("aid", 10 ** 9), "block", "\n\n", "_t", fan)
    body = F.concat(F.lit("[正文]\n"), X.text("content"))
    return docs.join(joined, "id", "left").withColumn("analysis_text", F.when(F.col("_t").isNull(), body).otherwise(F.concat(body, F.lit("\n\n"), "_t"))).drop("_t")


# ---- fixed values: patterns, containers and site rules ----
ATTACHMENT_EXT = r"(?i)\.(pdf|docx?|wps|xlsx?|zip|rar|ofd|txt)$"
NAME_PARAMS = ("filename", "name", "file", "fileurl", "url", "attachname", "filename1", "downloadname")
WENHAO = r"[A-Za-z一-鿿]{2,24}[〔\[【（(]\s*\d{4}\s*[〕\]】）)]\s*\d{1,6}\s*号"
DATE_KEYS = ("pubdate", "publishdate", "article:published_time", "firstpublishedtime", "date", "发布日期")
BLOCK_MARKS = ("访问验证", "安全验证", "访问被拒绝", "Access Denied", "验证码")
BLOCKED = "网页返回访问验证，需维护来源"
NO_CONTAINER = "未定位正文容器，整页文本仅供复核，需维护来源适配"
DROPPED = ("script", "style", "noscript", "header", "footer", "nav", ".toolbar", ".share", ".print", ".breadcrumb")
CONTAINERS = ("#UCAP-CONTENT", "#zoom", ".TRS_Editor", ".TRS_UEDITOR", ".tyxlContent", "#zoomcon", ".article-content", ".tys-main-zt-show",
              ".article_con", ".art_con", ".bt_content", "#content", "article", ".content", ".Custom_UnionStyle", "#trs_editor_view", ".newscontnet",
              "#con_main", ".slh_wrap", "#Article_Con", "#nry", "#NewsContent", ".Article_content", ".conBox", ".zcwjk-xlcon", ".article1")
# host mark, containers, shortest body, title rule, date pattern; the first mark in the URL wins
SITE_RULES = (
    ("ndrc.gov.cn", ("div.TRS_Editor", ".article_con"), 40, "bracket", r"发布时间[:：]\s*(20\d{2}/\d{1,2}/\d{1,2})"),
    ("fzggw.zj.gov.cn", ("div#zoom", "div.con"), 20, "h1", r"发布[日时间][^0-9]{0,8}(20\d{2}[-/年]\d{1,2}[-/月]\d{1,2})"),
    ("fzggw.jiangsu.gov.cn", ("div.TRS_Editor", "div#zoom"), 20, "h1-prefix", r"(?:发布时间|发布[日时]间|日期)\s*[:：]?\s*(20\d{2}[-/年.]\d{1,2}[-/月.]\d{1,2})"),
    ("yndrc.yn.gov.cn", (".show-content",), 1, "meta", r""),
)
TITLE_PREFIX = r"^\s*(?:江苏省发展和改革委员会|江苏省发展改革委)\s*(?:通知公告|发改要闻|政策解读|市县动态|图片新闻|时政要闻|要闻动态)?\s*"
ISSUER_SUFFIX = r"(?:人民政府|委员会|部|局|厅|办公室|发展改革委|中心)$"
SIGNATURE_DATE = r"^\s*((?:19|20)\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)\s*$"


def _meta(key: str) -> Column:
    """Content of the last meta tag of that name ('' if none)."""
    last = F.filter("_meta", lambda m: m["k"] == key)
    return F.coalesce(F.try_element_at(last, F.lit(-1))["v"], F.lit(""))


def page_meta(pages: DataFrame) -> DataFrame:
    """Add the meta map, the title and blocked (EXT-1, EXT-9)."""
    metas = F.transform(H.tags(F.col("html"), "meta"), lambda t: F.struct(
        F.lower(X.first_filled(H.attr(t, "name"), H.attr(t, "property"))).alias("k"), H.attr(t, "content").alias("v")))

    def element(pattern):
        return H.inner_text(F.regexp_extract("html", pattern, 1))
    heading = r"(?is)<h1(?=[\s>])[^>]*>(.*?)</h1\s*>"
    rows = pages.withColumn("_meta", metas).withColumn("_h1", element(heading)).withColumn("_doc_title", element(r"(?is)<title[^>]*>(.*?)</title\s*>"))
    h2 = element(r"""(?is)<h2\s[^>]*class\s*=\s*["'][^"'>]*title[^"'>]*["'][^>]*>(.*?)</h2\s*>""")
    # an h1 that exists but is empty still wins over h2 and title
    by_element = F.when(F.col("html").rlike(heading), F.col("_h1")).otherwise(X.first_filled(h2, F.col("_doc_title")))
    title = X.first_filled(_meta("articletitle"), _meta("og:title"), by_element)
    return rows.withColumn("title", title).withColumn("blocked", X.contains_any(F.col("title"), BLOCK_MARKS))


def labelled_fields(rows: DataFrame) -> DataFrame:
    """Add page_date, doc_date, wenhao, issuing_authority and publisher from meta tags and labelled text (EXT-3)."""
    rows = rows.withColumn("_text", H.visible_text(F.col("html")))

    def label(pattern):
        return F.regexp_extract("_text", "(?U)" + pattern, 1)
    page_date = X.first_filled(*[X.date_value(_meta(k)) for k in DATE_KEYS], X.date_value(label(r"(?:发布时间|发布日期|发布[日时]间|日期)\s*[:：]\s*([\d年月日/ .-]{8,24})")))
    doc_date = X.first_filled(X.date_value(X.first_filled(_meta("成文日期"), _meta("documentdate"))),
                              X.date_value(label(r"(?:成文日期|生成日期|成文时间)\s*[:：]?\s*([\d年月日/ .-]{8,24})")))
    wenhao = X.first_filled(_meta("文号"), _meta("docnumber"), label(r"(?:文件编号|发文字号|文号)\s*[:：]?\s*(\S{2,45}号)"))
    issuer = X.first_filled(_meta("发文机关"), _meta("issuingauthority"))
    publisher = label(r"(?:发布机构|发文机关)\s*[:：]\s*(\S{2,30}?(?:发改委|政府|厅|局|委|办公室|部))")
    return rows.withColumn("page_date", page_date).withColumn("doc_date", doc_date).withColumn("wenhao", wenhao) \
        .withColumn("issuing_authority", issuer).withColumn("publisher", F.when(issuer == "", publisher).otherwise(""))


def number_line(content: Column) -> Column:
    """1-based number of the first line that is a document number by itself; NULL without one (EXT-4)."""
    alone = F.transform(F.split(content, "\n"), lambda l, i: F.when(X.strip(l).rlike(f"(?U)^(?:{WENHAO})$"), i + 1))
    return F.array_min(alone)


def document_number(content: Column, title: Column, found: Column, alone: Column) -> Column:
    """The document's own number (EXT-4): labelled, standing alone in an element or on a line, else in the title; never
    one cited inside a paragraph."""
    own = F.get(F.split(content, "\n"), number_line(content) - 1)
    return X.first_filled(found, X.without_space(alone), X.without_space(F.coalesce(own, F.lit(""))),
                          X.without_space(F.regexp_extract(title, "(?U)" + WENHAO, 0)))


def signature(rows: DataFrame) -> DataFrame:
    """Fill doc_date from the last date line and the issuers from the short lines directly above it (EXT-7)."""
    date_line = "(?U)" + SIGNATURE_DATE
    lines = F.split("content", "\n")
    at = F.array_max(F.transform(lines, lambda l, i: F.when(l.rlike(date_line), i)))
    rows = rows.withColumn("_lines", lines).withColumn("_at", at)
    before = F.filter(F.transform(F.slice("_lines", F.lit(1), F.coalesce("_at", F.lit(0))), X.strip), lambda l: l != "")
    near = F.slice(F.reverse(before), F.lit(1), F.lit(20))
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(True).alias("on"))

    def step(acc, line):
        fits = acc["on"] & (F.length(line) <= 45) & line.rlike(ISSUER_SUFFIX)
        return F.struct(F.when(fits, F.concat(F.array(line), acc["names"])).otherwise(acc["names"]).alias("names"), fits.alias("on"))
    issuers = F.array_join(F.aggregate(near, start, step, lambda a: a["names"]), "、")
    signed = F.when(F.col("_at").isNotNull(), F.get("_lines", F.col("_at"))).otherwise("")
    return rows.withColumn("doc_date", X.first_filled(X.text("doc_date"), X.date_value(signed))) \
        .withColumn("issuing_authority", X.first_filled(X.text("issuing_authority"), F.when(F.col("_at").isNotNull(), issuers).otherwise(""))) \
        .drop("_lines", "_at")


def _by_site(value, default: Column) -> Column:
    out = F
    for rule in SITE_RULES:
        out = out.when(F.contains("page_url", F.lit(rule[0])), value(rule))
    return out.otherwise(default)


def main_content(rows: DataFrame) -> DataFrame:
    """Body container, its text and the number standing alone (EXT-5, EXT-6). The page is walked once, in Arrow batches."""
    site = _by_site(lambda r: F.lit(list(r[1])), F.array().cast("array<string>"))
    minimum = _by_site(lambda r: F.lit(r[2]), F.lit(0))
    parts = H.page_parts(CONTAINERS, WENHAO, DROPPED)
    return rows.withColumn("_parts", parts(F.col("html"), site, minimum))


def site_override(rows: DataFrame) -> DataFrame:
    """Title and date rules of known hosts where their own container was used (EXT-6)."""
    doc_title, h1 = F.col("_doc_title"), X.first_filled(F.col("_h1"), F.col("_doc_title"))
    titles = {
        "bracket": F.when(doc_title.rlike("^【(.+?)】"), F.regexp_extract(doc_title, "^【(.+?)】", 1)).otherwise(F.trim(F.get(F.split(doc_title, "[_-]"), F.lit(0)))),
        "h1": h1, "h1-prefix": F.trim(F.regexp_replace(h1, TITLE_PREFIX, "")), "meta": _meta("articletitle")}
    custom = F.col("_parts.custom")
    own_title = _by_site(lambda r: titles[r[3]], F.lit(""))
    meta_title = X.first_filled(_meta("articletitle"), _meta("og:title"))
    own_date = _by_site(lambda r: X.date_value(F.regexp_extract("_text", r[4], 1)) if r[4] else F.substring(_meta("pubdate"), 1, 10), F.lit(""))
    return rows.withColumn("title", F.when(custom & (meta_title == "") & (own_title != ""), own_title).otherwise(F.col("title"))) \
        .withColumn("page_date", X.first_filled(F.col("page_date"), F.when(custom, own_date).otherwise("")))


DOCUMENT = ["title", "wenhao", "issuing_authority", "page_date", "doc_date", "content", "parse_error"]


def parse_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages (page_url, html, ...) to documents; a verification page yields nothing but its error (EXT-1 to EXT-9)."""
    keep = [c for c in pages.columns if c != "html"]
    rows = site_override(main_content(labelled_fields(page_meta(pages))))
    rows = rows.withColumn("content", F.col("_parts.body")) \
        .withColumn("wenhao", document_number(F.col("content"), F.col("title"), F.col("wenhao"), F.col("_parts.number")))
    rows = signature(rows).withColumn("issuing_authority", X.first_filled(F.col("issuing_authority"), F.col("publisher"))) \
        .withColumn("parse_error", F.when(F.col("blocked"), BLOCKED).when(~F.col("_parts.located"), NO_CONTAINER).otherwise(""))
    # what a blocked page says about itself is not metadata
    empty = ("wenhao", "issuing_authority", "page_date", "doc_date", "content")
    return rows.select(*keep, *[F.when(F.col("blocked"), "").otherwise(F.col(c)).alias(c) if c in empty else F.col(c) for c in DOCUMENT])


def explode_attachments(pages: DataFrame) -> DataFrame:
    """Document links of each page (EXT-8): by path, by a file-name parameter of a gateway, by link text, or a download button."""
    anchors = explode_anchors(pages)
    click = F.regexp_extract("onclick", r"^\s*downloadFj\(\s*'([^']+)'\s*,\s*'([^']+)'\s*\);?\s*$", 1)
    target = F.regexp_extract("onclick", r"^\s*downloadFj\(\s*'([^']+)'\s*,\s*'([^']+)'\s*\);?\s*$", 2)
    rows = anchors.withColumn("_name", X.first_filled(click, F.col("download"), F.col("label"))) \
        .withColumn("_href", X.first_filled(target, F.col("raw_href"))).where("_href != ''")
    rows = rows.withColumn("url", H.absolute_url("_href", "page_url")).where(F.lower("url").rlike("^(https?|file):"))
    rows = rows.withColumn("_path", unquoted(F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1))) \
        .withColumn("_query", F.regexp_extract("url", r"\?([^#]*)", 1))
    pairs = F.transform(F.split("_query", "&"), lambda kv: F.struct(F.lower(F.substring_index(kv, "=", 1)).alias("k"), unquoted(
        F.when(F.contains(kv, F.lit("=")), F.regexp_extract(kv, "=(.*)$", 1)).otherwise("")).alias("v")))
    named = F.get(F.filter(pairs, lambda p: p["k"].isin(*NAME_PARAMS) & p["v"].rlike(ATTACHMENT_EXT)), F.lit(0))["v"]
    rows = rows.withColumn("_gateway", F.coalesce(named, F.lit("")))

    def extension(c):
        return F.lower(F.regexp_extract(c, ATTACHMENT_EXT, 1))
    by_path, by_query = extension(F.col("_path")), extension(F.col("_gateway"))
    fmt = X.first_filled(by_path, by_query, extension(unquoted(F.col("_name"))))
    plain = F.lower("_href").rlike(r"\.(pdf|doc|docx|wps)$")
    name = X.first_filled(F.col("_name"), F.when((by_path == "") & ~plain, F.col("_gateway")).otherwise(""), F.regexp_extract("_path", r"([^/]*)/*$", 1))
    rows = rows.withColumn("fmt", fmt).withColumn("name", name).where("fmt != ''")
    return skew.newest(rows, ["page_url", "url"], [F.col("pos")]).select("page_url", "pos", "name", "url", "fmt")


def unquoted(col: Column) -> Column:
    """Percent-decoding that leaves '+' and malformed escapes alone."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)
