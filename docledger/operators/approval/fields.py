"""Fixed fields of approval documents (APR-5 to APR-11, APR-15 to APR-17, APR-24, APR-25)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew, text as X
from docledger.operators.approval.lines import line_id, line_order, packed

# ---- fixed values: field names, stages, patterns ----
FIELDS = ("发文机关标志", "发文字号", "标题", "印章", "印发机关", "印发日期", "项目名称", "项目代码", "项目单位", "建设内容", "建设地点", "总投资/匡算/估算/概算", "资金来源", "建设周期")
STAGES = ("建议书/立项", "可行性研究", "初步设计", "核准/备案", "待确认")
ORG = "(?:公司|集团|局|委员会|办公室|街道办事处|管委会|管理委员会|人民政府|中心|医院|学校|学院|大学|研究院|银行|合作社|农场|林场|中学|小学|幼儿园|法院|检察院)"
DOC_NUMBER = r"[一-鿿]{2,15}[〔\[［【（(]\d{4}[〕\]］】）)]\d+号"
INVESTMENT, FUNDING, PERIOD = "总投资/匡算/估算/概算", "资金来源", "建设周期"
# field: (pattern, where group 1 sits in the match)
FIXED_PATTERNS = {
    "标题": (r"(关于.{3,100}?的批复)", "start"), "项目代码": (r"(\d{4}-\d{6}-\d{2}-\d{2}-\d{6})", "start"),
    "印发日期": (r"(\d{4}年\d{1,2}月\d{1,2}日)印发", "start"), "发文机关标志": (r"([一-鿿]{2,25}(?:局|委员会|政府|办公室)文件)", "start"),
    PERIOD: (r"(?:项目建设工期为|建设工期为|工期为|建设周期为|(?:工程)?实施周期)(约?\d+(?:\.\d+)?(?:个月|月|年))", "end"),
    "项目单位": (rf"(?:项目业主|建设单位)[：:]?([一-鿿]{{3,40}}{ORG})", "end"),
    INVESTMENT: (r"((?:项目|工程|本工程|本项目)?(?:估算总投资|概算总投资|投资概算|投资估算|总投资|投资匡算)(?:为)?约?\d+(?:\.\d+)?(?:万元|亿元))", "start"),
    FUNDING: (r"((?:建设资金|所需建设资金|所需资金)[^。]+)", "start"),
}
PROJECT_NAME = "关于(.+?)(?:项目建议书|可行性研究报告|初步设计|立项申请|项目申请报告|核准)的批复"
SECTION_FIELDS = {"建设内容": ("建设内容", "建设规模"), "建设地点": ("选址", "建设地点")}
SECTION_STOP = "请据此|根据省、市|根据国家|附注：|抄送："
MISSING_CUES = {
    "发文字号": DOC_NUMBER, "标题": r"关于.{3,100}?的批复", "印发日期": r"\d{4}年\d{1,2}月\d{1,2}日印发", "项目名称": PROJECT_NAME,
    "项目代码": r"\d{4}-\d{6}-\d{2}-\d{2}-\d{6}", "项目单位": "(?:项目业主|建设单位|项目单位)", "建设内容": "(?:建设内容|建设规模|主要建设)",
    "建设地点": "(?:项目|工程|建设)地[址点]|选址", INVESTMENT: "(?:投资估算|概算|总投资|投资匡算|估算总投资|概算总投资)",
    FUNDING: "(?:资金来源|建设资金|所需资金|运营资金)", PERIOD: "(?:工期|建设周期|实施周期|建设期)", "发文机关标志": r"[一-鿿]{2,25}(?:局|委员会|政府|办公室)文件"}
LOW_OFFICE, IMPRINT_DATE, IMPRINT_UNIT = "^[一-鿿]{3,30}办公室$", r"\d{4}年\d+月\d+日印发", r"^([一-鿿]{3,35}(?:局|委员会|办公室))(?=\d{4}年|$)"
ADDRESSEE = f"^([一-鿿]{{3,40}}{ORG})[：:]$"
REVIEW_STATES = ("needs_review", "conflict", "uncertain")
NUMBER_MISMATCH = ("发文字号「", "」的括号或数字写法不符公文格式（规范写法应为六角括号「〔〕」加半角数字），该形态可能来自图片层识别误差；已按原文保留，机器比对时按「", "」处理。")
# a text without these words cannot match; a search for a word is far cheaper than one for a name of open length before it
NEEDED_WORDS = {"发文机关标志": "文件", "发文字号": "号", "标题": "的批复", "项目名称": "的批复", "印发日期": "印发"}
MODEL_PROTECTED = ("发文字号", "项目代码", "印发日期", "印发机关", "印章")


def found(text: Column, pattern: str, side: str) -> Column:
    """STRUCT<value, start, end> of group 1 of the first match, NULL without one."""
    # one search of the text; the patterns look at nothing outside their match, so the first
    # occurrence of the matched text is the match
    def placed(whole):
        value, at = F.regexp_extract(whole, pattern, 1), F.instr(text, whole) - 1
        start = (at if side == "start" else at + F.length(whole) - F.length(value)).cast("long")
        return F.when(whole != "", F.struct(value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end")))
    # a lambda's argument is computed once, however often it is used
    return F.get(F.transform(F.array(F.regexp_extract(text, pattern, 0)), placed), F.lit(0))


def _may_match(text: Column, name: str) -> Column:
    return F.contains(text, F.lit(NEEDED_WORDS[name])) if name in NEEDED_WORDS else text.isNotNull()


def _matched(text: Column) -> Column:
    """Name, match and place of each pattern that matches, in the order of the patterns. Every pattern searches a text once."""
    whole = F.array(*[F.struct(F.lit(name).alias("name"), F.when(_may_match(text, name), F.regexp_extract(text, p, 0)).otherwise("").alias("whole")) for name, (p, _) in FIXED_PATTERNS.items()])
    # only what matched is looked at again; a lambda's argument is computed once, however often it is used
    return F.transform(F.filter(whole, lambda e: e["whole"] != ""), lambda e: F.struct(e["name"].alias("name"), e["whole"].alias("whole"), (F.instr(text, e["whole"]) - 1).alias("at")))


def _value(name: Column, whole: Column) -> Column:
    return F.coalesce(*[F.when(name == n, F.regexp_extract(whole, p, 1)) for n, (p, _) in FIXED_PATTERNS.items()])


def _start(name: Column, whole: Column, at: Column, value: Column) -> Column:
    ends = name.isin(*[n for n, (_, side) in FIXED_PATTERNS.items() if side == "end"])
    return F.when(ends, at + F.length(whole) - F.length(value)).otherwise(at).cast("long")


def fixed_fields(texts: DataFrame) -> DataFrame:
    """Pattern fields of each document text: doc_id, name, value, start, end (APR-5). Packed lines of the document stay beside them."""
    rows = texts.select("doc_id", *(["_lines"] if packed(texts) else []), F.explode(_matched(F.col("text"))).alias("e"))
    kept = [c for c in rows.columns if c != "e"]
    name, whole, at = F.col("e.name"), F.col("e.whole"), F.col("e.at")
    rows = rows.select(*kept, name.alias("name"), whole.alias("whole"), at.alias("at"), F.explode(F.array(_value(name, whole))).alias("value"))
    start = _start(F.col("name"), F.col("whole"), F.col("at"), F.col("value"))
    return rows.select(*kept, "name", "value", start.alias("start"), (start + F.length("value")).alias("end"), F.lit("extracted").alias("status"), F.lit("rule").alias("method"))


def normalize_doc_number(value: Column) -> Column:
    """Canonical document number: 〔〕 brackets, ASCII digits, no white space (APR-6)."""
    folded = F.translate(X.without_space(X.text(value)), "[［【（(]］】）)", "〔〔〔〔〔〕〕〕〕〕")
    return F.translate(folded, "０１２３４５６７８９", "0123456789")


def doc_number(lines: DataFrame) -> DataFrame:
    """First whole line of page 1 that is a document number; the original is kept (APR-6)."""
    hits = lines.where((F.col("page") == 1) & F.contains("text", F.lit("号")) & F.col("text").rlike(f"^(?:{DOC_NUMBER})$"))
    first = hits.groupBy("doc_id").agg(F.min_by(F.struct("text", "start", "end"), "n").alias("h"))
    out = first.select("doc_id", F.lit("发文字号").alias("name"), F.col("h.text").alias("value"), "h.start", "h.end",
                       F.lit("extracted").alias("status"), F.lit("rule").alias("method"), normalize_doc_number(F.col("h.text")).alias("normalized"))
    a, b, c = NUMBER_MISMATCH
    return out.withColumn("warning", F.when(F.col("value") != F.col("normalized"), F.concat(F.lit(a), "value", F.lit(b), "normalized", F.lit(c))))


def stage(title: Column) -> Column:
    """Approval stage by the words of the title (APR-7)."""
    t = X.text(title)
    return F.when(X.contains_any(t, ("核准", "备案")), "核准/备案").when(F.contains(t, F.lit("初步设计")), "初步设计") \
        .when(F.contains(t, F.lit("可行性研究")), "可行性研究").when(X.contains_any(t, ("建议书", "立项")), "建议书/立项").otherwise("待确认")


def project_name(titles: DataFrame) -> DataFrame:
    """Project named inside the title; inferred, so always to review (APR-8). `titles`: doc_id, value, start."""
    value = F.regexp_extract("value", PROJECT_NAME, 1)
    at = (F.col("start") + F.regexp_instr("value", F.lit(PROJECT_NAME)) - 1 + 2).cast("long")
    return titles.where(value != "").select("doc_id", F.lit("项目名称").alias("name"), value.alias("value"), at.alias("start"), (at + F.length(value)).alias("end"),
                                            F.lit("needs_review").alias("status"), F.lit("title-inference").alias("method"))


def imprint(lines: DataFrame) -> DataFrame:
    """Issuing office: an office line in the lower 45 % of a page, else the unit beside the issue date (APR-9).

    `lines` carries page_height. The neighbour search joins on (document, page) and 12-point bands.
    """
    y = F.get("bbox", F.lit(1))
    rows = lines.withColumn("_y", y).withColumn("_ord", line_order())
    low = rows.where(F.contains("text", F.lit("办公室")) & F.col("text").rlike(LOW_OFFICE) & (F.col("_y") > F.col("page_height") * 0.55))
    a = low.groupBy("doc_id").agg(F.min_by(F.struct(F.col("text").alias("value"), "start"), "_ord").alias("a"))
    dated = rows.where(F.contains("text", F.lit("印发")) & F.col("text").rlike(IMPRINT_DATE)).select("doc_id", "page", F.col("_y").alias("_dy"), F.col("_ord").alias("_date"), F.explode(
        F.array(*[F.floor(F.col("_y") / 12) + d for d in (-1, 0, 1)])).alias("_band"))
    near = rows.where(F.col("text").rlike(IMPRINT_UNIT)).withColumn("_band", F.floor(F.col("_y") / 12)).join(dated, ["doc_id", "page", "_band"]) \
        .where(F.abs(F.col("_y") - F.col("_dy")) < 12)
    b = near.groupBy("doc_id").agg(F.min_by(F.struct(F.regexp_extract("text", IMPRINT_UNIT, 1).alias("value"), "start"), F.struct("_date", "_ord")).alias("b"))
    out = a.join(b, "doc_id", "full").withColumn("h", F.coalesce("a", "b"))
    return out.select("doc_id", F.lit("印发机关").alias("name"), "h.value", "h.start", (F.col("h.start") + F.length("h.value")).alias("end"),
                      F.lit("extracted").alias("status"), F.lit("rule").alias("method"))


def addressee(lines: DataFrame) -> DataFrame:
    """Owner fallback: an organisation ending in a colon within four lines after the document number (APR-10)."""
    first = lines.where("page = 1")
    number = first.where(F.contains("text", F.lit("号")) & F.col("text").rlike(f"^(?:{DOC_NUMBER})$")).groupBy("doc_id").agg(F.min("n").alias("_at"))
    rows = first.where(X.contains_any(F.col("text"), ("：", ":")) & F.col("text").rlike(ADDRESSEE)).join(number, "doc_id", "left").withColumn("_from", F.coalesce("_at", F.lit(0)))
    rows = rows.where((F.col("n") > F.col("_from")) & (F.col("n") <= F.col("_from") + 4))
    best = rows.groupBy("doc_id").agg(F.min_by(F.struct(F.regexp_extract("text", ADDRESSEE, 1).alias("value"), "start"), "n").alias("h"))
    return best.select("doc_id", F.lit("项目单位").alias("name"), "h.value", "h.start", (F.col("h.start") + F.length("h.value")).alias("end"),
                       F.lit("needs_review").alias("status"), F.lit("addressee").alias("method"))


def section_fields(sections: DataFrame) -> DataFrame:
    """Scope and location: the first matching section, cut at signature and appendix marks (APR-11)."""
    out = None
    for name, words in SECTION_FIELDS.items():
        hits = sections.where(X.contains_any(F.col("heading"), words))
        first = hits.groupBy("doc_id").agg(F.min_by(F.struct("text", "start"), "heading_start").alias("s"))
        value = F.get(F.split("s.text", SECTION_STOP, 2), F.lit(0))
        rows = first.select("doc_id", F.lit(name).alias("name"), value.alias("value"), "s.start", (F.col("s.start") + F.length(value)).alias("end"),
                            F.lit("extracted").alias("status"), F.lit("rule").alias("method")).where("value != ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def refine_header_mark(mark: Column, office: Column) -> Column:
    """STRUCT<value, kind>: trim to the last occurrence of the office's core name; a mismatch is flagged, not rewritten (APR-17)."""
    core = F.regexp_replace(office, "(?:办公室|秘书科|综合科|机要科)$", "")
    keep = (X.text(office) == "") | (F.length(core) < 5) | (mark == F.concat(core, F.lit("文件")))
    tail = F.concat(core, F.call_function("substring_index", mark, core, F.lit(-1)))
    value = F.when(keep | ~F.contains(mark, core), mark).otherwise(tail)
    kind = F.when(keep, "").when(F.contains(mark, core), "trimmed").otherwise("mismatch")
    return F.struct(value.alias("value"), kind.alias("kind"))


CELL_COLUMNS = ("doc_id", "name", "value", "start", "end", "status", "method")


def _cell(name, value: Column, start: Column, status: str = "extracted", method: str = "rule") -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), value.alias("value"), start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end"), F.lit(status).alias("status"), F.lit(method).alias("method"))


def _first(rows: Column) -> Column:
    return F.slice(rows, 1, 1)


def _is_number(line) -> Column:
    return (line["page"] == 1) & F.contains(line["text"], F.lit("号")) & line["text"].rlike(f"^(?:{DOC_NUMBER})$")


def _fields_in(matched: Column) -> Column:
    def cell(e):
        return F.get(F.transform(F.array(_value(e["name"], e["whole"])), lambda v: _cell(e["name"], v, _start(e["name"], e["whole"], e["at"], v))), F.lit(0))
    return F.transform(matched, cell)


def _doc_number_in(lines: Column) -> Column:
    return F.transform(_first(F.filter(lines, _is_number)), lambda l: _cell("发文字号", l["text"], l["start"]))


def _imprint_in(lines: Column) -> Column:
    y = lambda l: F.get(l["bbox"], F.lit(1))
    low = F.filter(lines, lambda l: F.contains(l["text"], F.lit("办公室")) & l["text"].rlike(LOW_OFFICE) & (y(l) > l["page_height"] * 0.55))
    own = F.transform(_first(low), lambda l: F.struct(l["text"].alias("value"), l["start"].alias("start")))
    dated = F.filter(lines, lambda l: F.contains(l["text"], F.lit("印发")) & l["text"].rlike(IMPRINT_DATE))
    # of the first dated line that has a unit beside it, the first unit
    beside = F.transform(dated, lambda d: _first(F.filter(lines, lambda l: (l["page"] == d["page"]) & (F.abs(y(l) - y(d)) < 12) & l["text"].rlike(IMPRINT_UNIT))))
    near = F.transform(_first(F.filter(beside, lambda u: F.size(u) > 0)), lambda u: F.struct(F.regexp_extract(u[0]["text"], IMPRINT_UNIT, 1).alias("value"), u[0]["start"].alias("start")))
    return F.transform(_first(F.concat(own, near)), lambda h: _cell("印发机关", h["value"], h["start"]))


def _addressee_in(lines: Column) -> Column:
    after = F.coalesce(F.get(F.filter(lines, _is_number), F.lit(0))["n"], F.lit(0))

    def named(after):
        rows = F.filter(lines, lambda l: (l["page"] == 1) & (l["n"] > after) & (l["n"] <= after + 4) & X.contains_any(l["text"], ("：", ":")) & l["text"].rlike(ADDRESSEE))
        return F.transform(_first(rows), lambda l: _cell("项目单位", F.regexp_extract(l["text"], ADDRESSEE, 1), l["start"], "needs_review", "addressee"))
    return F.get(F.transform(F.array(after), named), F.lit(0))


def _section_fields_in(sections: Column) -> Column:
    def cut(name):
        return lambda s: F.get(F.transform(F.array(F.get(F.split(s["text"], SECTION_STOP, 2), F.lit(0))), lambda v: _cell(name, v, s["start"])), F.lit(0))
    rows = [F.transform(_first(F.filter(sections, lambda s: X.contains_any(s["heading"], words))), cut(name)) for name, words in SECTION_FIELDS.items()]  # noqa: B023
    return F.filter(F.concat(*rows), lambda c: c["value"] != "")


def _project_name_in(fields: Column) -> Column:
    def named(c):
        at = c["start"] + F.regexp_instr(c["value"], F.lit(PROJECT_NAME)) - 1 + 2
        return F.get(F.transform(F.array(F.regexp_extract(c["value"], PROJECT_NAME, 1)), lambda v: _cell("项目名称", v, at, "needs_review", "title-inference")), F.lit(0))
    return F.filter(F.transform(F.filter(fields, lambda c: c["name"] == "标题"), named), lambda c: c["value"] != "")


def _packed_cells(docs: DataFrame) -> DataFrame:
    """Packed documents, with text and sections, and their cells in `_cells`; the sources rank as in `document_cells`."""
    docs = skew.held(docs, _fields=_fields_in(_matched(F.col("text"))))
    lines, fields = F.col("_lines"), F.col("_fields")
    docs = skew.held(docs, _found=F.concat(fields, _doc_number_in(lines), _imprint_in(lines), _section_fields_in(F.col("_sections")), _project_name_in(fields), _addressee_in(lines)))
    docs = skew.held(docs, _names=F.transform("_found", lambda c: c["name"]))
    return skew.held(docs, _cells=F.filter("_found", lambda c, i: F.array_position(F.col("_names"), c["name"]) == i + 1)).drop("_fields", "_found", "_names")


def document_cells(lines: DataFrame, texts: DataFrame, sections: DataFrame) -> DataFrame:
    """All cells found for each document, one per (doc_id, name); earlier sources win (APR-5 to APR-11).

    Packed sections hold all that is needed: the cells stand beside them in `_cells`.
    """
    if packed(sections):
        return _packed_cells(sections)
    fields = skew.pinned(fixed_fields(texts))  # also read for the project name
    ranked = [fields, doc_number(lines).select(*CELL_COLUMNS), imprint(lines), section_fields(sections), project_name(fields.where("name = '标题'")), addressee(lines)]
    union = None
    for i, part in enumerate(ranked):
        part = part.select(*CELL_COLUMNS).withColumn("_rank", F.lit(i))
        union = part if union is None else union.unionByName(part)
    best = union.groupBy("doc_id", "name").agg(F.min_by(F.struct("value", "start", "end", "status", "method"), "_rank").alias("c"))
    return best.select("doc_id", "name", "c.*")


def known_cells() -> Column:
    """The packed cells of a document; none where it has no id to join them by."""
    return F.when(F.col("doc_id").isNotNull(), F.col("_cells"))


def missing_reason(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """The 14 cells of every document; an empty one is unextracted if its cue occurs, else absent (APR-15)."""
    if packed(cells):
        others, rows = CELL_COLUMNS[2:], cells.withColumn("_cells", known_cells())
    else:
        others = [c for c in cells.columns if c not in ("doc_id", "name")]
        rows = texts.join(cells.groupBy("doc_id").agg(F.collect_list(F.struct("name", *others)).alias("_cells")), "doc_id", "left")
    one = rows.schema["_cells"].dataType.elementType

    def cell(name):
        cue = _may_match(F.col("text"), name) & F.col("text").rlike(MISSING_CUES[name]) if name in MISSING_CUES else F.lit(False)
        row = lambda c, seen: F.struct(F.lit(name).alias("name"), c.alias("cell"), seen.alias("cue"))
        # an empty cell alone is searched for its cue
        own = F.transform(F.filter("_cells", lambda c: c["name"] == name), lambda c: row(c, F.when(c["value"].isNull(), cue)))
        return F.when(F.size(own) > 0, own).otherwise(F.array(row(F.lit(None).cast(one), cue)))
    out = rows.select("doc_id", F.explode(F.flatten(F.array(*[cell(n) for n in FIELDS]))).alias("c")).select("doc_id", "c.name", *[F.col("c.cell")[c].alias(c) for c in others], "c.cue")
    empty = F.col("value").isNull()
    return out.withColumn("status", F.coalesce("status", F.lit("missing"))).withColumn("method", F.coalesce("method", F.lit("rule"))) \
        .withColumn("reason", F.when(empty & (F.col("status") == "missing"), F.when(F.col("cue"), "unextracted").otherwise("absent"))).drop("cue")


def quality_summary(cells: DataFrame) -> DataFrame:
    """With evidence, to review, absent, unextracted per document (APR-16). A cell with a span has evidence."""
    return cells.groupBy("doc_id").agg(
        F.count_if(F.col("start").isNotNull()).alias("evidence_fields"), F.count_if(F.col("status").isin(*REVIEW_STATES)).alias("review_fields"),
        F.count_if(F.col("reason") == "absent").alias("missing_absent"), F.count_if(F.col("reason") == "unextracted").alias("missing_unextracted"))


def _quoted_proposals(rows: DataFrame, key: list[str], docs: DataFrame) -> DataFrame:
    """Proposals with the number and the text of the lines they name, taken from the packed lines of their document.

    Proposals meet once by document, there those of one key share their lines, and then the document. A key with a part missing has no lines.
    """
    lines = docs.select("doc_id", F.transform("_lines", lambda l: F.struct(line_id(l).alias("id"), l["text"].alias("text"))).alias("_lines"))
    rows = rows.repartition("doc_id").groupBy(*key).agg(F.collect_list("_ids").alias("_each")).join(lines, "doc_id", "left")
    named = F.filter("_lines", lambda l: F.array_contains(F.col("_all"), l["id"]))
    # a line counts once for each proposal of the key that names it
    times = F.flatten(F.transform(named, lambda l: F.array_repeat(l["text"], F.size(F.filter("_all", lambda i: i == l["id"])))))
    rows = skew.held(rows, _all=F.flatten("_each"))
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rows = skew.held(rows, _texts=F.when(whole, times))
    rows = rows.select(*key, F.array_join("_texts", "").alias("_quote"), F.when(F.size("_texts") > 0, F.size("_texts")).alias("_found"), F.explode("_each").alias("_ids"))
    return rows


def ground_proposals(proposals: DataFrame, lines: DataFrame) -> DataFrame:
    """Model values that their quoted lines really contain (APR-24).

    `proposals`: doc_id, kind (field / metric), name, value, evidence_ids. Identity fields are never
    taken from a model; metrics must parse as a quantity. Adds accepted and the reason otherwise.
    """
    from docledger.functions.quantity import quantity
    key = ["doc_id", "kind", "name", "value"]
    ids = F.array_distinct(F.coalesce("evidence_ids", F.array().cast("array<string>")))
    rows = proposals.withColumn("_ids", ids)
    if packed(lines):
        rows = _quoted_proposals(rows, key, lines)
    else:
        quoted = rows.select(*key, F.explode("_ids").alias("id")).join(lines.select("doc_id", "id", "page", "n", "text"), ["doc_id", "id"])
        # the lines that a proposal names are few: they meet once, for the quote and their number
        quotes = quoted.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("page", "n", "text"))).alias("_l"))
        rows = rows.join(quotes.select(*key, F.array_join(F.transform("_l", lambda s: s["text"]), "").alias("_quote"), F.size("_l").alias("_found")), key, "left")
    inside = F.contains(X.without_space(X.text("_quote")), X.without_space(X.text("value")))
    reason = F.when((F.col("kind") == "field") & ~F.col("name").isin(*FIELDS), "unknown field") \
        .when((F.col("kind") == "field") & F.col("name").isin(*MODEL_PROTECTED), "protected field") \
        .when((X.text("value") == "") | (F.size("_ids") == 0), "no value or evidence") \
        .when(F.coalesce("_found", F.lit(0)) < F.size("_ids"), "unknown evidence id").when(~inside, "value not in evidence") \
        .when((F.col("kind") == "metric") & quantity(F.col("value")).isNull(), "not a quantity").otherwise("")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "").select(*key, "accepted", "reason")


def project_groups(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents with their project key (code, else unassigned:id) and name (APR-25). `docs`: doc_id, filename; or packed, with the cells."""
    if packed(docs):
        of = lambda name: F.get(F.filter(known_cells(), lambda c: c["name"] == name), F.lit(0))["value"]
        return _grouped(docs.withColumns({"_code": of("项目代码"), "_name": of("项目名称"), "_title": of("标题"), "issued": of("印发日期")}))
    wide = cells.where(F.col("name").isin("项目代码", "项目名称", "标题", "印发日期")).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(a) for n, a in (("项目代码", "_code"), ("项目名称", "_name"), ("标题", "_title"), ("印发日期", "issued"))])
    return _grouped(docs.join(wide, "doc_id", "left"))


def _grouped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("project_key", F.coalesce("_code", F.concat(F.lit("unassigned:"), "doc_id"))) \
        .withColumn("project_name", F.coalesce("_name", "filename")).withColumn("stage", stage(F.col("_title"))).drop("_code", "_name", "_title")
