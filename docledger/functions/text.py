"""Text normalisation and hashing as column expressions.

Blank text is '' at rest (never NULL), as in the ledger tables. Patterns that must treat
ideographic spaces as white space carry the (?U) flag.
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

SPACES = r"(?U)\s+"


def text(col) -> Column:
    """NULL-free text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def first_filled(*cols: Column) -> Column:
    """First non-blank value, '' when all are blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def squeeze(col: Column) -> Column:
    """Collapse runs of white space into one space and trim."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def without_space(col: Column) -> Column:
    return F.regexp_replace(col, SPACES, "")


def norm_text(col: Column) -> Column:
    """Match form for keywords: lower case without ASCII blanks and newlines."""
    return F.translate(F.lower(F.coalesce(col, F.lit(""))), " \n", "")


def clean_text(col: Column) -> Column:
    """Ideographic space to space, at most one blank line in a row, trimmed."""
    spaced = F.translate(F.coalesce(col, F.lit("")), "\u3000", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


# Spark has no NFKC function; applied to short columns (titles, numbers) only.
nfkc = F.pandas_udf(_nfkc, T.StringType())


def norm_title(col: Column) -> Column:
    """Title identity: NFKC, no book-title marks, quotes or white space, lower case."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(col, F.lit(""))), r'(?U)[《》"“”\s]', ""))


def normalized_label(col: Column) -> Column:
    """Title or number without any bracket, quote, colon or white space."""
    return F.regexp_replace(nfkc(F.coalesce(col, F.lit(""))), r'(?U)[\s《》〔〕\[\]【】（）()“”"：:]', "")


def sha256(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def json_string(col: Column) -> Column:
    """A JSON string literal with the escapes Python's json.dumps writes (ensure_ascii off)."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def first_of(text_col: Column, words) -> Column:
    """First word of the list (in list order) that the text contains, '' if none."""
    return F.coalesce(*[F.when(F.contains(text_col, F.lit(w)), F.lit(w)) for w in words], F.lit(""))


def contains_any(text_col: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text_col, F.lit(w))
    return out


def hits(text_col: Column, words) -> Column:
    """Words of the list the text contains, in list order.

    One `contains` per word inside whole-stage codegen: no UDF, no join with a word table.
    """
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(text_col, F.lit(w)), F.lit(w)) for w in words]))


def date_value(col: Column) -> Column:
    """First 19xx/20xx year-month-day in the text as YYYY-MM-DD; '' if none or not a calendar date."""
    pattern = r"((?:19|20)\d{2})(?U:\s*)[-/年.](?U:\s*)(\d{1,2})(?U:\s*)[-/月.](?U:\s*)(\d{1,2})"
    source = F.coalesce(col, F.lit(""))
    y, m, d = (F.regexp_extract(source, pattern, i) for i in (1, 2, 3))
    joined = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.coalesce(F.date_format(F.try_to_date(joined, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def formula_safe(col: Column) -> Column:
    """Prefix an apostrophe when a spreadsheet would read the cell as a formula."""
    return F.when(F.regexp_replace(col, r"(?U)^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like(col: Column, keyword: str, wildcards: bool = True) -> Column:
    """Case-insensitive for ASCII only; `%` and `_` in the keyword are wildcards unless switched off."""
    low = F.translate(F.lit(keyword), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if not wildcards or not set(keyword) & set("%_"):
        return F.contains(ascii_lower(col), low)
    return F.like(ascii_lower(col), F.concat(F.lit("%"), low, F.lit("%")), F.lit("\x01"))
