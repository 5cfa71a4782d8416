"""Exact quantities as column expressions (QTY)."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import text as X

# ---- fixed values: units (dimension, base unit, numerator, denominator of the factor) ----
UNITS = {
    "平方米": ("area", "平方米", 1, 1), "平米": ("area", "平方米", 1, 1), "万平方米": ("area", "平方米", 10000, 1), "公顷": ("area", "平方米", 10000, 1),
    "平方千米": ("area", "平方米", 1000000, 1), "亩": ("area", "平方米", 2000, 3), "hm2": ("area", "平方米", 10000, 1), "hm²": ("area", "平方米", 10000, 1),
    "m2": ("area", "平方米", 1, 1), "m²": ("area", "平方米", 1, 1),
    "米": ("length", "米", 1, 1), "千米": ("length", "米", 1000, 1), "公里": ("length", "米", 1000, 1), "m": ("length", "米", 1, 1), "km": ("length", "米", 1000, 1),
    "厘米": ("length", "米", 1, 100), "毫米": ("length", "米", 1, 1000),
    "m3": ("volume", "立方米", 1, 1), "m³": ("volume", "立方米", 1, 1), "立方米": ("volume", "立方米", 1, 1), "万立方米": ("volume", "立方米", 10000, 1),
    "万元": ("money", "万元", 1, 1), "亿元": ("money", "万元", 10000, 1), "元": ("money", "万元", 1, 10000),
    "个月": ("duration", "个月", 1, 1), "月": ("duration", "个月", 1, 1), "年": ("duration", "个月", 12, 1),
    "千米/小时": ("speed", "千米/小时", 1, 1), "公里/小时": ("speed", "千米/小时", 1, 1),
    "千瓦": ("power", "千瓦", 1, 1), "兆瓦": ("power", "千瓦", 1000, 1), "万千瓦": ("power", "千瓦", 10000, 1),
    "千瓦时": ("energy", "千瓦时", 1, 1), "兆瓦时": ("energy", "千瓦时", 1000, 1),
    "吨": ("mass", "吨", 1, 1), "万吨": ("mass", "吨", 10000, 1), "t": ("mass", "吨", 1, 1), "T": ("mass", "吨", 1, 1),
    "吨/年": ("capacity", "吨/年", 1, 1), "万吨/年": ("capacity", "吨/年", 10000, 1), "t/d": ("capacity", "吨/日", 1, 1), "MPa": ("pressure", "MPa", 1, 1),
}
COUNTED = ("个", "处", "盏", "层", "栋", "车道", "座", "套", "台", "株", "条", "口", "井", "段", "根", "孔")
UNITS.update({u: ("count:" + u, u, 1, 1) for u in COUNTED})
BOUNDS = "不超过|不少于|不低于|不高于|以上|以下"

NUM = r"(?:\d{1,3}(?:[,，]\d{3})+|\d+)(?:\.\d+)?"
UNIT = "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))
BEFORE = "约|不超过|不少于|不低于|不高于"
AFTER = "以上|以下|左右"
VALUE = rf"(?:{BEFORE})?{NUM}(?:(?:{UNIT})?[-—~～至]{NUM})?(?:{UNIT})(?:{AFTER})?"
# not inside a number and not after a minus sign
_WHOLE = rf"(?<![\d.\-])({BEFORE})?({NUM})(?:({UNIT})?[-—~～至]({NUM}))?({UNIT})({AFTER})?"


_GROUPS = ("before", "low", "low_unit", "high", "unit", "after")


def _bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times: the lambda variable of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit(name: Column) -> Column:
    """STRUCT<dimension, base, num, den> of a unit, NULL for an unknown one."""
    # one SQL text: as single columns its 500 parts would be built one by one wherever a quantity is parsed
    rows = (f"'{u}', named_struct('dimension', '{dim}', 'base', '{base}', 'num', CAST({num} AS DECIMAL(8,0)), 'den', CAST({den} AS DECIMAL(5,0)))" for u, (dim, base, num, den) in UNITS.items())
    table = F.expr(f"map({', '.join(rows)})")
    return F.try_element_at(table, name)


def _parsed(raw: Column, body) -> Column:
    """Apply `body` to the parts of the first quantity of the text: one search, then its groups."""
    ascii_digits = F.translate(X.without_space(F.coalesce(raw, F.lit(""))), "０１２３４５６７８９", "0123456789")
    found = F.regexp_extract(F.replace(ascii_digits, F.lit("Mpa"), F.lit("MPa")), _WHOLE, 0)

    def groups(m):
        # all groups from one replacement; an absent group leaves an empty part
        parts = F.split(F.regexp_replace(m, _WHOLE, "\x01".join(f"${i}" for i in range(1, 7))), "\x01", -1)

        def named(p):
            g = {n: p[i] for i, n in enumerate(_GROUPS)}
            units = F.struct(_unit(g["unit"]).alias("u"), _unit(F.when(g["low_unit"] != "", g["low_unit"]).otherwise(g["unit"])).alias("l"))
            return _bind(units, lambda t: body(g, t))
        return _bind(parts, named)
    return _bind(found, lambda m: F.when(m != "", groups(m)))


def _decimal(digits: Column) -> Column:
    return F.regexp_replace(digits, "[,，]", "").try_cast("decimal(24,8)")


def _in_base(value: Column, unit: Column) -> Column:
    return (value * unit["num"] / unit["den"]).cast("decimal(38,12)")


def _quantity(g: dict, t: Column) -> Column:
    q = F.struct(_in_base(_decimal(g["low"]), t["l"]).alias("number"), F.when(g["high"] != "", _in_base(_decimal(g["high"]), t["u"])).alias("upper"),
                 t["u"]["base"].alias("unit"), t["u"]["dimension"].alias("dimension"), F.concat(g["before"], g["after"]).alias("qualifier"), g["unit"].alias("raw_unit"),
                 ((g["low_unit"] == "亩") | (g["unit"] == "亩")).alias("approximate_conversion"))
    same = t["l"]["dimension"] == t["u"]["dimension"]
    return _bind(q, lambda v: F.when(same & v["number"].isNotNull() & ((g["high"] == "") | (v["upper"] >= v["number"])), v))


def quantity(raw: Column) -> Column:
    """STRUCT of the first quantity in the text, in exact base units; NULL if there is none, the two
    units of a range disagree, or the range runs backwards (QTY-1)."""
    return _parsed(raw, _quantity)


def quantity_key(q: Column) -> Column:
    """Comparable identity of a quantity (QTY-2)."""
    return _bind(q, lambda v: F.when(v.isNotNull(), F.struct(v["number"].alias("number"), v["upper"].alias("upper"), v["unit"].alias("unit"), v["qualifier"].alias("qualifier"))))


def _tolerance(g: dict, t: Column) -> Column:
    digits = F.length(F.regexp_extract(g["low"], r"\.(\d+)$", 1))
    step = F.concat(F.lit("1e-"), digits.cast("string")).try_cast("decimal(24,8)")
    half = _in_base(step, t["u"]) / 2
    return F.when(g["high"] == "", F.when((g["before"] != "") | (g["after"] != ""), half * 2).otherwise(half).cast("decimal(38,12)"))


def round_tolerance(raw: Column) -> Column:
    """Half the last written digit in base units, doubled for qualified values; NULL for ranges (QTY-3)."""
    return _parsed(raw, _tolerance)


def with_quantity(rows: DataFrame, value: str = "value") -> DataFrame:
    """Add q and tolerance of the value, from one parse; rows that carry them already stay as they are."""
    if "q" in rows.columns and "tolerance" in rows.columns:
        return rows
    both = _parsed(F.col(value), lambda g, t: F.struct(_quantity(g, t).alias("q"), _tolerance(g, t).alias("tolerance")))
    out = rows.drop("q", "tolerance").withColumn("_qt", both)
    return out.withColumn("q", F.col("_qt.q")).withColumn("tolerance", F.col("_qt.tolerance")).drop("_qt")


def rounding_aggregates() -> dict[str, Column]:
    """Aggregates a group needs for `rounding_equivalent`; rows carry q and tolerance."""
    q = F.col("q")
    exact = q.isNotNull() & q["upper"].isNull() & ~q["qualifier"].rlike(BOUNDS) & ~F.startswith(q["dimension"], F.lit("count:")) & F.col("tolerance").isNotNull()
    return {"_q_rows": F.count(F.lit(1)), "_q_ok": F.bool_and(F.coalesce(exact, F.lit(False))), "_q_min": F.min(q["number"]), "_q_max": F.max(q["number"]),
            "_q_tol": F.max("tolerance"), "_u_min": F.min(q["unit"]), "_u_max": F.max(q["unit"]), "_d_min": F.min(q["dimension"]), "_d_max": F.max(q["dimension"])}


def rounding_equivalent() -> Column:
    """Do the values of a group differ only by how precisely they were written? (QTY-4)"""
    spread = F.col("_q_max") - F.col("_q_min")
    return F.coalesce((F.col("_q_rows") >= 2) & F.col("_q_ok") & (F.col("_u_min") == F.col("_u_max")) & (F.col("_d_min") == F.col("_d_max"))
                      & (spread > 0) & (spread <= F.col("_q_tol")), F.lit(False))


def plain(number: Column) -> Column:
    """Decimal as text without trailing zeros."""
    s = number.cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def signed(number: Column) -> Column:
    return F.concat(F.when(number >= 0, "+").otherwise(""), plain(number))
