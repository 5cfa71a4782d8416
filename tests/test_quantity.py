"""Quantity truth table."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docledger.functions import quantity as Q

CASES = [
    ("1公里", "1000", None, "米", ""), ("1000.0米", "1000", None, "米", ""), ("约1公里", "1000", None, "米", "约"), ("1公里-1500米", "1000", "1500", "米", ""),
    ("1万千瓦", "10000", None, "千瓦", ""), ("1,234.5万元", "1234.5", None, "万元", ""), ("3亩", "2000", None, "平方米", ""), ("2年", "24", None, "个月", ""),
    ("12-15处以上", "12", "15", "处", "以上"), ("0.8Mpa", "0.8", None, "MPa", ""), ("不超过 300 t/d", "300", None, "吨/日", "不超过"), ("22.85hm2", "228500", None, "平方米", "")]


def _q(rows, texts):
    out = rows("i INT, t STRING", list(enumerate(texts))).select("i", Q.quantity(F.col("t")).alias("q")).orderBy("i").collect()
    return [r["q"] for r in out]


def test_values(rows):
    for (text, number, upper, unit, qualifier), q in zip(CASES, _q(rows, [c[0] for c in CASES])):
        assert q is not None, text
        assert (q["number"], q["upper"], q["unit"], q["qualifier"]) == (Decimal(number), upper and Decimal(upper), unit, qualifier), text


def test_nothing_comparable(rows):
    assert _q(rows, ["1平方米-2米", "36米-24米", "无数字", "-5米", "", None]) == [None] * 6


@pytest.mark.parametrize("values,same", [
    (["13.693公顷", "136929.6平方米"], True), (["13.693公顷", "136900平方米"], False), (["不超过10米", "10.2米"], False), (["7处", "8处"], False),
    (["10米", "10米"], False), (["1公里-2公里", "1公里"], False), (["约12公里", "12.4公里"], True)])
def test_rounding(rows, values, same):
    df = Q.with_quantity(rows("value STRING", [(v,) for v in values]))
    got = df.agg(*[c.alias(n) for n, c in Q.rounding_aggregates().items()]).select(Q.rounding_equivalent().alias("r")).head()["r"]
    assert got is same
