"""Piecewise windows against plain windows, with one key holding most rows."""
from pyspark.sql import Window as W, functions as F

from docledger.functions import skew


def _hot(spark):
    ids = spark.range(0, 4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"), (F.col("id") * 7 % 11).alias("v"))
    return ids.withColumn("mark", F.when(F.col("v") == 0, F.col("id")))


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_numbered_and_running_total(spark):
    df, w = _hot(spark), W.partitionBy("k").orderBy("id")
    piece = skew.piece_of("id", 500)
    _same(skew.numbered(df, ["k"], [F.col("id")], piece).select("id", "n"), df.select("id", F.row_number().over(w).cast("long")))
    _same(skew.running_total(df, ["k"], [F.col("id")], piece, F.col("v"), "s").select("id", "s"), df.select("id", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))))


def test_previous_carried_upcoming(spark):
    df, w = _hot(spark), W.partitionBy("k").orderBy("id")
    piece = skew.piece_of("id", 500)
    _same(skew.previous(df, ["k"], "id", piece, F.col("v"), "p").select("id", "p"), df.select("id", F.lag("v").over(w)))
    _same(skew.carried(df, ["k"], "id", piece, F.col("mark"), "c").select("id", "c"), df.select("id", F.last("mark", True).over(w.rowsBetween(W.unboundedPreceding, 0))))
    _same(skew.upcoming(df, ["k"], "id", piece, F.col("mark"), "u").select("id", "u"), df.select("id", F.first("mark", True).over(w.rowsBetween(1, W.unboundedFollowing))))


def test_listed_keeps_every_child_in_parts(spark):
    parts = skew.listed(_hot(spark), ["k"], [F.col("id")], skew.piece_of("id", 500), ["id"], "ids", 100).collect()
    assert max(len(p["ids"]) for p in parts) == 100 and sum(len(p["ids"]) for p in parts) == 4000
    hot = [c["id"] for p in sorted((p for p in parts if p["k"] == "hot"), key=lambda p: p["part"]) for c in p["ids"]]
    assert hot == sorted(hot)


def test_joined_in_order(spark):
    df = _hot(spark).withColumn("t", F.col("id").cast("string"))
    expected = ",".join(str(i) for i in range(4000) if i % 3)
    for size in (None, 64):
        got = skew.joined(df, ["k"], [F.col("id")], skew.piece_of("id", 500), "t", ",", "x", size).where("k = 'hot'").head()["x"]
        assert got == expected


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = skew.newest(_hot(spark), ["k"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
