"""License scans by diagonal voting. DataFrame functions only.

Templates are word sequences with a label. Every run of K words of a document is hashed and joined with the template
positions of that hash (a fixed table, broadcast); each match votes for the diagonal (document position minus template
position). Votes are added up per diagonal, neighbouring diagonals (up to `SLACK` inserted or missing words apart) are
merged, and the spans of merged diagonals are verified: phrases have to stand word by word, longer texts have to keep
a share of `COVER` of their K-grams in order within a span not much longer than the template.

A notice that repeats closely chains its diagonals to a group longer than that. Such a group is cut: a diagonal that
has the share by itself is a span of its own; another one counts with those up to 2 * `SLACK` after it, where no other
such span within 2 * `SLACK` has as large a share (of equal ones the first counts).

Defined results: null and empty texts have no words and no license; repeated rows get the same result each; an empty
table stays empty.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from docledger.llm.common import sealed, unsealed

K = 2
SLACK = 3
COVER = 0.6
SALTS = 16

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Texts by which these licenses are granted, in the words of the public licenses.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("all rights reserved", "proprietary"),
)


def word_list(text: Column) -> Column:
    """Lower-case words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark: SparkSession) -> DataFrame:
    """One row per template position: template number, label, whether it is a base phrase, its K-grams, position, words."""
    rows = []
    for number, (text, label) in enumerate((*PHRASES, *NOTICES)):
        words = text.split()
        rows += [(number, label, number < len(PHRASES), len(words) - K + 1, i, words[i], words[i + 1]) for i in range(len(words) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, at int, w1 string, w2 string") \
        .withColumn("gram", F.xxhash64("w1", "w2"))


def spans(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """Verified spans of each distinct text: key, template, label, base, first, last (end exclusive), score."""
    words = texts.select(key, word_list(F.col(text_col)).alias("words"))
    grams = words.select(key, F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", K, F.greatest(F.size("words"), F.lit(1))).alias("b"))).alias("pos", "g")) \
        .select(key, "pos", F.col("g.a").alias("g1"), F.col("g.b").alias("g2"))
    t = F.broadcast(templates(texts.sparkSession))  # a fixed table of some hundred rows
    hit = (F.xxhash64("g1", "g2") == F.col("gram")) & (F.col("g1") == F.col("w1")) & (F.col("g2") == F.col("w2"))
    diagonals = grams.join(t, hit).groupBy(key, "template", "label", "base", "grams", (F.col("pos") - F.col("at")).alias("diagonal")) \
        .agg(F.collect_set("at").alias("votes"))
    # copies of a text vote for the same positions, hence sets; a set has no more entries than the template
    order = W.partitionBy(key, "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(SLACK), F.lit(True))
    numbered = diagonals.withColumn("group", F.sum(far.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    group = W.partitionBy(key, "template", "group")
    numbered = numbered.withColumn("long", (F.max("diagonal").over(group) - F.min("diagonal").over(group) > 2 * SLACK) & ~F.col("base"))
    groups = numbered.groupBy(key, "template", "label", "base", "grams", "group") \
        .agg(F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"),
             F.min(F.col("diagonal") + F.array_min("votes")).alias("first"), (F.max(F.col("diagonal") + F.array_max("votes")) + K).alias("last"),
             F.first("long").alias("long"))
    score = F.size("votes") / F.col("grams")
    whole = F.when(F.col("base"), F.size("votes") == F.col("grams")) \
        .otherwise((score >= COVER) & (F.col("last") - F.col("first") <= F.col("grams") + K - 1 + SLACK * 2))
    fits = groups.where(whole)
    # cut what is too long: a span of at most 2 * SLACK diagonals is never longer than allowed
    place = group.orderBy("diagonal")
    after = place.rangeBetween(0, 2 * SLACK)
    alone = F.size("votes") / F.col("grams") >= COVER
    spots = F.struct((F.col("diagonal") + F.array_min("votes")).alias("low"), (F.col("diagonal") + F.array_max("votes")).alias("high"))
    cut = numbered.where("long").withColumns({"alone": alone, "spots": spots}) \
        .withColumns({"near": F.array_distinct(F.flatten(F.collect_list("votes").over(after))), "low": F.min("spots.low").over(after), "high": F.max("spots.high").over(after)}) \
        .select(key, "template", "label", "base", "grams", "group", "diagonal", "alone", F.when(F.col("alone"), F.col("votes")).otherwise(F.col("near")).alias("votes"),
                F.when(F.col("alone"), F.col("spots.low")).otherwise(F.col("low")).alias("first"), (F.when(F.col("alone"), F.col("spots.high")).otherwise(F.col("high")) + K).alias("last")) \
        .withColumn("score", score)
    before, behind, around = place.rangeBetween(-2 * SLACK, -1), place.rangeBetween(1, 2 * SLACK), place.rangeBetween(-2 * SLACK, 2 * SLACK)
    none = F.lit(0.0)
    best = F.col("alone") | ((F.col("score") >= COVER) & (F.col("score") > F.coalesce(F.max("score").over(before), none)) & (F.col("score") >= F.coalesce(F.max("score").over(behind), none))
                             & (F.col("score") > F.coalesce(F.max(F.when(F.col("alone"), F.col("score"))).over(around), none)))
    cut = cut.withColumn("best", best).where("best")
    # a long group may still fit as a whole where its outer diagonals have few votes
    cut = cut.join(fits.where("long").select(key, "template", "group"), [key, "template", "group"], "left_anti")
    listed = lambda df, value: df.select(key, "template", "label", "base", F.col("first").cast("long"), F.col("last").cast("long"), value.alias("score"))
    return listed(fits, score).unionByName(listed(cut, F.col("score")))


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with n_words and licenses: an array of (first, last, label, base, score) in order of place."""
    text = f"_c{docs.columns.index(text_col)}"
    inner = sealed(docs).withColumn("key", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    found = spans(inner, "key", text).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last", "label", "base", "score"))).alias("licenses"))
    rows = inner.withColumn("n_words", F.size(word_list(F.col(text))).cast("long"))
    # copies of one text may be many rows: they are dealt out by a salt, the few spans go to each of its values
    salted = found.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in inner.columns if c != text]), F.lit(SALTS)).cast("int"))
    none = F.array().cast("array<struct<first:long,last:long,label:string,base:boolean,score:double>>")
    return unsealed(rows.join(salted, ["key", "salt"], "left").withColumn("licenses", F.coalesce("licenses", none)), docs.columns, "n_words", "licenses")
