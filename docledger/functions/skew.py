"""Ordered per-key operations that survive a key holding a large share of all rows.

A plain window puts a whole key into one task. Here the caller names a `piece`: a column that
rises with the ordering (e.g. `floor(version / 100000)`). Windows run per (key, piece); the few
per-piece totals are then carried across pieces and joined back on (key, piece), so a hot key is
spread over as many tasks as it has pieces. Keys and pieces must not be NULL.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docledger.session import ensure_checkpoint_dir

PIECE = "_piece"


def pinned(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write an intermediate that several branches read as a table in the shared checkpoint folder.

    Branches that each read one value of the column `by` read that part of the table only.

    It is computed once, cuts the lineage, survives lost executors, and is read back column by column. The folder is
    removed when the driver ends. Without a shared folder (on a cluster, when spark.checkpoint.dir is unset) it raises.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{root}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed once, however often and wherever they are read later: the entry of an exploded array of one."""
    own = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, own).select(*kept, *[F.col(f"_held.{n}").alias(n) for n in columns])


def piece_of(col: str, width: int = 100_000) -> Column:
    return F.floor(F.col(col) / F.lit(width))


def _spread(df: DataFrame, keys: list[str], piece: Column, local: dict[str, Column],
            totals: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    pieces = df.withColumn(PIECE, piece)
    per_piece = pieces.groupBy(*keys, PIECE).agg(*[c.alias(n) for n, c in totals.items()])
    for name, c in carry.items():
        per_piece = per_piece.withColumn(name, c)
    before = per_piece.select(*keys, PIECE, *carry)
    for name, c in local.items():
        pieces = pieces.withColumn(name, c)
    return pieces.join(before, [*keys, PIECE])


def _earlier(keys):
    return W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: list[str], order: list[Column], piece: Column, out: str = "n") -> DataFrame:
    """1-based row number per key."""
    local_w = W.partitionBy(*keys, PIECE).orderBy(*order)
    joined = _spread(df, keys, piece, {"_local": F.row_number().over(local_w)},
                     {"_size": F.count(F.lit(1))},
                     {"_before": F.coalesce(F.sum("_size").over(_earlier(keys)), F.lit(0))})
    return joined.withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before", PIECE)


def running_total(df: DataFrame, keys: list[str], order: list[Column], piece: Column, value: Column,
                  out: str) -> DataFrame:
    """Sum of `value` over all rows of the key up to and including this one."""
    local_w = W.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = _spread(df.withColumn("_v", value), keys, piece, {"_local": F.sum("_v").over(local_w)},
                     {"_size": F.sum("_v")},
                     {"_before": F.coalesce(F.sum("_size").over(_earlier(keys)), F.lit(0))})
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_v", PIECE)


def previous(df: DataFrame, keys: list[str], order_col: str, piece: Column, value: Column, out: str) -> DataFrame:
    """Value of the preceding row of the key in `order_col` order (NULL on the first)."""
    local_w = W.partitionBy(*keys, PIECE).orderBy(order_col)
    joined = _spread(df.withColumn("_v", value), keys, piece,
                     {"_local": F.lag("_v").over(local_w), "_rank": F.row_number().over(local_w)},
                     {"_last": F.max_by(F.struct("_v"), F.col(order_col))},
                     {"_before": F.lag("_last").over(W.partitionBy(*keys).orderBy(PIECE))})
    return joined.withColumn(out, F.when(F.col("_rank") == 1, F.col("_before._v")).otherwise(F.col("_local"))) \
        .drop("_local", "_before", "_v", "_rank", PIECE)


def carried(df: DataFrame, keys: list[str], order_col: str, piece: Column, value: Column, out: str) -> DataFrame:
    """Last non-NULL value at or before this row."""
    local_w = W.partitionBy(*keys, PIECE).orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    seen = F.when(F.col("_v").isNotNull(), F.col(order_col))
    joined = _spread(df.withColumn("_v", value), keys, piece,
                     {"_local": F.last("_v", ignorenulls=True).over(local_w)},
                     {"_last": F.max_by(F.col("_v"), seen)},
                     {"_before": F.last("_last", ignorenulls=True).over(_earlier(keys))})
    return joined.withColumn(out, F.coalesce("_local", "_before")).drop("_local", "_before", "_v", PIECE)


def upcoming(df: DataFrame, keys: list[str], order_col: str, piece: Column, value: Column, out: str) -> DataFrame:
    """First non-NULL value strictly after this row."""
    local_w = W.partitionBy(*keys, PIECE).orderBy(order_col).rowsBetween(1, W.unboundedFollowing)
    later = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(1, W.unboundedFollowing)
    seen = F.when(F.col("_v").isNotNull(), F.col(order_col))
    joined = _spread(df.withColumn("_v", value), keys, piece,
                     {"_local": F.first("_v", ignorenulls=True).over(local_w)},
                     {"_first": F.min_by(F.col("_v"), seen)},
                     {"_after": F.first("_first", ignorenulls=True).over(later)})
    return joined.withColumn(out, F.coalesce("_local", "_after")).drop("_local", "_after", "_v", PIECE)


def newest(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First k rows per key. `row_number <= k` plans to WindowGroupLimit: each map task keeps at most
    k rows of a key before the shuffle, so a hot key costs k rows per task."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k)
    return ranked.withColumnRenamed("_rn", rank) if rank else ranked.drop("_rn")


def listed(df: DataFrame, keys: list[str], order: list[Column], piece: Column, fields: list[str], out: str,
           size: int = 1000) -> DataFrame:
    """Child rows as arrays of at most `size` structs: one row per (key, part), parts counted from 0.

    Nothing is dropped; a key with more than `size` children simply has more parts.
    """
    parts = numbered(df, keys, order, piece, "_n").withColumn("part", F.floor((F.col("_n") - 1) / size))
    packed = parts.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("_n", *fields))).alias("_l"))
    return packed.withColumn(out, F.transform("_l", lambda s: F.struct(*[s[f].alias(f) for f in fields]))).drop("_l")


def joined(df: DataFrame, keys: list[str], order: list[Column], piece: Column, text: str, sep: str, out: str,
           size: int | None = None) -> DataFrame:
    """Texts of a key joined in ascending order: first within each piece, then piece by piece.

    With `size`, rows are numbered first and parts hold at most that many; use it where the pieces
    do not bound the amount of text by themselves.
    """
    if size is not None:
        df, piece, order = numbered(df, keys, order, piece, "_n"), F.floor(F.col("_n") / size), [F.col("_n")]
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(text).alias("t"))
    rows = df.select(*keys, piece.alias(PIECE), item.alias("_i"))
    parts = rows.groupBy(*keys, PIECE).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_i")), lambda s: s["t"]), sep).alias("t"))
    packed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(PIECE, "t"))).alias("_l"))
    return packed.select(*keys, F.array_join(F.transform("_l", lambda p: p["t"]), sep).alias(out))
