"""Sharding by extendible hashing.

Each row has a 60-bit hash of its id and text. The directory is indexed by the leading bits of the hash: a bucket that
fits the byte limit is a shard; only buckets over the limit split on one more bit, until every shard fits. Bytes are
summed per prefix in Spark, `STEP` bits in one round and only below buckets that are still too large.

Defined results: a single row over the limit is a shard of its own; repeated rows have equal hashes, so a bucket of
them that is over the limit at 60 bits is cut by row number; a null text has no bytes; a null id is a key like any
other; an empty table has an empty directory.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docledger.functions import skew
from docledger.llm.common import sealed, stored, unsealed

LIMIT = 1 << 20
STEP = 10
BITS = 60
BROADCAST_SHARDS = 500_000


def row_hash(*parts: Column) -> Column:
    """60 bits of the md5 of the parts, as a non-negative long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    return F.expr(f"shiftright(hash, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col("hash"), F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Shards of rows (hash, bytes): depth, prefix, n_rows, n_bytes.

    Only a bucket of repeated rows at depth 60 may still be over the limit.
    """
    full = (F.col("n_bytes") > limit) & (F.col("n_rows") > 1)
    sums = F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")
    ones = rows.select("hash", F.lit(1).cast("long").alias("n_rows"), F.col("bytes").alias("n_bytes"))
    level = stored(ones.groupBy().agg(*sums).where("n_rows > 0").select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "n_rows", "n_bytes"))
    shards, open_, depth = level.where(~full), level.where(full), 0
    while depth < BITS and open_.head(1):
        deep = min(BITS, depth + STEP)
        # each open bucket is over the limit, so there are fewer of them than all bytes / limit
        below = ones.withColumn("prefix", _prefix(depth)).join(open_.select("prefix"), "prefix", "left_semi") if depth else ones
        leaves = below.groupBy(_prefix(deep).alias("leaf")).agg(*sums)
        level = stored(leaves.withColumn("depth", F.explode(F.sequence(F.lit(depth + 1), F.lit(deep))))
                       .groupBy("depth", F.call_function("shiftright", F.col("leaf"), F.lit(deep) - F.col("depth")).alias("prefix")).agg(*sums))
        split = level.where(full).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fits = level.where(~full).withColumn("up", F.expr("shiftright(prefix, 1)"))
        under = fits.where(F.col("depth") == depth + 1).unionByName(fits.where(F.col("depth") > depth + 1).join(split, ["depth", "up"], "left_semi"))
        shards = shards.unionByName(under.drop("up"))
        open_, depth = level.where(full & (F.col("depth") == deep)), deep
    return shards.unionByName(open_)


def sharded(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", broadcast_shards: int = BROADCAST_SHARDS) -> DataFrame:
    """Every row with shard (its bits), depth, shard_rows and shard_bytes."""
    inner = sealed(docs)
    key, text = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = inner.withColumns({"hash": row_hash(key, text), "bytes": F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")})
    shards = stored(directory(rows.select("hash", "bytes"), limit))
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect())  # 61 at most
    side = F.broadcast(shards) if shards.count() <= broadcast_shards else shards
    addresses = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths or [0]])
    placed = rows.withColumn("a", F.explode(addresses)).withColumns({"depth": F.col("a.depth"), "prefix": F.col("a.prefix")}).join(side, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    named = placed.select(*inner.columns, "bytes", bits.alias("shard"), "depth", F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"))
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    whole = named.where(~over).drop("bytes")
    if depths and depths[-1] == BITS and shards.where((F.col("n_bytes") > limit) & (F.col("n_rows") > 1)).head(1):
        whole = whole.unionByName(_cut(named.where(over), limit))
    return unsealed(whole, docs.columns, "shard", "depth", "shard_rows", "shard_bytes")


def _cut(rows: DataFrame, limit: int) -> DataFrame:
    """Repeated rows of one hash, numbered piece by piece and cut into shards that fit."""
    fixed = stored(rows.withColumn("_order", F.monotonically_increasing_id()))
    numbered = skew.numbered(fixed, ["shard"], [F.col("_order")], skew.piece_of("_order", 10_000), "_number")
    each = F.greatest(F.floor(F.lit(limit) / F.greatest(F.ceil(F.col("shard_bytes") / F.col("shard_rows")), F.lit(1))), F.lit(1))
    at = F.floor((F.col("_number") - 1) / each)
    size = F.least(each, F.col("shard_rows") - at * each).cast("long")
    return numbered.withColumns({"shard": F.concat_ws("-", "shard", at.cast("string")), "shard_bytes": (size * F.col("bytes")).cast("long"), "shard_rows": size}) \
        .drop("_order", "_number", "bytes")


def write_shards(rows: DataFrame, path: str) -> None:
    """One file for each shard under path/shard=.../; a shard fits one task as it fits the limit."""
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
