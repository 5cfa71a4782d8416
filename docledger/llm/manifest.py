"""Merkle manifest of a dataset with a proof for every row: an octopus multiproof over aligned leaf partitions.

Each row is a leaf, the hash of its fields. The leaves of a group, in order, form a binary tree; the roots of the groups,
in order, form another one with the root of the manifest. Leaves are numbered by one range-partitioned sort and cut into
partitions of 2**`height` consecutive positions, so that each is a whole subtree. Upwards, a partition hands on the root
of its subtree alone, and these roots are the leaves of the next round. Downwards, the union of the nodes that the proofs
of a partition miss is minimal: the siblings above its subtree, at most one a level (`missing`). A partition fetches them
once, as one row, derives its interior nodes once for all its leaves, and expands their proofs itself. No task ever holds
more than one partition; a group with most of all rows is many partitions.

Defined results: a null field is `-`, an empty one `0:`; null ids and null groups come first; rows of one id stand in
order of their leaves, and repeated rows are leaves of their own; an empty table has no proofs and the root None; columns
that are not named are not read.
"""
from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docledger.llm.common import stored

#: Levels of the subtree of one partition: 4,096 leaves.
HEIGHT = 12
#: Marks of a sibling that stands left or right of the path.
LEFT, RIGHT = "L", "R"


def leaf_hash(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def missing(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) of the nodes that leaves first..last of a tree of n leaves need from outside."""
    out, level = [], 0
    while n > 1:
        if first & 1:
            out.append((level, first - 1))
        if not last & 1 and last + 1 < n:
            out.append((level, last + 1))
        first, last, n, level = first >> 1, last >> 1, (n + 1) >> 1, level + 1
    return out


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Columns pos (0-based place in its group g) and n (size of the group), from one range-partitioned sort."""
    keys = [F.asc_nulls_first(c) for c in ("g", *order)]
    # the id holds the partition in its upper bits and the row's place in the partition in the lower 33
    rows = stored(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    parts = rows.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first"))
    before = W.partitionBy("g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("g", "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(W.partitionBy("g")).alias("n"))
    return rows.join(parts, ["g", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_at", "_part", "_row", "_shift")


def _levels(leaves: list[bytes], n: int, height: int) -> list[list[bytes]]:
    """The nodes of one partition, level by level from its leaves; the group as a whole has n nodes on their level."""
    levels = [leaves]
    for _ in range(min(height, (n - 1).bit_length())):
        below = levels[-1]
        levels.append([sha256(b"".join(below[i:i + 2])).hexdigest().encode() for i in range(0, len(below), 2)])
    return levels


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _hashes(table: pa.Table) -> list[bytes]:
    return table.column("h").cast(pa.binary()).to_pylist()


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """Root of each partition's subtree, placed among the roots of its group."""
    def up(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n = table.column("n")[0].as_py()
        top = _levels(_hashes(table), n, height)[-1]
        return pa.table({"g": table.column("g")[:1], "pos": pa.array([table.column("pos")[0].as_py() >> height], pa.int64()),
                         "n": pa.array([-(-n >> height)], pa.int64()), "h": pa.array(top).cast(pa.string())})
    return nodes.select("g", "pos", "n", "h", F.shiftright("pos", height).alias("block")).groupBy("g", "block").applyInArrow(up, "g string, pos long, n long, h string")


def _climb(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Rounds of nodes from the placed leaves to the round in which every group is one node."""
    rounds, most = [leaves], leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        rounds.append(stored(_roots(rounds[-1], height)))
        most = -(-most >> height)
    return rounds


def _proofs(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The nodes of the first round with `path`: a marked sibling (or "" where there is none) for each level to the root.

    `above` holds the path (column path) above the single node of each group g.
    """
    paths = rounds[-1].join(above, "g")
    for nodes in rounds[-2::-1]:
        def expand(own: pa.Table, fetched: pa.Table) -> pa.Table:
            own = _sorted(own)
            n, first = own.column("n")[0].as_py(), own.column("pos")[0].as_py()
            levels = _levels(_hashes(own), n, height)
            upper = fetched.column("path")[0].as_py()
            at = np.arange(own.num_rows)
            entries = np.zeros((own.num_rows, len(levels) - 1 + len(upper)), "S65")
            for level, row in enumerate(levels[:-1]):
                beside = (at >> level) ^ 1
                there = beside < len(row)
                marked = np.array([(LEFT if i % 2 == 0 else RIGHT).encode() + h for i, h in enumerate(row)], "S65")
                entries[there, level] = marked[beside[there]]
            for level, entry in enumerate(upper, len(levels) - 1):
                entries[:, level] = entry.encode()
            # what came from outside is what the leaves of this partition miss in their group, and the path of the group
            assert sum(1 for level, _ in missing(first, first + own.num_rows - 1, n)) == sum(map(bool, upper[:max((n - 1).bit_length() - height, 0)]))
            starts = pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * entries.shape[1], pa.int32())
            path = pa.ListArray.from_arrays(starts, pa.array(entries.ravel().tolist(), pa.binary()).cast(pa.string()))
            return own.drop_columns(["block"]).append_column("path", path)

        schema = nodes.withColumn("path", F.array().cast("array<string>")).schema
        blocks = nodes.withColumn("block", F.shiftright("pos", height)).select(*nodes.columns, "block")
        wanted = paths.select("g", F.col("pos").alias("block"), "path")
        paths = blocks.groupBy("g", "block").cogroup(wanted.groupBy("g", "block")).applyInArrow(expand, schema)
    return paths


def manifest(docs: DataFrame, fields: list[str], group_col: str, id_col: str, carry: dict[str, Column] | None = None, height: int = HEIGHT) -> tuple[DataFrame, str | None]:
    """Rows (id, leaf, subroot, proof, and the columns of `carry`), one for each row of `docs`, and the root.

    `proof` lists a sibling for each level from the leaf to the root, marked L or R for the side on which it stands, or ""
    where a node has none. `fold` recomputes the root from it.
    """
    carry = carry or {}
    group = docs[group_col].cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("g"), docs[id_col].alias("id"), leaf_hash([docs[c] for c in fields]).alias("h"),
                         *[c.alias(f"carry_{name}") for name, c in carry.items()])
    rounds = _climb(_placed(leaves, "id", "h"), height)
    tops = rounds[-1].select("g", "h")
    upper = _climb(_placed(tops.select(F.lit("").alias("g"), F.col("g").alias("own"), F.col("h")), "own"), height)
    root = upper[-1].select("h").first()
    none = docs.sparkSession.createDataFrame([("", [])], "g string, path array<string>")
    above = stored(_proofs(upper, none, height).select(F.col("own").alias("g"), F.col("h").alias("subroot"), "path"))
    proofs = _proofs(rounds, above.select("g", "path"), height)
    named = proofs.join(above.select("g", "subroot"), "g")
    return named.select("id", F.col("h").alias("leaf"), "subroot", F.col("path").alias("proof"), *[F.col(f"carry_{name}").alias(name) for name in carry]), root and root[0]


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    def step(node, entry):
        sibling = F.substring(entry, 2, 64)
        return F.sha2(F.when(F.substring(entry, 1, 1) == LEFT, F.concat(sibling, node)).when(entry != "", F.concat(node, sibling)).otherwise(node), 256)
    return F.aggregate(proof, leaf, step)


def siblings(proof: Column) -> Column:
    """The siblings of a proof one after the other, from the leaf's level upwards."""
    return F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), "")
