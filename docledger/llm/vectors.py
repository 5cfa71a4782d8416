"""Nearest neighbours by inner product over balanced posting lists.

The index is fitted on a bounded sample (`SAMPLE_VALUES` components, `SAMPLE_ROWS` vectors at most): a tree of balanced
two-means splits cuts it into lists of equal size, whose means are the centroids. Every vector goes to the list of its
nearest centroid; a vector near a boundary is replicated to up to `REPLICAS` lists that lie in different directions. The
centroids are linked to their nearest ones in a graph that every worker holds in memory; a query walks it from a few entry
points and keeps on while it meets centroids within a ratio of the nearest distance. Lists within that ratio are searched.
The ratio is the smallest that finds the `TARGET` share of true neighbours on the sample, so data without clusters cost
more lists instead of recall.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm of all vectors.

Lists are packed into cells of `CELL` vectors, longer lists and long sets of queries are cut into several, so a task holds
one cell of each at a time. Equal vectors are one vector with its `k` + 1 smallest ids, which answers any query, so large
groups of copies are searched once. Scores are sums of products of the original components in double precision, in order.

Defined results: rows with a null id or with a vector that is null, empty, zero or holds null or non-finite components
take no part, nor do vectors of another length than the most frequent one (of equally frequent ones the longest); of rows
that share an id the smallest vector counts; other columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docledger.llm.common import stored

SAMPLE_ROWS = 20_000
SAMPLE_VALUES = 2_000_000
#: Vectors of a list on average, and the least of the sample that found a centroid.
LIST, LEAST = 512, 8
REPLICAS = 3
#: Share of the true neighbours that the searched lists have to hold on the sample, and how many sampled queries measure it.
TARGET, MEASURED = 0.97, 400
#: Links of a centroid in the graph.
LINKS = 24
#: Vectors and queries of one cell.
CELL = 8192


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _balanced(points: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of `lists` parts of equal size, neighbouring parts side by side."""
    if lists == 1 or len(points) < 2:
        return points.mean(0, keepdims=True)
    left = lists // 2
    cut = len(points) * left // lists
    ends = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(6):
        side = np.argsort((points @ (ends[1] - ends[0])), kind="stable")
        ends = np.stack([points[side[:cut]].mean(0), points[side[cut:]].mean(0)])
    return np.concatenate([_balanced(points[side[:cut]], left, rng), _balanced(points[side[cut:]], lists - left, rng)])


@dataclass
class Graph:
    """Centroids with links to near ones."""
    centroids: np.ndarray
    links: np.ndarray
    norm: float
    ratio: float = 1.0

    @classmethod
    def of(cls, centroids: np.ndarray, norm: float) -> "Graph":
        n = len(centroids)
        near = np.argsort(_squared(centroids, centroids), axis=1, kind="stable")[:, 1:LINKS - 1]
        # a ring through all centroids, which stand in the order of the tree, leaves none out of reach
        ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], 1)
        return cls(centroids, np.concatenate([near, ring], 1), norm)

    def raised(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the component that turns inner products into distances; queries as long as the longest vector."""
        size = (vectors * vectors).sum(1)
        if query:
            return np.concatenate([vectors * (self.norm / np.sqrt(size))[:, None], np.zeros((len(vectors), 1))], 1)
        return np.concatenate([vectors, np.sqrt(np.maximum(self.norm ** 2 - size, 0))[:, None]], 1)

    def near(self, points: np.ndarray, ratio: float, least: int = 1) -> np.ndarray:
        """Distances to the centroids that a walk meets (inf elsewhere). The walk goes on from every centroid within
        `ratio` of the nearest one met so far, and from the nearest `least` ones at any rate."""
        n, c = len(points), len(self.centroids)
        found, done, rows = np.full((n, c), np.inf), np.zeros((n, c), bool), np.arange(n)
        entries = np.unique(np.linspace(0, c - 1, min(c, 16)).astype(int))
        found[:, entries] = np.sqrt(_squared(points, self.centroids[entries]))
        while len(rows):
            seen = found[rows]
            bound = np.maximum(seen.min(1) * ratio, np.partition(seen, min(least, c) - 1, axis=1)[:, min(least, c) - 1])
            open_ = np.where(done[rows] | (seen > bound[:, None]), np.inf, seen)
            best = np.argsort(open_, axis=1)[:, :4]
            live = np.isfinite(np.take_along_axis(open_, best, 1))
            rows, best, live = rows[live.any(1)], best[live.any(1)], live[live.any(1)]
            which, column = np.nonzero(live)
            which, node = rows[which], best[which, column]
            done[which, node] = True
            r, to = np.repeat(which, self.links.shape[1]), self.links[node].ravel()
            new = ~np.isfinite(found[r, to])
            r, to = r[new], to[new]
            found[r, to] = np.sqrt(((points[r] - self.centroids[to]) ** 2).sum(1))
        return found

    def homes(self, points: np.ndarray) -> list[np.ndarray]:
        """Lists of each vector: the nearest, and further ones that are nearer to it than to any list chosen before."""
        met = self.near(points, 1.0, 2 * REPLICAS)
        order = np.argsort(met, axis=1, kind="stable")[:, :4 * REPLICAS]
        out = []
        for row, best in zip(met, order):
            chosen = [int(best[0])]
            for c in best[1:].tolist():
                if len(chosen) == REPLICAS or not np.isfinite(row[c]):
                    break
                if all(((self.centroids[c] - self.centroids[o]) ** 2).sum() > row[c] ** 2 for o in chosen):
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    def lists(self, queries: np.ndarray) -> list[np.ndarray]:
        """Lists to search: those within the ratio of the nearest."""
        met = self.near(queries, self.ratio)
        return [np.flatnonzero(row <= row.min() * self.ratio) for row in met]


def fit(sample: np.ndarray, norm: float, lists: int, k: int, target: float = TARGET) -> Graph:
    """Centroids, graph and ratio from a sample; `norm` is the largest norm of all vectors."""
    rng = np.random.default_rng(11)
    graph = Graph(np.zeros((1, 1)), np.zeros((1, 0), int), norm)
    points = graph.raised(sample)
    graph = Graph.of(_balanced(points, lists, rng), norm)
    if lists > 1:
        asked = rng.choice(len(sample), min(MEASURED, len(sample)), replace=False)
        need = []
        for i in range(0, len(asked), 32):  # few rows at a time, the driver is small
            part = asked[i:i + 32]
            scores = sample[part] @ sample.T
            scores[np.arange(len(part)), part] = -np.inf
            true = np.argpartition(-scores, min(k, len(sample) - 1) - 1, axis=1)[:, :min(k, len(sample) - 1)]
            distance = np.sqrt(_squared(graph.raised(sample[part], query=True), graph.centroids))
            ids = np.unique(true)
            homes = dict(zip(ids.tolist(), graph.homes(points[ids])))
            need += [d[homes[j]].min() / max(d.min(), 1e-12) for d, row in zip(distance, true.tolist()) for j in row]
        graph.ratio = max(1.0, float(np.quantile(need, target))) * (1 + 1e-9)
    return graph


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of the rows that take part; one row an id."""
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].alias("v"))
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~broken & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == (sizes.size if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _dealt(rows: DataFrame, chunks: dict[int, int], key: str) -> DataFrame:
    """Column `chunk`: a part of the row's cell, by a hash of `key`."""
    many = F.create_map(*[F.lit(x) for pair in chunks.items() for x in pair]) if chunks else F.create_map().cast("map<int,int>")
    return rows.withColumn("chunk", F.pmod(F.xxhash64(key), F.coalesce(F.element_at(many, F.col("cell")), F.lit(1))).cast("int"))


def _cells(sizes: dict[int, int], lists: int, cell: int) -> tuple[list[int], dict[int, int]]:
    """Cell of each list (neighbouring lists share one as long as they fit), and the parts of cells that need several."""
    cells, parts, now, held = [], {}, 0, 0
    for i in range(lists):
        size = sizes.get(i, 0)
        if held and held + size > cell:
            now, held = now + 1, 0
        cells.append(now)
        held += size
        if held > cell:
            parts[now] = -(-held // cell)
    return cells, parts


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", list_size: int = LIST, cell: int = CELL,
           target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), id and score of the `k` vectors with the largest inner product found for each row for
    which `is_query` (an expression over the column `id`) holds; ties go to the smaller id."""
    spark = vectors.sparkSession
    base = stored(usable(vectors, id_col, vec_col))
    kept = k + 1  # a query's own id may be among them
    # equal vectors: one row with their smallest ids, named by the smallest
    few = base.withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("_n") <= kept)
    unique = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "v", "ids"))
    facts = unique.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("size"),
                       F.max(F.size("v")).alias("dim")).first()
    schema = "query_id long, rank int, id long, score double"
    if not facts.n:
        return spark.createDataFrame([], schema)
    asked = stored(base.where(is_query).join(unique.select("v", "rep"), "v").select("id", "rep"))
    rows = min(SAMPLE_ROWS, max(SAMPLE_VALUES // facts.dim, 1))
    drawn = unique if facts.n <= rows else unique.where(F.pmod(F.xxhash64(F.col("rep"), F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * rows / facts.n))
    sample = drawn.select("rep", "v").toArrow().sort_by("rep")
    lists = max(1, min(round(facts.n / list_size), sample.num_rows // LEAST))
    graph = fit(_matrix(sample.column("v")), float(np.sqrt(facts["size"])), lists, k, target)
    shared = spark.sparkContext.broadcast((graph.centroids, graph.links, graph.norm, graph.ratio))

    def assign(batches, query=False):
        graph = Graph(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                points = graph.raised(_matrix(part.column("v")), query)
                homes = graph.lists(points) if query else graph.homes(points)
                take = np.repeat(np.arange(part.num_rows), [len(h) for h in homes])
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(take)) for c in part.columns], pa.array(np.concatenate(homes).astype(np.int32))], [*part.schema.names, "list"])

    posted = unique.mapInArrow(assign, unique.withColumn("list", F.lit(0)).schema)
    wanted = unique.select("rep", "v").join(asked.select("rep").distinct(), "rep")
    wanted = wanted.mapInArrow(lambda b: assign(b, True), wanted.withColumn("list", F.lit(0)).schema)
    posted = stored(posted)
    # one number a list, as many as centroids, which the sample bounds
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    cells, parts = _cells(sizes, lists, cell)
    cell_of = F.get(F.array(*[F.lit(c) for c in cells]), F.col("list"))
    posted = _dealt(posted.withColumn("cell", cell_of), parts, "rep")
    wanted = stored(wanted.withColumn("cell", cell_of).groupBy("cell", "rep").agg(F.first("v").alias("v"), F.collect_list("list").alias("lists")))
    loads = {r["cell"]: -(-r["count"] // cell) for r in wanted.groupBy("cell").count().collect()}
    many = {c: n for c, n in loads.items() if n > 1}
    # every part of a cell meets every part of the queries that want it
    wanted = _dealt(wanted, many, "rep").withColumnRenamed("chunk", "asking")
    spread = lambda counts: F.sequence(F.lit(0), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in counts.items() for x in p]), F.col("cell")), F.lit(1)) - 1) if counts else F.array(F.lit(0))
    posted = posted.withColumn("asking", F.explode(spread(many)))
    wanted = wanted.withColumn("chunk", F.explode(spread(parts)))

    def scan(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        data = data.sort_by("list")
        x, asks = _matrix(data.column("v")), _matrix(queries.column("v"))
        wants = queries.column("lists").combine_chunks()
        asking, of = np.repeat(np.arange(len(wants)), wants.value_lengths().to_numpy()), wants.flatten().to_numpy()
        own = data.column("list").to_numpy()
        near = []
        for l in np.unique(of).tolist():
            a, b = np.searchsorted(own, l), np.searchsorted(own, l, "right")
            rows = asking[of == l]
            for i in range(0, len(rows) if b > a else 0, 1024):
                part = rows[i:i + 1024]
                scores = asks[part] @ x[a:b].T
                best = np.argpartition(-scores, kept - 1, axis=1)[:, :kept] if b - a > kept else np.tile(np.arange(b - a), (len(part), 1))
                near.append((np.repeat(part, best.shape[1]), (a + best).ravel(), np.take_along_axis(scores, best, 1).ravel()))
        if not near:
            return scan(queries.slice(0, 0), data)
        q, row, rough = (np.concatenate(c) for c in zip(*near))
        reps = data.column("rep").to_numpy()
        # replicas of a vector in lists of one cell count once
        frame = pd.DataFrame({"q": q, "rep": reps[row], "row": row, "score": -rough}).sort_values(["q", "score", "rep"]).drop_duplicates(["q", "rep"]).groupby("q").head(kept)
        q, row = frame.q.to_numpy(), frame.row.to_numpy()
        score = np.add.accumulate(asks[q] * x[row], axis=1)[:, -1]
        return pa.table({"q": queries.column("rep").to_numpy()[q], "rep": reps[row], "score": score, "ids": data.column("ids").combine_chunks().take(pa.array(row))})

    found = wanted.groupBy("cell", "chunk", "asking").cogroup(posted.groupBy("cell", "chunk", "asking")).applyInArrow(scan, "q long, rep long, score double, ids array<long>")
    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    once = found.groupBy("q", "rep").agg(F.max(F.struct("score", "ids")).alias("s")).select("q", F.col("s.score").alias("score"), F.explode("s.ids").alias("id"))
    top = once.withColumn("n", F.row_number().over(best)).where(F.col("n") <= kept)
    nearest = stored(top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("near")))
    answers = asked.join(nearest, asked.rep == nearest.q).select(asked.id.alias("query_id"), "near")
    answers = answers.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("id"), F.col("col.score").alias("score"))
