"""N-gram Jaccard join in the metric space of shingle sets: pivots, regions, windows, recursion; exact.

The distance of two sets is 1 - Jaccard similarity, a metric; documents within `1 - SIMILARITY` link. Documents with
equal sets form a class and are handled once. A shingle of a document's prefix (its first n - ceil(0.8 n) + 1 shingles
in one global order) is a region; two linked documents share one at least, so all others need no distance at all.

A region picks pivots (one in the first round, four times as many in each further round) and the distance of every member
to them is settled exactly, so pivots leave. After each round all links found so far become component labels, and a pair
is dropped only when both its ends carry one label (or were both replicated from a smaller slice, which settles them).
At home are members that have an end of every other pair: those outside the label that most of the region carries, or
those of the slice itself if they are fewer. The region recurses with pivots among them. By the triangle inequality
another member y can reach a member u at home only if d(u, pivot) - d(y, pivot) <= radius for every pivot, d(u, pivot)
taken no larger and d(y, pivot) no smaller than it is; members in that window stay, the rest leave. So do members whose size, place
and label leave them no partner now that the members at home are fewer. What is left of two
members (at most `PAIR` squared pairs) has nothing to divide and is measured, and so is a region whose members at home would
all be pivots of the round. The recursion ends when no region is left.
In regions of at most `LEAF` squared pairs the bound below is tried first; members that it leaves no partner need no pivot.

The global order puts shingles that are frequent in the corpus last, the most frequent at the end (a statistic over all documents, bounded to
`FREQUENT` shingles); the order decides how much is compared, never what links. Pairs whose shared prefix leaves no
room for the similarity are dropped by that bound before their whole sets are compared.

Links become components by rounds of minimum labels with pointer jumping.

Defined results: texts with fewer words than a shingle are one shingle; null and empty texts have no shingles, link
with nothing and are their own component; repeated rows link; a null id never names a component that has another id.
Sets are compared by 64-bit hashes of their shingles.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from docledger.llm.common import LAST, Rolling, flatten, hash_words, identity, mixed, sealed, slices, stored, text_bytes, unsealed, within

WORDS = 5
#: A link needs SHARED * intersection >= UNION * union, that is a similarity of 0.8.
UNION, SHARED = 4, 5
LEAF = 128
PAIR = 2
#: Members times pivots of a round from which members without a possible partner are looked for first; decides cost only.
MEETINGS = 10_000
FREQUENT = 200_000
FREQUENT_FROM = 20
BROADCAST_SETS = 2_000_000
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (62 bits) of each document in ascending order, and where each document starts."""
    lists, offsets = flatten([t.translate(_UPPER).split() for t in text_bytes(column)])
    rolling = Rolling(hash_words(lists))
    h = rolling.windows(words)
    at = np.flatnonzero(within(offsets, words))
    doc = np.searchsorted(offsets, at, "right") - 1
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < words))
    h = np.concatenate([h[at], rolling.ranges(offsets[short], offsets[short + 1])]) >> np.uint64(2)
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def _class(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hash of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h + np.uint64(1)))])
    return mixed(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _count(words: int, window: int = 1_500_000):
    """Shingles that more than one document has, counted over windows of about `window` shingles of a partition."""
    def out(seen):
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    def run(batches):
        seen, size = [], 0
        for batch in slices(batches, "text"):
            h, first = _sets(batch.column("text"), words)
            _, one = np.unique(_class(h, first), return_index=True)
            once = np.zeros(len(first) - 1, bool)
            once[one] = True
            seen.append(h[np.repeat(once, np.diff(first))])
            size += len(seen[-1])
            if size > window:
                yield out(seen)
                seen, size = [], 0
        if seen:
            yield out(seen)
    return run


def _prefix(words: int, shared):
    """Per document: id, size, class and (once for equal sets of a slice) its prefix in the global order."""
    def run(batches):
        frequent, rank = shared.value
        for batch in slices(batches, "text"):
            h, first = _sets(batch.column("text"), words)
            n, c = np.diff(first), _class(h, first)
            _, one = np.unique(c, return_index=True)
            once = np.zeros(len(n), bool)
            once[one] = True
            doc = np.repeat(np.arange(len(n)), n)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                h = np.where(frequent[at] == h, rank[at] | np.uint64(1 << 62), h)
                h = h[np.lexsort((h, doc))]
            length = np.where(once & (n > 0), n - (UNION * n + SHARED - 1) // SHARED + 1, 0)
            take = np.arange(len(h)) - first[doc] < length[doc]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(h[take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(n), pa.array(c), lists], ["id", "tag", "n", "c", "prefix"])
    return run


def _whole(words: int):
    def run(batches):
        for batch in slices(batches, "text"):
            h, first = _sets(batch.column("text"), words)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_class(h, first)), lists], ["c", "shingles"])
    return run


def _shared(batches):
    """Of rows sorted by (key, c): those of keys with more than one c. A partition's first and last key may go on
    in the next partition, so they are kept."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    first = None

    def out(k, c):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "c"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, c = batch.column("key").to_numpy(), batch.column("c").to_numpy()
        if held:
            k, c = np.concatenate([held[0][0], k]), np.concatenate([held[0][1], c])
        first = k[0] if first is None else first
        new = np.concatenate([[True], (np.diff(k) != 0) | (np.diff(c) != 0)])
        k, c = k[new], c[new]
        last = int(np.searchsorted(k, k[-1]))
        # of the key that is still open, two members are enough to know that it is shared
        tail = (k[last:], c[last:])
        k, c = k[:last], c[:last]
        edge = np.concatenate([[True], np.diff(k) != 0]) if len(k) else np.zeros(0, bool)
        runs = np.diff(np.append(np.flatnonzero(edge), len(k)))
        keep = np.repeat(runs, runs) > 1
        keep |= k == first
        if keep.any():
            yield out(k[keep], c[keep])
        if len(tail[0]) > 10_000:  # a key with many members: shared, hand on all but the last
            yield out(tail[0][:-1], tail[1][:-1])
            tail = (tail[0][-1:], tail[1][-1:])
            first = tail[0][0]
        held = [tail]
    if held:
        yield out(*held[0])


def _settled(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (x, p) that the shared prefix leaves room for, with the least distance it allows (all pairs)."""
    side = lambda end: facts.select(F.col("c").alias(end), *[F.col(v).alias(f"{v}_{end}") for v in ("n", "length", "last", "keys")])
    more = [c for c in pairs.columns if c not in ("x", "p")]
    both = pairs.join(side("x"), "x").join(side("p"), "p")
    upto = F.least("last_x", "last_p")
    common = F.size(F.filter(F.array_intersect("keys_x", "keys_p"), lambda k: k <= upto))
    rest = F.when(F.col("last_x") <= F.col("last_p"), F.col("n_x") - F.col("length_x")).otherwise(F.col("n_p") - F.col("length_p"))
    most = F.least(common + rest, F.col("n_x"), F.col("n_p"))
    total = F.col("n_x") + F.col("n_p")
    return both.select("x", "p", *more, "n_x", "n_p", (most * (UNION + SHARED) >= UNION * total).alias("open"), (1 - most / (total - most)).alias("d"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact distance of open pairs."""
    side = lambda end: sets.select(F.col("c").alias(end), F.col("shingles").alias(f"s_{end}"))
    both = pairs.join(side("x"), "x").join(side("p"), "p")
    inter = F.size(F.array_intersect("s_x", "s_p"))
    return both.select("x", "p", (inter * (UNION + SHARED) >= UNION * (F.col("n_x") + F.col("n_p"))).alias("linked"),
                       (1 - inter / (F.col("n_x") + F.col("n_p") - inter)).alias("d"))


def links(rows: DataFrame, words: int = WORDS, leaf: int = LEAF, broadcast_sets: int = BROADCAST_SETS) -> tuple[DataFrame, DataFrame]:
    """From rows (id, tag, text): documents (id, tag, n, c) with the class of their set, and links (x, p) between classes that
    connect all classes of a component (not all linked pairs)."""
    spark = rows.sparkSession
    counts = rows.select("text").mapInArrow(_count(words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    common = np.array([(r.shingle, r.n) for r in counts.collect()], np.int64).reshape(-1, 2)  # at most FREQUENT
    rank = np.empty(len(common), np.uint64)
    rank[np.lexsort((common[:, 0], common[:, 1]))] = np.arange(len(common), dtype=np.uint64)
    order = np.argsort(common[:, 0])
    frequent = spark.sparkContext.broadcast((common[order, 0].view(np.uint64), rank[order]))
    docs = stored(rows.mapInArrow(_prefix(words, frequent), "id long, tag long, n long, c long, prefix array<long>"))
    keyed = docs.where(F.size("prefix") > 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = keyed.select(F.explode("prefix").alias("key"), "c").repartitionByRange(parts, "key", "c").sortWithinPartitions("key", "c")
    first = stored(spread.mapInArrow(_shared, "key long, c long"))
    met = first.count()
    regions = first.distinct()  # copies from several partitions
    whole = keyed.groupBy("c").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    facts = stored(regions.groupBy("c").agg(F.collect_list("key").alias("keys")).join(whole, "c").select(
        "c", "keys", "n", F.size("prefix").alias("length"), F.element_at("prefix", -1).alias("last"),
        F.transform("keys", lambda k: F.array_position("prefix", k)).alias("places")), met, 200_000)
    # a shingle at place i is the first that two documents share only if n - i + 1 of them can be common: `most` is the
    # largest partner for which that is enough
    most = F.floor((F.col("n") - F.col("k.places") + 1) * (UNION + SHARED) / UNION) - F.col("n")
    about = facts.select("c", "n", (F.size("keys") / F.col("length")).alias("share"), F.explode(F.arrays_zip("keys", "places")).alias("k"))
    state = about.select(F.col("k.keys").alias("key"), "c", "n", "share", most.alias("most"))
    ends = state.groupBy("key").agg(F.min("n").alias("_n"), F.max("most").alias("_most"), F.count(F.lit(1)).alias("_m"))
    state = state.join(ends, "key").where("_n <= most and _most >= n")
    # a large region is cut by size (linked sizes differ by a quarter at most): own in its slice, replicated into the next
    size = F.floor(F.log("n") / F.log(F.lit(1.26)))
    slice_of = lambda d: F.struct(F.xxhash64("key", size + d).alias("key"), F.lit(d == 0).alias("own"))
    slices_of = F.when(F.col("_m") > leaf, F.array(slice_of(0), slice_of(1))).otherwise(F.array(F.struct("key", F.lit(True).alias("own"))))
    state = state.select("c", "n", "share", "most", F.explode(slices_of).alias("at")).select(F.col("at.key").alias("key"), "c", F.col("c").alias("label"), F.col("at.own").alias("own"), "n", "share", "most")
    sized = stored(_homes(state, True), met, 200_000)
    few = F.col("m") * F.col("h") <= leaf * leaf
    # of small regions only members that the bound leaves a partner go on, each pair in one of its regions
    rooms = stored(_settled(_near(sized.where(few)).groupBy("x", "p").agg(F.min("key").alias("key")), facts).where("open").select("key", F.explode(F.array("x", "p")).alias("c")).distinct(), met)
    columns = state.columns
    state = sized.where(few).join(rooms, ["key", "c"], "left_semi").select(*columns).unionByName(sized.where(~few).select(*columns))
    sets, found, radius, pivots = None, None, 1 - UNION / SHARED, 1
    while True:
        sized = stored(_homes(state, found is None), met, 200_000)
        met = sized.count()
        if found is not None and met * pivots > MEETINGS:  # labels and homes have changed since sizes and places were compared
            sized = stored(_homes(_partnered(sized).select(*columns), False), met, 200_000)
            met = sized.count()
        if not met:
            break
        few = (F.col("m") * F.col("h") <= PAIR * PAIR) | (F.col("h") <= pivots)
        near = _near(sized.where(few)).select("x", "p")
        large = sized.where(~few)
        # pivots are the members at home whose prefix is shared most: what copies have in common, not one with edits of its own
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("share"), "c"))
        chosen = stored(large.where("home").select("key", "c", rank.alias("rank")).where(F.col("rank") <= pivots).select("key", F.col("c").alias("pivot")), met, 200_000)
        ends = F.greatest("c", "pivot").alias("x"), F.least("c", "pivot").alias("p")
        toward = large.join(chosen, "key").where(F.col("c") != F.col("pivot")).select("key", "c", "pivot", *ends, "own", "n", "share", "most")
        toward = stored(toward, met * pivots, 200_000)  # read for the pairs and for the windows
        bound = stored(_settled(near.unionByName(toward.select("x", "p")).distinct(), facts), met)
        pairs = bound.count()
        if sets is None:
            needed = bound.where("open").select(F.explode(F.array("x", "p")).alias("c")).unionByName(large.select("c")).distinct()
            needed = stored(needed, met, 200_000)
            wanted = needed.count()
            side = F.broadcast(needed) if wanted <= broadcast_sets else needed
            sets = stored(rows.select("text").mapInArrow(_whole(words), "c long, shingles array<long>").join(side, "c", "left_semi")
                          .groupBy("c").agg(F.first("shingles").alias("shingles")), wanted, 3000)
        exact = stored(_measured(bound.where("open"), sets), pairs, 10_000)
        new = exact.where("linked").select("x", "p")
        found = new if found is None else found.unionByName(new)
        if not large.head(1):
            break
        # of pairs without an exact distance d is the least it can be; it can be 1 at most
        known = bound.join(exact.select("x", "p", F.col("d").alias("exact")), ["x", "p"], "left") \
            .select("x", "p", F.coalesce("exact", "d").alias("least"), F.coalesce("exact", F.lit(1.0)).alias("most_d"))
        labels = components(found)
        rest = large.select("key", "c", "own", "n", "share", "most").join(chosen.withColumnRenamed("pivot", "c"), ["key", "c"], "left_anti") \
            .join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
        rest = _homes(rest, False).select("key", "c", "label", "home")
        left = stored(toward.join(known, ["x", "p"]).join(rest, ["key", "c"]), pairs, 200_000)
        away = left.where("home").groupBy("key", "pivot").agg(F.min("least").alias("reach"))
        # those at home stay; others only if, by every pivot, a member at home may be within reach
        state = stored(left.join(away, ["key", "pivot"]).groupBy("key", "c").agg(
            *[F.first(v).alias(v) for v in ("label", "own", "home", "n", "share", "most")],
            F.bool_and(F.col("most_d") >= F.col("reach") - radius - 1e-9).alias("near")).where("home or near").drop("home", "near"), met, 200_000)
        pivots *= 4  # few pivots where one finds a whole group, more where the distances leave nothing to skip
    empty = spark.createDataFrame([], "x long, p long")
    return docs.select("id", "tag", "n", "c"), empty if found is None else found


def _near(regions: DataFrame) -> DataFrame:
    """Pairs (key, x, p) that a region has to settle and that sizes and places in the prefix allow to link."""
    one = regions.select("key", "c", "label", "own", "home", "n", "most")
    other = one.select("key", F.col("c").alias("p"), *[F.col(v).alias(f"{v}_p") for v in ("label", "own", "home", "n", "most")])
    return one.where("home").withColumnRenamed("c", "x").join(other, "key").where("x > p or (x < p and not home_p)") \
        .where("label <> label_p and (own or own_p)") \
        .where((F.col("n") * SHARED >= F.col("n_p") * UNION) & (F.col("n_p") * SHARED >= F.col("n") * UNION)).where("n <= most_p and n_p <= most") \
        .select("key", F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p"))


def _partnered(regions: DataFrame) -> DataFrame:
    """Members of regions that sizes, places in the prefix and labels may leave a pair of `_near`; none with such a pair leaves.

    Members are compared with the ends of size classes of one in a hundred: in a slice of a large region at most 47 of them,
    each split by `home` and `own`; an uncut region has no more of them than members.
    """
    ends = regions.groupBy("key", "home", "own", F.floor(F.log("n") * 100).alias("class")).agg(
        *[f(v).alias(f"{f.__name__}_{v}") for f, v in ((F.min, "n"), (F.max, "n"), (F.max, "most"), (F.min, "label"), (F.max, "label"))])
    ends = ends.groupBy("key").agg(F.collect_list(F.struct(*[c for c in ends.columns if c not in ("key", "class")])).alias("ends"))
    partner = F.expr(f"""exists(ends, e -> (home or e.home) and (own or e.own) and (e.min_label <> label or e.max_label <> label)
        and e.min_n <= most and n <= e.max_most and n * {SHARED} >= e.min_n * {UNION} and e.max_n * {SHARED} >= n * {UNION})""")
    return regions.join(ends, "key").where(partner).drop("ends")


def _homes(state: DataFrame, alone: bool) -> DataFrame:
    """Members of regions that still have pairs to settle, with members (m) and members at home (h) of the region, and
    whether each is at home. A pair is to be settled if its labels differ and one end at least is `own`; one end at least
    of each such pair is at home. `alone`: every label has one member."""
    of = [F.count(F.lit(1)).alias("k"), F.count_if("own").alias("o")]
    if alone:
        sizes = state.groupBy("key").agg(*of, F.max("label").alias("main")).select("key", F.col("k").alias("m"), "o", F.lit(1).alias("top"), "main")
    else:
        sizes = state.groupBy("key", "label").agg(*of).groupBy("key").agg(
            F.sum("k").alias("m"), F.sum("o").alias("o"), F.max("k").alias("top"), F.max_by("label", F.struct("k", "label")).alias("main"))
    sizes = sizes.where("top < m and o > 0").withColumn("h", F.least("o", F.expr("m - top")))
    return state.join(sizes, "key").withColumn("home", F.when(F.col("o") == F.col("h"), F.col("own")).otherwise(F.col("label") != F.col("main"))).drop("o", "top", "main")


def components(edges: DataFrame) -> DataFrame:
    """(c, label) of every node of the edges (x, p): the smallest node that it is connected with."""
    both = stored(edges.select(F.col("x").alias("a"), F.col("p").alias("b")).unionByName(edges.select(F.col("p").alias("a"), F.col("x").alias("b"))).distinct(), 2 * edges.count())
    size = both.count()
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("c"), F.least("a", "b").alias("label")), size)
    while True:
        heard = both.join(labels.select(F.col("c").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("c")).agg(F.min("near").alias("near"))
        lower = labels.join(heard, "c").select("c", "label", F.least("label", "near").alias("low"))
        jump = lower.join(labels.select(F.col("c").alias("low"), F.col("label").alias("far")), "low")
        step = stored(jump.select("c", "label", F.least("low", "far").alias("low")), size)
        moved = step.where("low < label").head(1)
        labels = step.select("c", F.col("low").alias("label"))
        if not moved:
            return labels


def _members(docs: DataFrame, id_col: str, text_col: str, words: int, leaf: int) -> DataFrame:
    """id and tag of each row (see `identity`), n and lowest: the smallest id of its component."""
    who, tag = identity(F.col(id_col), F.col(text_col))
    members, found = links(docs.select(who.alias("id"), tag.alias("tag"), F.col(text_col).cast("string").alias("text")), words, leaf)
    placed = members.where("n > 0").join(components(found), "c", "left").withColumn("label", F.coalesce("label", "c"))
    lowest = placed.groupBy("label").agg(F.min("id").alias("lowest"))
    linked = placed.join(lowest, "label").select("id", "tag", "n", "lowest")
    return linked.unionByName(members.where("n = 0").select("id", "tag", "n", F.col("id").alias("lowest")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, leaf: int = LEAF) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    real = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return _members(docs, id_col, text_col, words, leaf).select(real("id").alias("id"), F.col("n").alias("n_shingles"), real("lowest").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, leaf: int = LEAF, broadcast_rows: int = BROADCAST_SETS) -> DataFrame:
    """The rows of the smallest id of each component, repeated rows once; all columns as they are."""
    members = _members(docs.select(id_col, text_col), id_col, text_col, words, leaf)
    gone = stored(members.where("id <> lowest").select("id", "tag").distinct())
    twice = stored(members.where("id = lowest").groupBy("id", "tag").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("id", "tag"))
    inner = sealed(docs)
    who, tag = identity(*[F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col)])
    rows = inner.withColumns({"id": who, "tag": tag})
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    kept = rows.join(small(gone), ["id", "tag"], "left_anti")
    if twice.head(1):
        again = small(twice)
        kept = kept.join(again, ["id", "tag"], "left_anti").unionByName(kept.join(again, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"]))
    return unsealed(kept, docs.columns)
