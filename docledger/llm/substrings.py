"""Substring deduplication: winnowed anchors as seeds, extended both ways to maximal repeats.

Words are runs of non-space characters. A repeat is a run of at least `WINDOW` words that also stands in a document
with a smaller id; its words are removed, the smallest id keeps them.

Seeds. Every run of `ANCHOR` words is hashed; in each window of `WINDOW` words the smallest of these hashes is the
window's anchor. Equal windows have their anchor at the same place, so documents that share a window meet at it.

Extension. Neighbouring windows with one anchor form a segment: the anchor extended to the left and right as far as it
stays the smallest. An anchor that stands in one document only ends there. Where all segments of an anchor are equal,
the whole segment is repeated in all documents but the smallest. Where they differ, equal segments are settled the
same way, and one segment of each kind (the one of the smallest id) is taken apart into its windows, which are compared
by two 64-bit hashes; so a repeat ends at the exact word. Adjacent and overlapping repeats merge into maximal ones.

No group is ever expanded into pairs: a group passes on its smallest id only, by aggregates with a partial on the map
side, and hot keys of the joins are left to adaptive splitting.

Defined results: null and empty texts have no words; rows with one id never count as repeats of each other, equal or
not; null ids come after all others, in an order by their text; an empty table stays empty. Ids are whole numbers
under 2**62.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docledger.llm.common import BASE, Rolling, flatten, hash_words, identity, sealed, signed, slices, stored, text_bytes, unsealed, within

WINDOW = 50
ANCHOR = 20
BROADCAST_BYTES = 32 << 20
SECOND = 0xD6E8FEB86659FD93


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of `span` hashes from each position, the leftmost of equals."""
    at, width = np.arange(len(hashes)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        width += step
    return at


def _segments(words: list[bytes], offsets: np.ndarray, window: int, anchor: int):
    """anchor hash, segment hash, document, first word and number of windows of each segment."""
    rolling = Rolling(hash_words(words))
    grams = rolling.windows(anchor)
    good = np.flatnonzero(within(offsets, window))
    if not len(good):
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    at = _least(grams, window - anchor + 1)[good]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(good) != 1)]))
    start, count = good[first], np.diff(np.append(first, len(good)))
    doc = np.searchsorted(offsets, start, "right") - 1
    place = (at[first] - start).astype(np.uint64)
    segment = rolling.ranges(start, start + count + window - 1) ^ (place * np.uint64(BASE))
    return grams[at[first]], segment, doc, start - offsets[doc], count


def _place(start: np.ndarray, count: np.ndarray, tag: np.ndarray) -> pa.Array:
    """First word, number of windows and tag of a segment in one long."""
    return pa.array(start.astype(np.int64) << 32 | count.astype(np.int64) << 24 | tag)


def _seed(window: int, anchor: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words, offsets = flatten([t.split() for t in text_bytes(batch.column("text"))])
            a, s, doc, start, count = _segments(words, offsets, window, anchor)
            yield pa.RecordBatch.from_arrays([signed(a), signed(s), batch.column("id").take(pa.array(doc)), _place(start, count, batch.column("tag").to_numpy()[doc])],
                                             ["anchor", "segment", "id", "place"])
    return run


def _own(places: list[int] | None, tag: int) -> np.ndarray:
    """(first word, number of windows) of the places with this tag."""
    p = np.array(places or [], np.int64)
    p = p[p & 0xFFFFFF == tag]
    return np.column_stack([p >> 32, p >> 24 & 0xFF])


def _windows(window: int):
    """The windows of the listed places of each document, with two hashes."""
    def run(batches):
        for batch in slices(batches, "text"):
            tags = batch.column("tag").to_pylist()
            own = [_own(p, t) for p, t in zip(batch.column("places").to_pylist(), tags)]
            use = [i for i, p in enumerate(own) if len(p)]
            if not use:
                continue
            words, offsets = flatten([t.split() for t in text_bytes(batch.column("text").take(pa.array(use)))])
            h = hash_words(words)
            one, two = Rolling(h).windows(window), Rolling(h, SECOND).windows(window)
            start = [np.unique(np.concatenate([np.arange(a, a + n) for a, n in own[i].tolist()])) for i in use]
            doc, start = np.repeat(np.arange(len(use)), [len(x) for x in start]), np.concatenate(start)
            at, row = offsets[doc] + start, np.array(use)[doc]
            yield pa.RecordBatch.from_arrays([signed(one[at]), signed(two[at]), batch.column("id").take(pa.array(row)), _place(start, np.ones_like(start), np.array(tags)[row])],
                                             ["one", "two", "id", "place"])
    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per id the places of its repeated windows: first word << 32 | number of windows << 24 | tag of the text."""
    if not 0 <= window - anchor < 255:
        raise ValueError("an anchor has at most 254 words less than a window")
    who, tag = identity(F.col(id_col), F.col(text_col))
    rows = docs.select(who.alias("id"), tag.alias("tag"), F.col(text_col).cast("string").alias("text"))
    seeds = rows.mapInArrow(_seed(window, anchor), "anchor long, segment long, id long, place long")
    ends = F.min("id").alias("low"), F.max("id").alias("high")
    anchors = seeds.groupBy("anchor").agg(*ends, (F.min("segment") != F.max("segment")).alias("mixed")).where("low < high")
    # from here on only the segments of anchors in several documents; each table is written once and read by several branches
    seen = stored(seeds.join(anchors, "anchor").drop("high"))
    plain = seen.where("not mixed and id > low").select("id", "place")
    several = seen.where("mixed").select("anchor", "segment", "id", "place")
    kinds = several.groupBy("anchor", "segment").agg(F.min("id").alias("low"))
    settled = stored(several.join(kinds, ["anchor", "segment"]).select("id", "place", "low"))
    equal = settled.where("id > low").select("id", "place")
    open_ = _beside(_packed(settled.where("id = low").select("id", "place")), broadcast_bytes)
    windows = stored(rows.join(open_, "id").mapInArrow(_windows(window), "one long, two long, id long, place long"))
    first = windows.groupBy("one", "two").agg(*ends).where("low < high").select("one", "two", "low")
    partial = windows.join(first, ["one", "two"]).where("id > low").select("id", "place")
    return _beside(_packed(plain.unionByName(equal).unionByName(partial)), broadcast_bytes)


def _beside(packed: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The places written once; broadcast to the texts where all of them are small, else the texts are shuffled by id."""
    packed = stored(packed)
    size = packed.agg(F.sum(F.size("places") * 8 + 64)).first()[0] or 0
    return F.broadcast(packed) if size <= broadcast_bytes else packed


def _packed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.collect_set("place").alias("places"))


def _cover(n: int, own: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(own[:, 0], n), 1)
    np.add.at(edge, np.minimum(own[:, 0] + own[:, 1] + window - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _keep(window: int, text: str):
    def run(batches):
        for batch in slices(batches, text):
            kept, spans, n, gone = [], [], [], []
            for t, places, tag in zip(text_bytes(batch.column(text)), batch.column("places").to_pylist(), batch.column("tag").to_pylist()):
                words = t.split()
                cover = _cover(len(words), _own(places, tag), window)
                edges = np.flatnonzero(np.diff(cover.view(np.int8), prepend=0, append=0))
                left, at = [], 0
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    left += words[at:a]
                    at = b
                kept.append(b" ".join(left + words[at:] if len(edges) else words).decode())
                spans.append(edges.astype(np.int32))
                n.append(len(words))
                gone.append(int(cover.sum()))
            own = [c for c in batch.schema.names if c not in ("places", "tag")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.string())],
                                             [*own, "n_words", "n_removed", "removed", "kept"])
    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row with n_words, n_removed, removed (maximal repeats as word positions start, end, ...) and kept: the
    words that are left, joined by one space."""
    found = repeats(docs, id_col, text_col, window, anchor, broadcast_bytes)
    inner = sealed(docs.withColumn(text_col, F.col(text_col).cast("string")))
    key, text = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))
    who, tag = identity(F.col(key), F.col(text))
    joined = inner.withColumns({"id": who, "tag": tag}).join(found, "id", "left").drop("id")
    added = {"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.array().cast("array<int>"), "kept": F.lit("")}
    return unsealed(joined.mapInArrow(_keep(window, text), inner.withColumns(added).schema), docs.columns, *added)
