"""Benchmark decontamination: a broadcast set of n-gram hashes, token windows, verified hits.

Benchmark texts are normalised to words; each run of `n` words (the whole text where it has fewer) is a window.
Every document window is looked up by its hash and each hit is verified word by word. Benchmarks are handed out
in blocks of a bounded size (`BLOCK_BYTES` of text); a larger benchmark means more scans, each with one block.

Defined results: null and empty texts have no words and no hits; repeated items count once by their id; an item
without id takes part under the id ""; an empty benchmark hits nothing; repeated document rows are judged one by
one; columns other than id and text are kept as they are and may have any name but those that are added.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docledger.llm.common import NORMAL, Rolling, flatten, hash_words, sealed, slices, text_bytes, unsealed, within

WINDOW = 10
BLOCK_BYTES = 32 << 20


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """Benchmark rows in blocks of at most about `block_bytes` of text."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")) \
        .where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    if count == 1:
        return [[(r.item, r.text.encode()) for r in items.collect()]]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    return [[(r.item, r.text.encode()) for r in items.where(part == k).collect()] for k in range(count)]


def _windows(items: list[tuple[str, bytes]], n: int) -> dict[int, dict[tuple, set[str]]]:
    """By window length: the words of each window and the items that have it."""
    out: dict[int, dict[tuple, set[str]]] = {}
    for item, text in items:
        words = text.translate(NORMAL).split()
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            out.setdefault(size, {}).setdefault(tuple(words[i:i + size]), set()).add(item)
    return out


def _scan(block, n: int, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        tables = []
        for size, windows in _windows(block.value, n).items():
            grams = list(windows)
            flat = hash_words([w for g in grams for w in g])
            hashes = Rolling(flat).windows(size)[::size]
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            tables.append((size, hashes[order], [grams[i] for i in order], windows, seen))
        for batch in slices(batches, text_col):
            lists = [t.translate(NORMAL).split() for t in text_bytes(batch.column(text_col))]
            words, offsets = flatten(lists)
            rolling = Rolling(hash_words(words))
            cover = np.zeros(len(words) + 1, np.int64)
            found: list[set[str]] = [set(x) for x in batch.column("items").to_pylist()]
            for size, hashes, grams, windows, seen in tables:
                h = rolling.windows(size)
                at = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] & within(offsets, size))
                lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
                for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                    gram = tuple(words[p:p + size])
                    if any(grams[k] == gram for k in range(a, b)):
                        cover[p] += 1
                        cover[p + size] -= 1
                        found[int(np.searchsorted(offsets, p, "right")) - 1] |= windows[gram]
            for doc, spans in enumerate(batch.column("spans").to_pylist()):
                for s, e in zip(spans[::2], spans[1::2]):
                    cover[offsets[doc] + s] += 1
                    cover[offsets[doc] + e] -= 1
            hit = np.cumsum(cover[:-1]) > 0
            spans, hits = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                spans.append(edges.astype(np.int32))
                hits.append(int(hit[a:b].sum()))
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns |= {"n_words": pa.array(np.diff(offsets), pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                        "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def _found(docs, benchmark, n=WINDOW, text_col="text", item_col="item_id", item_text_col="text", block_bytes=BLOCK_BYTES):
    out = sealed(docs).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
                                    "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    sc, text = docs.sparkSession.sparkContext, f"_c{docs.columns.index(text_col)}"
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        out = out.mapInArrow(_scan(sc.broadcast(block), n, text), out.schema)
    return out, text


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document row with n_words, n_hit, spans (word positions start, end, start, end, ...) and items.

    Options: n (words of a window), text_col, item_col, item_text_col, block_bytes. A column of `docs` with the
    name of an added one gives way to it.
    """
    return unsealed(_found(docs, benchmark, **options)[0], docs.columns, "n_words", "n_hit", "spans", "items")


def _cut(text_col: str):
    def run(batches):
        for batch in slices(batches, text_col):
            texts, kept = batch.column(text_col).to_pylist(), []
            for text, spans in zip(texts, batch.column("spans").to_pylist()):
                if text is None or not spans:
                    kept.append(text)
                    continue
                raw = text.encode()
                mask = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                starts, ends, out, at = edges[::2], edges[1::2], [], 0
                for s, e in zip(spans[::2], spans[1::2]):
                    out.append(raw[at:starts[s]])
                    at = int(ends[e - 1])
                kept.append(b"".join([*out, raw[at:]]).decode())
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array(kept, batch.schema.field(i).type))
    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """Documents without hits (`remove="documents"`), or all documents without the hit words (`remove="spans"`).

    The columns are those of `docs`, whatever their names.
    """
    found, text = _found(docs, benchmark, **options)
    kept = found.where(F.col("n_hit") == 0) if remove == "documents" else found.mapInArrow(_cut(text), found.schema)
    return unsealed(kept, docs.columns)
