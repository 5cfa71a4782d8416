"""Maximal periodic runs of words, found by uniting suffix classes in order of falling common prefix.

The suffixes of a document are sorted (prefix doubling over whole slices of documents at once) and the common prefix of
neighbours is read off the doubling ranks. Taking these lengths from the longest down, union-find merges the classes of
suffixes that share as many words. Each class keeps its positions in order, and a smaller class goes into a larger one
position by position. Two positions that become neighbours in a class share exactly that many words: where their distance
is at most a third of it, the stretch from the first to the end of the shared words has that distance as its period at
least four times. It is a run if it can't be extended to the left; to the right it ends by itself. Positions in between
would give a smaller period, so each run comes up once, with its smallest period.

A run of `LEAST_EXPONENT` periods and `LEAST_LENGTH` words shares five words with itself, so classes of fewer shared words
are never formed.

Defined results: null and empty texts have no words and no runs; repeated rows are searched one by one; other columns
stay; texts are cut at ASCII white space and compared byte by byte. A document is never cut, its words have to fit in a
task's memory (about 150 bytes a word).
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docledger.llm.common import BASE, mixed, sealed, slices, text_bytes

#: A run has at least so many periods and words.
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Fewest words that the suffixes of a run share: `LEAST_LENGTH` less a period of 1; longer periods share more.
LEAST_SHARED = LEAST_LENGTH - 1
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = "struct<start:long,length:long,period:long>"


class Places:
    """Ordered positions in chunks of bounded size, so that an insertion moves few of them."""
    CHUNK = 1024

    def __init__(self, positions: list[int]):
        self.chunks, self.size = [positions], len(positions)

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk

    def _chunk(self, p: int) -> int:
        if len(self.chunks) == 1:
            return 0
        low, high = 0, len(self.chunks) - 1
        while low < high:
            middle = (low + high + 1) >> 1
            if self.chunks[middle][0] <= p:
                low = middle
            else:
                high = middle - 1
        return low

    def around(self, p: int) -> tuple[int, int]:
        """The neighbours that p has or would have, -1 where there is none."""
        k = self._chunk(p)
        chunk = self.chunks[k]
        i = bisect_left(chunk, p)
        before = chunk[i - 1] if i else -1
        after = chunk[i] if i < len(chunk) else self.chunks[k + 1][0] if k + 1 < len(self.chunks) else -1
        return before, after

    def insert(self, p: int) -> None:
        k = self._chunk(p)
        chunk = self.chunks[k]
        chunk.insert(bisect_left(chunk, p), p)
        self.size += 1
        if len(chunk) > 2 * self.CHUNK:
            self.chunks[k:k + 1] = [chunk[:self.CHUNK], chunk[self.CHUNK:]]


def _pairs(left: Places, right: Places):
    """Positions that become neighbours when the smaller class goes into the larger one; the larger one is returned last."""
    small, large = (left, right) if left.size < right.size else (right, left)
    own = list(small)
    found = []
    for k, p in enumerate(own):
        before, after = large.around(p)
        if before >= 0 and (k == 0 or own[k - 1] < before):
            found.append((before, p))
        if after >= 0 and (k + 1 == len(own) or own[k + 1] > after):
            found.append((p, after))
    for p in own:
        large.insert(p)
    return found, large


def shared_prefixes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes of one document that share `LEAST_SHARED` words: their positions and how many they share.

    `words` are numbers of words of all documents one after the other; `first` tells where each document starts.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, rank = np.unique(doc * (int(words.max()) + 1) + words, return_inverse=True)
    # ranks[k] orders the 2**k words from each position; -1 stands for what lies behind a document's end
    ranks, at = [rank.astype(np.int64)], np.arange(n)
    while True:
        step = 1 << (len(ranks) - 1)
        ahead = at + step
        inside = ahead < n
        inside[inside] = doc[ahead[inside]] == doc[inside]
        nxt = np.full(n, -1, np.int64)
        nxt[inside] = ranks[-1][ahead[inside]]
        key = ranks[-1] * (n + 1) + nxt + 1
        values, order = np.unique(key, return_inverse=True)
        ranks.append(order.astype(np.int64))
        if len(values) == n:
            break
    suffix = np.argsort(ranks[-1], kind="stable")
    a, b = suffix[:-1], suffix[1:]
    same = doc[a] == doc[b]
    a, b = a[same], b[same]
    shared, x, y = np.zeros(len(a), np.int64), a.copy(), b.copy()
    ends = first[1:][doc[a]]
    for k in range(len(ranks) - 2, -1, -1):
        live = (x < ends) & (y < ends)
        equal = np.zeros(len(x), bool)
        equal[live] = ranks[k][x[live]] == ranks[k][y[live]]
        x, y = x + (equal << k), y + (equal << k)
        shared += equal.astype(np.int64) << k
    enough = shared >= LEAST_SHARED
    return a[enough], b[enough], shared[enough]


def candidates(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which documents may hold the same `LEAST_SHARED` words twice; the others have no run. Decided by a hash, which can only add documents."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(words) - LEAST_SHARED + 1
    out = np.zeros(len(first) - 1, bool)
    if n < 2:
        return out
    key = doc[:n].astype(np.uint64)
    for k in range(LEAST_SHARED):
        key = mixed(key * np.uint64(BASE) + words[k:n + k].astype(np.uint64))
    key = key[doc[:n] == doc[LEAST_SHARED - 1:]]
    doc = doc[:n][doc[:n] == doc[LEAST_SHARED - 1:]]
    order = np.argsort(key, kind="stable")
    twice = key[order][1:] == key[order][:-1]
    out[doc[order][1:][twice]] = True
    return out


def find_runs(words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, in order of start, then period."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    chosen = np.flatnonzero(candidates(words, first))
    if not len(chosen):
        return runs
    parts = [words[first[d]:first[d + 1]] for d in chosen.tolist()]
    text = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    a, b, shared = shared_prefixes(text, starts)
    order = np.argsort(-shared, kind="stable")
    owner: dict[int, int] = {}
    classes: dict[int, Places] = {}

    def root(p: int) -> int:
        while (up := owner.setdefault(p, p)) != p:
            owner[p] = owner[up]
            p = up
        return p

    doc = np.repeat(chosen, np.diff(starts))
    begin = np.repeat(starts[:-1], np.diff(starts))
    for x, y, length in zip(a[order].tolist(), b[order].tolist(), shared[order].tolist()):
        rx, ry = root(x), root(y)
        left, right = classes.pop(rx, None) or Places([x]), classes.pop(ry, None) or Places([y])
        found, merged = _pairs(left, right)
        owner[ry] = rx
        classes[rx] = merged
        for i, j in found:
            period = j - i
            whole = period + length
            if whole >= LEAST_LENGTH and whole >= LEAST_EXPONENT * period and (i == begin[i] or text[i - 1] != text[j - 1]):
                runs[doc[i]].append((int(i - begin[i]), whole, period))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Every row with `runs` (start, length, period in words), the `strongest` of them (greatest length / period, then
    smallest start and period; null without runs) and `kept`, the words outside of repeated periods joined by one space.

    `text_col` itself is not returned. `edit` may change the words of a document (given its id) before the search.
    """
    text, own = f"_c{docs.columns.index(text_col)}", f"_c{docs.columns.index(id_col)}"
    names = ["runs", "strongest", "kept"]
    rest = [c for c in docs.columns if c != text_col]
    inner = sealed(docs.withColumn(text_col, F.col(text_col).cast("string")))
    others = [c for c in inner.columns if c != text]

    def run(batches):
        for batch in slices(batches, text, 1 << 20):
            lists = [t.split() for t in text_bytes(batch.column(text))]
            if edit is not None:
                lists = [edit(i, ws) if ws else ws for i, ws in zip(batch.column(own).to_pylist(), lists)]
            first = np.concatenate([[0], np.cumsum([len(ws) for ws in lists])]).astype(np.int64)
            flat = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
            runs = find_runs(flat.indices.to_numpy().astype(np.int64), first)
            kept, best = [], []
            for words, found in zip(lists, runs):
                if found:
                    stays = collapsed(len(words), found)
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                top = None
                for r in found:
                    if top is None or r[1] * top[2] > top[1] * r[2]:
                        top = r
                best.append(top and dict(zip(("start", "length", "period"), top)))
                kept.append(b" ".join(words))
            listed = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(listed, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.binary()).cast(pa.string())],
                                             [*others, *names])

    schema = inner.select(*others).withColumns({"runs": F.array().cast(f"array<{RUN_TYPE}>"), "strongest": F.lit(None).cast(RUN_TYPE), "kept": F.lit("")}).schema
    found = inner.mapInArrow(run, schema)
    own_columns = [F.col(f"_c{docs.columns.index(c)}").alias(c) for c in rest if c not in names]
    return found.select(*own_columns, *names)
