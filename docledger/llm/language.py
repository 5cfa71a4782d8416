"""Language identification by multilingual mixture inference.

A model holds, for each language, smoothed probabilities of hashed byte trigrams (lower case, everything but letters
as one kind of gap). A document is a mixture: expectation-maximisation estimates the share of each language from the
likelihoods of its trigrams, first for all learned languages. Of the nested sets of its largest shares the one with the
best penalised likelihood is taken; single languages are added to it and removed from it as long as that gets better.
The largest share of the final set names the document. Sets are passed over only where the likelihood, being concave
in the shares, leaves them no room to be better.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text when no labelled row
was learned from. Rows with a null label are not learned from. Repeated rows count as often as they occur.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docledger.llm.common import sealed, slices, unsealed

BUCKETS = 1 << 13
ROUNDS = 12
#: Penalty of one more language, in units of half the logarithm of the document's trigrams (they overlap threefold).
PENALTY = 3.0
#: A model may hold at most so many languages (8 bytes * BUCKETS each, sent to every task).
MAX_LANGUAGES = 500
#: Documents are taken together up to so many (trigram, language) probabilities.
BLOCK = 1 << 21
UNKNOWN = "und"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def _buckets(text: str) -> np.ndarray:
    """Trigram buckets of a text with a gap at either end."""
    raw = b" " + b" ".join(text.encode().translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF) + b[1:-1] * np.uint32(65599) + b[2:]) * np.uint32(2654435761)) >> np.uint32(19)


def _learn(batches):
    """Trigram counts of each language over the partition: one row per (language, bucket)."""
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if text and any(map(str.isalpha, text)):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(_buckets(text), minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their log-probabilities (language, bucket), from all rows given."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.mapInArrow(_learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels; these are no languages")
    packed.sort(key=lambda r: r.lang)
    model = np.zeros((len(packed), BUCKETS))
    for k, r in enumerate(packed):
        model[k, r.b] = r.n
    model += 0.5
    return [r.lang for r in packed], np.log(model / model.sum(1, keepdims=True)).astype(np.float32)


def _mixture(p: np.ndarray, n: np.ndarray, first: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over many documents at once: p (trigram, candidate), n counts, first row of each document, start shares."""
    rows = np.diff(np.append(first, len(n)))
    total = np.add.reduceat(n, first)
    for _ in range(ROUNDS):
        weight = p * np.repeat(share, rows, 0)
        weight *= (n / weight.sum(1))[:, None]
        share = np.add.reduceat(weight, first, 0) / total[:, None]
    return share, np.add.reduceat(n * np.log((p * np.repeat(share, rows, 0)).sum(1)), first)


def _infer(texts: list[str | None], langs: list[str], model: np.ndarray) -> list[tuple[str, float, list[tuple[str, float]]]]:
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    which = [i for i, t in enumerate(texts) if t and langs and any(map(str.isalpha, t))]
    if not which:
        return out
    block: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for i in which:
        counts = np.bincount(_buckets(texts[i]), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        if block and (size + len(at)) * len(langs) > BLOCK:
            _name(block, langs, model, out)
            block, size = [], 0
        block.append((i, at, counts[at]))
        size += len(at)
    _name(block, langs, model, out)
    return out


def _name(block: list[tuple[int, np.ndarray, np.ndarray]], langs: list[str], model: np.ndarray, out: list) -> None:
    """Fill in the results of the documents of a block: position, buckets and their counts."""
    shares = _select(np.concatenate([n for _, _, n in block]).astype(np.float32), np.array([len(a) for _, a, _ in block]), model[:, np.concatenate([a for _, a, _ in block])].T)
    for (i, _, _), share in zip(block, shares):
        pairs = sorted(((langs[c], float(share[c])) for c in np.flatnonzero(share > 0)), key=lambda x: (-x[1], x[0]))
        out[i] = (pairs[0][0], min(1.0, pairs[0][1]), pairs)


def _select(n: np.ndarray, sizes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Shares (document, language) of the chosen sets: n counts, sizes trigrams of each document, logs (trigram, language)."""
    docs, k = len(sizes), logs.shape[1]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    top = logs.max(1, keepdims=True)
    p = np.exp(logs - top) + np.float32(1e-30)
    base = np.add.reduceat(n * top[:, 0], first)
    total = np.add.reduceat(n, first)
    cost = PENALTY / 2 * np.log(total + 1)

    def rows_of(which):
        starts = np.concatenate([[0], np.cumsum(sizes[which])[:-1]])
        return np.repeat(first[which] - starts, sizes[which]) + np.arange(sizes[which].sum()), starts

    def fit(which, sets):
        """Shares and penalised likelihood of one set (a row of flags) for each of the documents `which`."""
        m = sets.sum(1)
        cols = np.argsort(~sets, 1, kind="stable")[:, :m.max()]
        used = np.take_along_axis(sets, cols, 1)
        rows, starts = rows_of(which)
        some = p[rows[:, None], np.repeat(cols, sizes[which], 0)]
        s, value = _mixture(some, n[rows], starts, (used / m[:, None]).astype(np.float32))
        share = np.zeros(sets.shape, np.float32)
        np.put_along_axis(share, cols, s, 1)
        return share, value + base[which] - cost[which] * m

    def slope(which, share):
        """Derivative of the likelihood by each share, less its mean: no shares over some languages are better than
        `share` by more than the largest of theirs."""
        rows, starts = rows_of(which)
        q = p[rows]
        weight = n[rows] / (q * np.repeat(share, sizes[which], 0)).sum(1)
        return np.add.reduceat(q * weight[:, None], starts, 0) - total[which][:, None]

    every = np.arange(docs)
    share, value = fit(every, np.ones((docs, k), bool))
    best, chosen = value, share
    most = np.minimum(base, value + cost * k + slope(every, share).max(1))
    rank = np.argsort(np.argsort(-share, 1, kind="stable"), 1)
    for m in range(1, k):
        which = np.flatnonzero(most - cost * m > best)
        if not len(which):
            break
        s, value = fit(which, rank[which] < m)
        better = value >= best[which]
        best[which[better]], chosen[which[better]] = value[better], s[better]
    sets, active = chosen > 0, every
    while len(active):
        room = slope(active, chosen[active])
        inside = np.where(sets[active], room, -np.inf).max(1)
        add = ~sets[active] & (np.maximum(room, inside[:, None]) > cost[active][:, None])
        drop = sets[active] & (sets[active].sum(1) > 1)[:, None]
        moved = np.zeros(docs, bool)
        now = sets.copy()
        for j in range(k):
            which = active[add[:, j] | drop[:, j]]
            if not len(which):
                continue
            trial = now[which]
            trial[:, j] = ~trial[:, j]
            s, value = fit(which, trial)
            better = value > best[which] + 1e-3
            at = which[better]
            best[at], chosen[at], sets[at], moved[at] = value[better], s[better], trial[better], True
        active = np.flatnonzero(moved)
    return chosen


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Every row with lang_pred, score (share of that language) and mixture (language and share, largest first)."""
    text = f"_c{docs.columns.index(text_col)}"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, logs = shared.value
        for batch in slices(batches, text, 1 << 20):
            rows = _infer(batch.column(text).to_pylist(), langs, logs)
            mixture = pa.array([[{"lang": a, "share": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), mixture],
                                             [*batch.schema.names, "lang_pred", "score", "mixture"])

    inner = sealed(docs.withColumn(text_col, F.col(text_col).cast("string")))
    schema = inner.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "mixture": F.array().cast("array<struct<lang:string,share:double>>")}).schema
    return unsealed(inner.mapInArrow(run, schema), docs.columns, "lang_pred", "score", "mixture")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
