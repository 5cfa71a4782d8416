"""Secret scans with a linear-chain conditional random field over whitespace tokens.

Fixed patterns give the base spans. The field tags each token as begin, inside or outside of a secret from its shape,
the shapes and keywords of its neighbours and the density of digits in the document; Viterbi decodes the best
sequence. It is trained here by maximum likelihood on tokens that the base patterns mark in a bounded sample
(windows of `SAMPLE_DOCS` documents in expectation); half of them hide keywords and half whole shapes, so that each clue
has to carry weight by itself. Spans of the field are added with the kind `crf`; where they overlap base spans, what is
left of them is added if it has `LEAST["assign"]` characters.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; with nothing to learn from
(no base span in the sample) the field adds nothing. Positions count code points, ends are exclusive.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docledger.llm.common import sealed, slices, stored

#: The base patterns, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 8, "access": 16, "hex": 32}

SAMPLE_DOCS = 600
#: Characters that a window shows on both sides of a base span, and characters that the windows of a document have at most.
WINDOW, SAMPLE_CHARS = 1_000, 20_000
#: Documents drawn at first for each one wanted; more are drawn as long as too few of them have a keyword or a long hex run.
DRAWN = 8
STEPS = 40
#: Tokens of a training sequence.
SEQUENCE = 200
TAGS = 3  # begin, inside, outside
OUTSIDE = 2
SHAPES = 6 * 32
DENSITIES = 4

_UPPER, _LOWER, _DIGIT, _HEX, _JOIN, _OTHER = 1, 2, 4, 8, 16, 32
_CLASS = np.full(128, _OTHER, np.uint8)
for _c in range(128):
    if chr(_c).isdigit():
        _CLASS[_c] = _DIGIT | _HEX
    elif "a" <= chr(_c) <= "z":
        _CLASS[_c] = _LOWER | (_HEX if chr(_c) <= "f" else 0)
    elif "A" <= chr(_c) <= "Z":
        _CLASS[_c] = _UPPER
    elif chr(_c) in "+/_.=-":
        _CLASS[_c] = _JOIN


def base_spans(text: str, points: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches of one text, in order."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if len(points) >= LEAST["hex"]:
        hexes = ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 102))
        edges = np.flatnonzero(np.diff(hexes.view(np.int8), prepend=0, append=0))
        long = edges[1::2] - edges[::2] >= LEAST["hex"]
        out += [(int(a), 2, int(b)) for a, b in zip(edges[::2][long], edges[1::2][long])]
    return sorted(out)


class Tokens:
    """Tokens of several texts one after the other: where they stand and what they look like."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # one space between texts
        self.points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        gap = (self.points == 32) | ((self.points >= 9) & (self.points <= 13))
        edges = np.flatnonzero(np.diff((~gap).view(np.int8), prepend=0, append=0))
        self.start, self.end = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        small = np.where(self.points < 128, self.points, 0).astype(np.int64)
        kind = np.where(self.points < 128, _CLASS[small], _LOWER).astype(np.uint8)
        self.core = kind & (_UPPER | _LOWER | _DIGIT | _JOIN)
        self.core[self.points >= 128] = 0
        n = len(self.start)
        if n:
            bits = np.zeros(n, np.int64)
            cut = np.ravel(np.column_stack([self.start, self.end]))[:-1] if self.end[-1] >= len(kind) else np.ravel(np.column_stack([self.start, self.end]))
            for bit in (_UPPER, _LOWER, _DIGIT, _JOIN):
                bits |= np.where(np.bitwise_or.reduceat(kind & bit, cut)[::2] > 0, bit, 0)
            letters = np.add.reduceat(((kind & (_UPPER | _LOWER | _DIGIT)) > 0).astype(np.int64), cut)[::2]
            hexes = np.add.reduceat(((kind & _HEX) > 0).astype(np.int64), cut)[::2]
            digits = np.add.reduceat(((kind & _DIGIT) > 0).astype(np.int64), cut)[::2]
            allhex = (hexes == letters) & (digits > 0)
            width = np.searchsorted([4, 8, 16, 20, 32], self.end - self.start, "right")
            self.shape = width * 32 + (bits & 7) + np.where(bits & _JOIN, 8, 0) + np.where(allhex, 16, 0)
            per = np.bincount(self.doc, digits, len(texts)) / np.maximum(sizes, 1)
            self.density = np.searchsorted([0.001, 0.01, 0.05], per, "right")[self.doc]
        else:
            self.shape = self.density = np.zeros(0, np.int64)
        self.keyword = np.zeros(n, np.int64)
        for d, text in enumerate(texts):
            for m in KEYWORD.finditer(text):
                at = int(np.searchsorted(self.start, self.begin[d] + m.start(), "right")) - 1
                self.keyword[at] = 1

    def features(self, training: bool = False) -> np.ndarray:
        """Feature numbers of each token, one column for each template. In training, half of the documents hide their
        keywords and half their whole shapes (in all four combinations)."""
        n, keyword, whole, allhex = len(self.shape), self.keyword, self.shape, self.shape >> 4 & 1
        if training:
            keyword = np.where(self.doc % 2, keyword, 0)
            whole, allhex = (np.where(self.doc // 2 % 2, x, hidden) for x, hidden in ((whole, SHAPES), (allhex, 0)))
        before = np.concatenate([[SHAPES], self.shape[:-1]]) if n else self.shape
        after = np.concatenate([self.shape[1:], [SHAPES]]) if n else self.shape
        known = np.concatenate([[0], keyword[:-1]]) if n else keyword
        edge = self.first[(self.first < n)]
        before[edge], known = SHAPES, np.where(np.isin(np.arange(n), edge), 0, known)
        last = self.first[1:] - 1
        after[last[(last >= 0) & (np.diff(self.first) > 0)]] = SHAPES
        known2 = np.concatenate([[0, 0], keyword[:-2]])[:n]
        known2[edge] = 0
        second = edge + 1
        known2[second[second < n]] = 0
        # the parts of a shape by themselves too, so that a combination never seen still has weight
        parts = [(whole, SHAPES + 1), (self.shape >> 5, 8), (self.shape & 7, 8), (allhex, 2), (before, SHAPES + 1), (after, SHAPES + 1), (keyword * 2 + known, 4), (known2, 2), (self.density, DENSITIES)]
        shift, out = 0, []
        for values, size in parts:
            out.append(values + shift)
            shift += size
        return np.column_stack(out) if n else np.zeros((0, len(parts)), np.int64)


FEATURES = 3 * (SHAPES + 1) + 8 + 8 + 2 + 4 + 2 + DENSITIES


def _steps(first: np.ndarray):
    """Rows of the t-th token of every document that has one, documents by falling length."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], first[:-1][order]
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    return starts, live


def viterbi(emission: np.ndarray, change: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best tag of every token; documents go side by side, one token position at a time."""
    starts, live = _steps(first)
    tags, back = np.full(len(emission), OUTSIDE, np.int8), np.zeros((len(emission), TAGS), np.int8)
    if not len(live):
        return tags
    best = np.zeros((len(starts), TAGS))
    for t, n in enumerate(live):
        rows = starts[:n] + t
        if t == 0:
            best[:n] = emission[rows] + change[OUTSIDE]
        else:
            paths = best[:n, :, None] + change[None]
            back[rows] = paths.argmax(1)
            best[:n] = paths.max(1) + emission[rows]
    now = best.argmax(1).astype(np.int8)
    for t in range(len(live) - 1, -1, -1):
        rows = starts[:live[t]] + t
        tags[rows] = now[:live[t]]
        now[:live[t]] = back[rows, now[:live[t]]]
    return tags


def _soft(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(features: np.ndarray, tags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood weights (feature, tag) and (tag, tag) by Adam on the exact gradient."""
    starts, live = _steps(first)
    weights, change = np.zeros((FEATURES, TAGS)), np.zeros((TAGS, TAGS))
    change[OUTSIDE, 1] = -8.0  # inside never follows outside
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(change), np.zeros_like(change)]
    eye, n_tokens = np.eye(TAGS), max(len(tags), 1)
    for step in range(1, STEPS + 1):
        emission = weights[features].sum(1)
        forward, backward = np.zeros_like(emission), np.zeros_like(emission)
        for t, n in enumerate(live):
            rows = starts[:n] + t
            forward[rows] = emission[rows] + (change[OUTSIDE] if t == 0 else _soft(forward[rows - 1][:, :, None] + change[None], 1))
        pair = np.zeros_like(change)
        for t in range(len(live) - 1, 0, -1):
            rows = starts[:live[t]] + t
            ahead = emission[rows] + backward[rows]
            backward[rows - 1] = _soft(change[None] + ahead[:, None, :], 2)
            joint = forward[rows - 1][:, :, None] + change[None] + ahead[:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            np.subtract.at(pair, (tags[rows - 1], tags[rows]), 1)
        marginal = forward + backward
        marginal = np.exp(marginal - _soft(marginal, 1)[:, None]) - eye[tags]
        gradient = np.zeros_like(weights)
        for column in range(features.shape[1]):
            for tag in range(TAGS):
                gradient[:, tag] += np.bincount(features[:, column], marginal[:, tag], FEATURES)
        for x, g, m, v in ((weights, gradient / n_tokens + 1e-6 * weights, *state[:2]), (change, pair / n_tokens, *state[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return weights, change


def cut_sequences(first: np.ndarray, tags: np.ndarray, length: int = SEQUENCE) -> np.ndarray:
    """Starts of sequences of about `length` tokens, never cut within a secret; a step of `fit` goes token by token through the longest."""
    starts = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        starts.append(a)
        while starts[-1] + 2 * length < b:
            cut = starts[-1] + length
            while cut < b and tags[cut] == 1:
                cut += 1
            if cut == b:
                break
            starts.append(cut)
    return np.array([*starts, int(first[-1])])


def _core(tokens: Tokens, a: int, b: int) -> tuple[int, int]:
    inner = np.flatnonzero(tokens.core[a:b])
    return (a + int(inner[0]), a + int(inner[-1]) + 1) if len(inner) else (a, a)


def windows(text: str) -> str:
    """The text if it is short, else its stretches around base spans (or, without any, some stretch of it), taken from anywhere in it."""
    if len(text) <= SAMPLE_CHARS:
        return text
    spans = base_spans(text, np.frombuffer(text.encode("utf-32-le"), np.uint32))
    if not spans:
        at = zlib.crc32(text.encode()) % (len(text) - SAMPLE_CHARS + 1)
        return text[at:at + SAMPLE_CHARS]
    turn = zlib.crc32(text.encode()) % len(spans)
    taken, size = [], 0
    for start, _, end in spans[turn:] + spans[:turn]:
        if size and size + end - start + 2 * WINDOW > SAMPLE_CHARS:
            break
        taken.append((max(start - WINDOW, 0), min(end + WINDOW, len(text))))
        size += taken[-1][1] - taken[-1][0]
    merged: list[list[int]] = []
    for start, end in sorted(taken):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return "\n".join([text[start:end] for start, end in merged])


def _sample(docs: DataFrame, text_col: str, sample_docs: int) -> list[str]:
    """Windows of `sample_docs` different documents in expectation, half of them with a keyword or a long hex run."""
    scale = 1 << 40
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(scale)))
    marked = F.col("text").rlike(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}|(?i:password|passwd|secret|token|api_?key)")
    total, share = docs.count(), DRAWN * sample_docs
    while True:
        limit = scale if share >= total else scale * share // total
        # the pattern is tried on the drawn texts only
        drawn = stored(rows.where(F.col("draw") < limit).withColumn("marked", marked))
        counts = {r.marked: r["count"] for r in drawn.groupBy("marked").count().collect()}
        if limit == scale or counts.get(True, 0) >= sample_docs // 2 <= counts.get(False, 0):
            break
        share *= 8
    bound = {m: int(limit * min(1.0, sample_docs / 2 / n)) for m, n in counts.items()}
    chosen = drawn.where(F.when(F.col("marked"), F.col("draw") < bound.get(True, 0)).otherwise(F.col("draw") < bound.get(False, 0)))

    def cut(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([windows(t) for t in batch.column("text").to_pylist()], pa.string())], ["text"])

    return sorted({r.text for r in chosen.select("text").mapInArrow(cut, "text string").collect()})


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights from windows of `sample_docs` documents in expectation, half of them with a keyword or a long hex run."""
    texts = _sample(docs, text_col, sample_docs)
    if not texts:
        return None
    tokens = Tokens(texts)
    tags = np.full(len(tokens.start), OUTSIDE)
    for d, text in enumerate(texts):
        spans = base_spans(text, tokens.points[tokens.begin[d]:tokens.begin[d] + len(text)])
        for start, kind, end in spans:
            if kind == 0:
                found = ASSIGN.match(text, start)
                start = found.start(2)
            a, b = (np.searchsorted(tokens.end, tokens.begin[d] + start, "right"), np.searchsorted(tokens.start, tokens.begin[d] + end, "left"))
            tags[a:b] = 1
            tags[a:a + 1] = 0
    if (tags == OUTSIDE).all():
        return None
    return fit(tokens.features(training=True), tags, cut_sequences(tokens.first, tags))


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of start..end without the spans."""
    left = []
    for s, e in sorted(spans):
        if s < end and start < e:
            if start < s:
                left.append((start, s))
            start = max(start, e)
    return left + ([(start, end)] if start < end else [])


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row (without its text unless `keep_text` is set) with `found`: start, end and kind of each span in order of start, then kind."""
    text = f"_c{docs.columns.index(text_col)}"
    inner = sealed(docs.withColumn(text_col, F.col(text_col).cast("string")))
    others = [c for c in inner.columns if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, text, 2 << 20):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            tokens = Tokens(texts)
            points = tokens.points
            spans = [base_spans(t, points[a:a + len(t)]) for t, a in zip(texts, tokens.begin.tolist())]
            if model is not None and len(tokens.start):
                weights, change = model
                features = tokens.features()
                emission = weights[features[:, 0]]
                for column in range(1, features.shape[1]):
                    emission = emission + weights[features[:, column]]
                tags = viterbi(emission, change, tokens.first)
                inside = np.flatnonzero(tags != OUTSIDE)
                opens = inside[(tags[inside] == 0) | ~np.isin(inside - 1, inside) | (tokens.doc[inside] != tokens.doc[np.maximum(inside - 1, 0)])]
                for a, b in zip(opens.tolist(), np.append(opens[1:], len(tags)).tolist()):
                    last = a
                    while last + 1 < b and tags[last + 1] != OUTSIDE and tokens.doc[last + 1] == tokens.doc[a]:
                        last += 1
                    d = int(tokens.doc[a])
                    base, shift = [(s, e) for s, k, e in spans[d] if k < 3], int(tokens.begin[d])
                    start, end = _core(tokens, int(tokens.start[a]), int(tokens.end[last]))
                    parts = outside(start - shift, end - shift, base) if start < end else []
                    if len(parts) != 1 or parts[0] != (start - shift, end - shift):  # cut by base spans
                        parts = [(s - shift, e - shift) for s, e in (_core(tokens, s + shift, e + shift) for s, e in parts) if e - s >= LEAST["assign"]]
                    spans[d] += [(s, 3, e) for s, e in parts]
            found = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in sorted(x)] for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(found, kind)], [*others, "found"])

    schema = inner.select(*others).withColumn("found", F.array().cast("array<struct<start:long,end:long,kind:string>>")).schema
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if f"_c{i}" in others and c != "found"]
    return inner.mapInArrow(run, schema).select(*own, "found")
