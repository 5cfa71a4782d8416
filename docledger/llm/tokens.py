"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

A text is cut by the split pattern; each distinct piece of a slice becomes token-position rows of a table. A recursive
query joins neighbouring rows with the merge table and contracts, in every piece, the leftmost pair of the smallest
rank, until no piece has a pair. Ordered aggregation gives the ids of a piece and, joined with the vocabulary, its
bytes. Pieces that a worker has met are kept up to a bound.

A round of the recursion touches every row of a piece, so pieces of more than `LONG_PIECE` bytes (unbroken runs of one
kind of character) take the same merges from a heap instead.

Defined results: null and empty texts have no tokens; repeated rows are encoded one by one; other columns are kept.
"""
from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docledger.llm.common import sealed, slices, trim, unsealed, worker_cache

LONG_PIECE = 256
#: Pieces that a worker keeps in each of two generations.
KEPT_PIECES = 600_000
#: Rows that one recursive query makes at most, about half the squared length of each piece.
QUERY_ROWS = 1_000_000
#: Slices after which a worker gives freed memory back.
TRIM_AFTER = 32

ENCODE = """
WITH RECURSIVE step AS (
  SELECT piece, pos, tok, 0 AS round FROM start
  UNION ALL
  (WITH pair AS (SELECT piece, pos, tok, round, lead(tok) OVER w AS nxt, lead(piece) OVER w AS beside FROM step WINDOW w AS (ORDER BY piece, pos)),
   ranked AS (SELECT piece, pos, tok, round, merged FROM pair LEFT JOIN merges ON l = tok AND r = nxt AND beside = piece),
   best AS (SELECT piece, min((merged::BIGINT << 32) | pos) AS least FROM ranked WHERE merged IS NOT NULL GROUP BY piece),
   open AS (SELECT piece, pos, tok, round, least >> 32 AS merged, least & 4294967295 AS spot, lag(pos) OVER (ORDER BY piece, pos) AS before
            FROM ranked JOIN best USING (piece))
   SELECT piece, pos, CASE WHEN pos = spot THEN merged ELSE tok END, round + 1 FROM open WHERE pos <= spot OR before <> spot)
),
ended AS (SELECT piece, max(round) AS round FROM step GROUP BY piece)
SELECT piece, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids, string_agg(token, '' ORDER BY pos) AS token
FROM step JOIN ended USING (piece, round) JOIN vocabulary ON id = tok
GROUP BY piece ORDER BY piece
"""
DECODE = "SELECT doc, string_agg(token, '' ORDER BY pos) AS token FROM given LEFT JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left id, right id, merged id) of every way to put a token together from two tokens."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(rows, np.int64).reshape(-1, 3)


def _merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece: merges in order of (rank, position) from a heap."""
    parts, nxt, prev = [piece[i:i + 1] for i in range(len(piece))], list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    n, heap = len(parts), []

    def offer(i):
        if 0 <= i < n and nxt[i] < n and (both := parts[i] + parts[nxt[i]]) in ranks:
            heapq.heappush(heap, (ranks[both], i, both))

    for i in range(n):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] and nxt[i] < n and parts[i] + parts[nxt[i]] == both:
            gone = nxt[i]
            parts[i], parts[gone], nxt[i] = both, b"", nxt[gone]
            if nxt[gone] < n:
                prev[nxt[gone]] = i
            offer(i)
            offer(prev[i])
    return [ranks[p] for p in parts if p]


class Coder:
    """Encodes pieces and decodes ids with a private in-memory DuckDB; pieces are kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, digest: str = ""):
        import duckdb
        self.ranks, self.digest, self.kept, self.rows = ranks, digest, KEPT_PIECES, QUERY_ROWS
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": "",
                                                       "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"})
        table = pa.table({"l": merges[:, 0], "r": merges[:, 1], "merged": merges[:, 2]})
        words = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "token": [t.hex() for t in ranks]})
        self.db.register("m", table)
        self.db.register("v", words)
        self.db.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS FROM v")
        self.known = np.fromiter(ranks.values(), np.int64)
        self.token = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.said: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.other: dict[str, bytes] = {}

    def _keep(self, piece: str, ids: str, raw: bytes, decoded: bytes) -> None:
        self.said[piece] = ids
        if decoded != raw:
            self.other[piece] = decoded

    def learn(self, pieces: set[str]) -> None:
        """Ids (decimal, joined by commas) of the pieces that are not known yet, and the bytes they decode to."""
        if len(self.said) > self.kept:  # what is not met again in the next generation is let go
            self.older, self.said = self.said, {}
            if len(self.other) > self.kept:
                self.forget()
        short = []
        for p in pieces:
            if p not in self.said:
                if (known := self.older.get(p)) is not None:
                    self.said[p] = known
                    continue
                raw = p.encode()
                if raw in self.ranks:
                    self._keep(p, str(self.ranks[raw]), raw, self.token[self.ranks[raw]])
                elif len(raw) > LONG_PIECE:
                    ids = _merged(raw, self.ranks)
                    self._keep(p, ",".join(map(str, ids)), raw, self.decode([ids])[0])
                else:
                    short.append((p, raw))
        cost = np.cumsum([len(raw) * (len(raw) + 1) // 2 for _, raw in short]) // self.rows
        edges = np.flatnonzero(np.diff(cost, prepend=-1, append=np.inf)) if short else []
        for a, b in zip(edges[:-1], edges[1:]):
            part = short[a:b]
            sizes = np.array([len(raw) for _, raw in part])
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = pa.table({"piece": np.repeat(np.arange(len(part)), sizes), "pos": np.arange(len(first)) - first,
                              "tok": self.byte[np.frombuffer(b"".join([raw for _, raw in part]), np.uint8)]})
            self.db.register("start", start)
            got = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("start")
            for (p, raw), ids, token in zip(part, got.column("ids").to_pylist(), got.column("token").to_pylist()):
                self._keep(p, ids, raw, bytes.fromhex(token))

    def bytes_of(self, pieces: list[str]) -> bytes:
        """What the ids of the pieces decode to; only pieces whose ids decode to other bytes are kept with them."""
        return b"".join([self.other[p] if p in self.other else p.encode() for p in pieces]) if self.other else "".join(pieces).encode()

    def decode(self, lists: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids; an id that is not in the vocabulary is an error."""
        sizes = np.array([len(x) for x in lists])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
        if not np.isin(flat, self.known).all():
            raise ValueError("ids outside the vocabulary")
        self.db.register("given", pa.table({"doc": np.repeat(np.arange(len(lists)), sizes), "pos": np.arange(len(first)) - first, "id": flat}))
        rows = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("given")
        return [bytes.fromhex(rows.get(i, "")) for i in range(len(lists))]


def _coder(shared) -> Coder:
    digest, ranks, merges = shared.value
    cache = worker_cache(digest)
    if "coder" not in cache:
        trim()  # what the operators before have left in this worker goes back to the system first
        cache["coder"] = Coder(ranks, merges, digest)
    return cache["coder"]


def _shared(df: DataFrame, path: str):
    ranks = load_ranks(path)
    digest = "coder " + hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, ranks, merge_table(ranks)))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = True, kept_pieces: int = KEPT_PIECES,
           keep_text: bool = True, query_rows: int = QUERY_ROWS, slice_bytes: int = 2 << 20) -> DataFrame:
    """Every row with n_tokens, token_ids (where asked for), ids_sha256 and decoded_sha256.

    `path` is the rank file and `pattern` the split pattern of the tokenizer. The hashes are those of the decimal
    ids joined by commas and of the bytes that the ids decode to. A worker keeps up to twice `kept_pieces` pieces. The
    text itself is left out of the result unless `keep_text` is set. `query_rows` and `slice_bytes` bound its memory.
    """
    text, shared = f"_c{docs.columns.index(text_col)}", _shared(docs, path)
    added = {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}
    if with_ids:
        added["token_ids"] = F.array().cast("array<int>")
    names = list(added)
    inner = sealed(docs.withColumn(text_col, F.col(text_col).cast("string")))
    others = [c for c in inner.columns if keep_text or c != text]

    def run(batches):
        import regex
        find, coder = regex.compile(pattern).findall, _coder(shared)
        coder.kept, coder.rows = kept_pieces, query_rows
        for turn, batch in enumerate(slices(batches, text, slice_bytes, coder.digest)):
            if turn % TRIM_AFTER == TRIM_AFTER - 1:
                trim()
            lists = [find(t) if t else [] for t in batch.column(text).to_pylist()]
            coder.learn(set().union(*lists))
            n, ids, said, decoded = [], [], [], []
            for pieces in lists:
                line = ",".join([coder.said[p] for p in pieces])
                n.append(line.count(",") + 1 if line else 0)
                said.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.bytes_of(pieces)).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(line, np.int32, sep=",") if line else np.zeros(0, np.int32))
            columns = [*[batch.column(c) for c in others], pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), [*others, *names])

    found = inner.mapInArrow(run, inner.select(*others).withColumns(added).schema)
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if f"_c{i}" in others and c not in names]
    return found.select(*own, *names)


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Every row with the bytes of its ids (column `out`, binary); null ids give null."""
    column, shared = f"_c{docs.columns.index(ids_col)}", _shared(docs, path)

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(column).to_pylist()
                raw = coder.decode([x or [] for x in lists])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else r for x, r in zip(lists, raw)], pa.binary())], [*part.schema.names, out])

    inner = sealed(docs)
    return unsealed(inner.mapInArrow(run, inner.withColumn(out, F.lit(None).cast("binary")).schema), docs.columns, out)
