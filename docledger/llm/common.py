"""Helpers shared by the corpus operators: words and their hashes, bounded slices, shared tables."""
from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docledger.session import ensure_checkpoint_dir

#: ASCII bytes outside [0-9A-Za-z] become spaces and A-Z become a-z; bytes of other characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MASK = (1 << 64) - 1
#: An odd multiplier and its inverse modulo 2**64, for rolling hashes of word sequences.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sealed(df: DataFrame) -> DataFrame:
    """The same columns as _c0, _c1, ..., so that no added column clashes with one of them."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def unsealed(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns under their own names, then the added ones; of equal names the added one stays."""
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c not in added]
    return df.select(*own, *added)


#: Null ids become numbers from here on, so real ids have to be smaller.
LAST = 1 << 62


def identity(id_col: Column, text: Column) -> tuple[Column, Column]:
    """The id (a number from `LAST` on for null), and 24 bits that tell rows of one id with different texts apart."""
    h = F.xxhash64(text.cast("string"))
    return F.coalesce(id_col.cast("long"), F.lit(LAST) + h.bitwiseAND(LAST - 1)), h.bitwiseAND((1 << 24) - 1)


def stored(df: DataFrame, rows: int | None = None, rows_per_file: int = 100_000) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back.

    It is computed once, its lineage ends there and it outlives lost executors; the folder is removed when
    the driver ends. Where the caller knows about how many rows come, small tables go to few files.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // rows_per_file)))
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{root}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own bound of an Arrow batch.
SPARK_BATCH = "67108864b"


def small_batches(spark: SparkSession, limit: str = "8MB") -> None:
    """Bound the Arrow batches of this session to `limit` bytes, where it names no bound of its own.

    Batches of long texts otherwise reach 64 MB, and a running task holds several in the JVM and in its worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, SPARK_BATCH):
        spark.conf.set(name, limit)


def worker_cache(owner: str | None) -> dict:
    """A dictionary that outlives the task in its Python worker, so that tasks of one operator (`owner`) reuse what is
    dear to build. A worker that turns to another operator lets it go."""
    held = sys.modules.setdefault("_docledger_worker", types.ModuleType("_docledger_worker"))
    if getattr(held, "owner", None) != owner:
        held.owner, held.cache = owner, {}
    return held.cache if owner else {}


def trim() -> None:
    """Give memory that this worker has freed back to the system, so that idle workers of an executor stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about `limit` bytes of text at most; a longer text is a slice of its own."""
    worker_cache(owner)
    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                yield batch.slice(a, b - a)
            del batch
            pa.default_memory_pool().release_unused()
    trim()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flatten(lists: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All words one after the other, and where each document starts (one entry more than documents)."""
    words = [w for ws in lists for w in ws]
    return words, np.concatenate([[0], np.cumsum([len(ws) for ws in lists])]).astype(np.int64)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    box = np.empty(len(words), object)
    box[:] = words
    return hash_array(box, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that their order and low bits look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base & MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any word range of one slice from prefix sums modulo 2**64.

    The hash of a range depends on its words alone, not on where it stands. `base` must be odd.
    """

    def __init__(self, hashes: np.ndarray, base: int = BASE):
        n = len(hashes)
        self.up = powers(n + 1, base)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(n, pow(base, -1, 1 << 64))[:n], out=self.prefix[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the `size` words from each position that has as many."""
        n = len(self.prefix) - size
        return mixed((self.prefix[size:] - self.prefix[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.up[start] + (end - start).astype(np.uint64))


def within(offsets: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` words from each position lie in one document, for each position of `Rolling.windows`."""
    n = max(int(offsets[-1]) - size + 1, 0)
    left = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    return left >= size


def signed(x: np.ndarray) -> pa.Array:
    """uint64 as Spark's long."""
    return pa.array(x.view(np.int64))
