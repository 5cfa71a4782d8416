"""Sources (SRC): ledger tables, registry files, originals, labels and approval documents."""
from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from docledger import schemas
from docledger.functions import skew, text as X


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A ledger table with its fixed schema (SRC-1)."""
    return spark.read.schema(schemas.schema(name)).parquet(f"{root}/{name}")


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source registry; unknown keys are dropped, ids follow the order of the items (SRC-2).

    JSON lines (`.jsonl`, a file or a folder) are read in parallel and may be any number. A YAML or JSON list is one
    configuration file of some tens of items and is parsed on the driver.
    """
    shape = schemas.schema("source_configs")
    if path.rstrip("/").endswith(".jsonl"):
        return _source_lines(spark, path, shape)
    raw = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml
        items = yaml.safe_load(raw)
    else:
        items = json.loads(raw)
    items = items.get("sources", items) if isinstance(items, dict) else items
    known = {f.name for f in shape.fields} - {"id"}
    rows = [{"id": i, **{k: v for k, v in item.items() if k in known}} for i, item in enumerate(items, 1)]
    for row in rows:
        row["enabled"] = int(bool(row.get("enabled", True)))
    return spark.createDataFrame([tuple(r.get(f.name) for f in shape.fields) for r in rows], shape)


def _source_lines(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    """Sources of JSON lines, numbered by file and place in it: a count per partition of a file travels, the lines stay."""
    # enabled comes as true, 1 or "1"; a malformed line fails the read, as a malformed list does
    given = T.StructType([T.StructField(f.name, T.StringType() if f.name == "enabled" else f.dataType) for f in shape.fields if f.name != "id"])
    rows = spark.read.schema(given).option("mode", "FAILFAST").json(path) \
        .select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = skew.pinned(rows)  # places are taken once: the numbers below are read from the same table as the rows
    piece = F.struct("_file", "_block")
    numbered = skew.numbered(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col("_at")], piece, "id")
    enabled = F.coalesce(~F.lower("enabled").isin("false", "0", "", "0.0"), F.lit(True)).cast("int")
    return numbered.select(*[(enabled if f.name == "enabled" else F.col(f.name)).alias(f.name) for f in shape.fields])


def merge_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by name: new values win where given, ids of known names stay, new names get the next ids (SRC-2)."""
    shared = [c for c in existing.columns if c not in ("id", "name")]
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    known = existing.select("id", "name")
    given = new.drop("id").join(known, "name", "left")
    # registry rows are operator configuration, tens of rows, so one window over them is bounded
    from pyspark.sql import Window as W
    fresh = given.where("id IS NULL").withColumn("_n", F.row_number().over(W.orderBy("name"))).crossJoin(top) \
        .withColumn("id", (F.col("_top") + F.col("_n")).cast("long")).drop("_n", "_top")
    given = given.where("id IS NOT NULL").unionByName(fresh).select("name", *[F.col(c).alias(f"_{c}") for c in ["id", *shared] if c in given.columns])
    both = existing.join(given, "name", "full")
    cols = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in both.columns else F.col(c) for c in ["id", *shared]]
    return both.select("name", *cols).select(*existing.columns)


def read_originals(spark: SparkSession, path: str) -> DataFrame:
    """Stored originals with their hash and format; the leading bytes outrank the suffix (SRC-3)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return original_format(files.withColumnRenamed("length", "size")).withColumn("sha256", F.sha2("content", 256))


def original_format(files: DataFrame) -> DataFrame:
    """Add fmt from `content` and `path`."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace("path", r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 5))
    fmt = F.when(head == "255044462D", "pdf").when(suffix != "", suffix) \
        .when(F.substring(head, 1, 4) == "504B", "zip").otherwise("html")
    return files.withColumn("fmt", fmt)


def feed_rows(feeds: DataFrame) -> DataFrame:
    """JSON array feeds to (source_id, pos, url, title), every item with its position (SRC-4).

    `feeds`: source_id, list_url, body. Pages of a feed are a condition on pos. A body that is not a JSON array raises the `broken` flag.
    """
    item = T.ArrayType(T.StructType.fromDDL("URL STRING, TITLE STRING"))
    parsed = feeds.withColumn("_items", F.from_json("body", item)) \
        .withColumn("broken", ~F.coalesce(F.ltrim("body").startswith("[") & F.col("_items").isNotNull(), F.lit(False)))
    rows = parsed.select("source_id", "list_url", "broken", F.posexplode_outer("_items").alias("pos", "_i"))
    return rows.select("source_id", "list_url", "broken", "pos", X.text(F.col("_i.URL")).alias("url"), X.text(F.col("_i.TITLE")).alias("title"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels, one JSON object per line; a malformed line fails the read (SRC-6)."""
    return spark.read.schema(schemas.schema("labels")).option("mode", "FAILFAST").json(path)


FOLDERS = 256
_DOCUMENT = re.compile(r"[0-9a-f]{32}\.json")


def folder_of(name: str) -> str:
    """Of the 256 folders `00` to `ff` of a root the one that holds `<name>.json`."""
    return hashlib.md5(name.encode()).hexdigest()[:2]


def shared_folder(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or address, and the folder in it."""
    if "://" in root or root.startswith("file:"):
        store, base = fs.FileSystem.from_uri(root)
        return store, base.rstrip("/")
    return fs.LocalFileSystem(), root.rstrip("/")


def _opens(root: str) -> bool:
    """Whether tasks can list the folder by themselves: not where it is a pattern, a file, or in a store that only Spark opens."""
    if re.search(r"[*?\[{\\]", root):
        return False
    try:
        store, base = shared_folder(root)
        return store.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def read_approval_docs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON per approval document; only 32-hex file names are documents (SRC-7).

    Documents lie in `path` itself or in the folder that `folder_of` names. Tasks list the folders and read the files, so neither
    names nor files pass through the driver; only names are shuffled. Stores that only Spark opens, and patterns, are read by Spark.
    """
    shape = T.StructType.fromDDL(schemas.APPROVAL_DOC)
    if not _opens(path):
        rows = spark.read.schema(shape).option("multiLine", "true").json(path)
        return rows.where(F.col("_metadata.file_name").rlike(r"^[0-9a-f]{32}\.json$"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    numbers = spark.range(-1, FOLDERS, 1, min(FOLDERS + 1, tasks))  # -1: the folder itself
    # a fixed number: names are few bytes, by which Spark would give all files to a task or two
    files = numbers.mapInArrow(_listed_documents(path), "file string").repartition(tasks, "file")
    text = files.mapInArrow(_whole_files(path), "text string")
    # as Spark's reader of files has it: an array is a row an item, what is not JSON a row of nulls
    many = F.col("text").rlike(r"^[ \t\r\n]*\[")
    rows = F.when(many, F.from_json("text", T.ArrayType(shape))).otherwise(F.array(F.from_json("text", shape)))
    parsed = text.select(rows.alias("rows")).where("rows IS NULL OR size(rows) > 0")
    return parsed.select(F.explode_outer("rows").alias("row")).select("row.*")


def _listed_documents(root: str):
    """File names of documents, below `root`, of the folders of the given numbers."""
    def run(batches):
        store, base = shared_folder(root)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                folder = "" if number < 0 else f"{number:02x}"
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
                names = [f.base_name for f in found if f.type == fs.FileType.File and _DOCUMENT.fullmatch(f.base_name)]
                names = [f"{folder}/{n}" if folder else n for n in names if not folder or folder_of(n[:32]) == folder]
                for i in range(0, len(names), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i:i + 10_000], pa.string())], ["file"])
    return run


def _whole_files(root: str, limit: int = 4 << 20):
    """Text of each file, null where its bytes are no text; files without content are left out."""
    def out(texts):
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    def run(batches):
        store, base = shared_folder(root)
        texts, size = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(f"{base}/{name}") as source:
                    data = source.read()
                if not data.strip(b" \t\r\n"):
                    continue
                try:
                    texts.append(data.decode(json.detect_encoding(data)))
                except UnicodeDecodeError:
                    texts.append(None)
                size += len(data)
                if size > limit:
                    yield out(texts)
                    texts, size = [], 0
        if texts:
            yield out(texts)
    return run


def conform(df: DataFrame, shape: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Additive migration: missing columns appear with their default, types follow the schema (SRC-8)."""
    defaults = defaults or {}
    empty = df.sparkSession.createDataFrame([], shape)
    full = df.unionByName(empty, allowMissingColumns=True)
    return full.select(*[
        (F.coalesce(F.col(f.name), F.lit(defaults[f.name])) if f.name in defaults else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in shape.fields])
