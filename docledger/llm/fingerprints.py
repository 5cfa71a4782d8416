"""Document fingerprints by I-Match with randomised lexicons. DataFrame functions only.

Terms are the lower-case words of a document. The lexicon keeps the terms whose document frequency lies in a band
(`LOW` to `HIGH` of all documents). A term stands as a number, the first 60 bits of its sha256; its last six bits draw
one of 64 random sub-lexicons, the first `SUBSETS` of which are used. Per sub-lexicon the sorted distinct terms of a
document are hashed; the hashes together are its fingerprint. A document without any such term has the hash of its text.

The likeness of two fingerprints is the share of equal hashes among the sub-lexicons of which either has a term (two
text hashes: 1 if equal, else 0).

The lexicon has at most (mean distinct terms of a document) / LOW terms; it is broadcast up to `BROADCAST_TERMS`, else joined.

Defined results: a null text counts as empty and has the fingerprint of no terms; equal texts have equal fingerprints;
an empty table stays empty. In `with_neighbour`, rows of equal id are ordered by text and null ids count as smallest.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docledger.llm.common import stored
from docledger.llm.licenses import word_list

LOW, HIGH = 0.005, 0.2
SUBSETS = 32
BROADCAST_TERMS = 1_000_000
#: Rows of a bucket of neighbours, and at most so many buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 2000


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """term and code, of terms in one of the used sub-lexicons."""
    total = docs.count()
    terms = docs.select(F.explode(F.array_distinct(word_list(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # written first: a condition on the hash of a term would move below the counting, to every word
    band = stored(terms.where((F.col("df") >= low * total) & (F.col("df") <= high * total)))
    code = F.conv(F.substring(F.sha2("term", 256), 1, 15), 16, 10).cast("long")
    return band.select("term", code.alias("code")).where(F.col("code").bitwiseAND(63) < SUBSETS)


def _codes(codes: Column) -> Column:
    """Hash of the terms in each sub-lexicon, "" where there are none. `codes` are sorted."""
    def part(k):
        own = F.filter(codes, lambda c: c.bitwiseAND(63) == k)
        return F.when(F.size(own) > 0, F.substring(F.md5(F.array_join(own.cast("array<string>"), " ").cast("binary")), 1, 8)).otherwise("")
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), part)


def fingerprint(codes: Column, whole: Column) -> Column:
    return F.when(F.array_max(codes) == "", whole).otherwise(F.array_join(codes, "."))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts of two fingerprints, from 0 to 1."""
    pairs = F.filter(F.arrays_zip(F.split(a, r"\.").alias("a"), F.split(b, r"\.").alias("b")), lambda x: (x["a"] != "") | (x["b"] != ""))
    same = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    return F.when(a == b, 1.0).otherwise(F.coalesce(same / F.size(pairs), F.lit(0.0)))


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str], terms: DataFrame, carry: dict[str, Column] | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """keys (which identify a row), carried columns and the fingerprint of each text column, under the name fp_<column>.

    A null text column has no fingerprint.
    """
    terms = stored(terms)
    side = F.broadcast(terms) if terms.count() <= broadcast_terms else terms
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.array_distinct(word_list(F.col(c))).alias("words")) for i, c in enumerate(texts)])
    words = rows.select(*keys, F.explode(kinds).alias("k")).select(*keys, F.col("k.kind").alias("kind"), F.explode("k.words").alias("term"))
    codes = words.join(side, "term").groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == i, F.col("code")))).alias(f"c_{c}") for i, c in enumerate(texts)])
    whole = rows.select(*keys, *[c.alias(n) for n, c in (carry or {}).items()], *[F.md5(F.col(c).cast("binary")).alias(f"w_{c}") for c in texts])
    joined = whole.join(codes, keys, "left")
    none = F.array().cast("array<long>")
    coded = joined.select(*keys, *(carry or {}), *[F.col(f"w_{c}") for c in texts], *[_codes(F.coalesce(f"c_{c}", none)).alias(f"c_{c}") for c in texts])
    return coded.select(*keys, *(carry or {}), *[F.when(F.col(f"w_{c}").isNotNull(), fingerprint(F.col(f"c_{c}"), F.col(f"w_{c}"))).alias(f"fp_{c}") for c in texts])


def with_neighbour(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, place, id, text, next: the text of the next row by descending id (after the last: of the first).

    Buckets are ranges of ids between quantiles, so rows are dealt out once; only the last row of each bucket
    (`MOST_BUCKETS` at most) meets the others.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count = min(MOST_BUCKETS, max(1, docs.count() // BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("id", [i / count for i in range(1, count)], 20 * count).alias("c")).first().c if count > 1 else []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))])
    bucket = F.size(F.filter(bounds, lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    own = W.partitionBy("bucket").orderBy(F.col("id").asc_nulls_first(), "text")
    placed = rows.withColumns({"place": F.row_number().over(own), "near": F.lag("text").over(own)})
    last = rows.groupBy("bucket").agg(F.max_by(F.col("text"), F.struct(F.col("id").isNotNull(), "id", "text")).alias("t"))
    chain = W.orderBy("bucket")
    every = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = last.select("bucket", F.coalesce(F.lag("t").over(chain), F.last("t").over(every)).alias("over_edge"))
    return placed.join(edge, "bucket", "left").select("bucket", "place", "id", "text", F.coalesce("near", "over_edge").alias("next"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per row: id, n_chars, the edited text (its last third replaced by the start of the next text) and fingerprints
    of the text, of the edited text and of the next text, with their likeness."""
    rows = with_neighbour(docs, id_col, text_col)
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.select("bucket", "place", "id", "text", F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 3)))"), F.substring(F.col("next"), F.lit(1), third)).alias("edited"),
                       F.when(F.col("place") == 1, F.col("next")).alias("next"))
    facts = {"id": F.col("id"), "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)}
    marks = fingerprints(rows, ["bucket", "place"], ["text", "edited", "next"], lexicon(docs, text_col, low, high), facts)
    order = W.partitionBy("bucket").orderBy("place")
    joined = marks.withColumn("fp_next", F.coalesce(F.lag("fp_text").over(order), "fp_next"))
    return joined.select("id", "n_chars", "edited_sha256", F.col("fp_text").alias("fingerprint"), F.col("fp_edited").alias("edited_fingerprint"),
                         likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"))
