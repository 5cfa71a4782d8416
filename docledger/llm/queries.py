"""The registered query of each operator, with production parameters, and SQL where it can express one."""
from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docledger.llm import decontaminate, fingerprints, jaccard, language, licenses, lines, manifest, periodic, secrets, sharding, substrings, tokens, vectors
from docledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


WORDS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op5_decontamination", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out() & F.col("doc_id").isNotNull()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.array_join("mixture.lang", ",").alias("languages"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokens.encode(docs, path, public_tokenizers.PATTERN, with_ids=False, keep_text=False)


@query("op4_line_dedup", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS nohost, string_split(text, chr(10)) AS lines, row_number() OVER () AS page FROM documents),
t AS (SELECT host, nohost, count(*) AS total FROM d GROUP BY ALL),
l AS (SELECT DISTINCT page, host, nohost, trim(translate(line, chr(9), ' ')) AS line FROM (SELECT page, host, nohost, unnest(lines) AS line FROM d) WHERE trim(translate(line, chr(9), ' ')) <> ''),
many AS (SELECT host, nohost, line FROM l JOIN t USING (host, nohost) GROUP BY host, nohost, line, total HAVING count(*) >= 3 AND count(*) > total * 0.02),
r AS (SELECT page, sum(CASE WHEN many.line IS NULL THEN 0 ELSE length(l.line) END) > 0.5 * sum(length(l.line)) AS repeats FROM l LEFT JOIN many USING (host, nohost, line) GROUP BY page),
own AS (SELECT host, nohost, count(*) FILTER (NOT coalesce(repeats, false)) + max(coalesce(repeats, false)::INT) AS total FROM d LEFT JOIN r USING (page) GROUP BY host, nohost),
bad AS (SELECT host, nohost, line FROM l JOIN many USING (host, nohost, line) JOIN r USING (page) JOIN own USING (host, nohost) GROUP BY host, nohost, line, total
        HAVING count(*) FILTER (NOT repeats) + max(repeats::INT) >= 3 AND count(*) FILTER (NOT repeats) + max(repeats::INT) > total * 0.02),
arrays AS (SELECT host, nohost, list(line) AS gone FROM bad GROUP BY ALL),
k AS (SELECT doc_id, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, trim(translate(x, chr(9), ' ')))) END AS kept
      FROM d LEFT JOIN arrays USING (host, nohost))
SELECT doc_id, CASE WHEN lines IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped
FROM k""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs), keep_text=False)
    listed = lambda kinds: F.array_join(F.transform(F.filter("found", lambda x: x["kind"].isin(*kinds)),
                                                    lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(listed(secrets.KINDS[:3]), 256).alias("base_sha256"), listed(secrets.KINDS).alias("spans"), count("crf").alias("n_crf"))


_TEMPLATES = ", ".join(f"({n}, '{label}', {str(n < len(licenses.PHRASES)).lower()}, '{text}')" for n, (text, label) in enumerate((*licenses.PHRASES, *licenses.NOTICES)))


@query("op2_license_scan", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT template, label, base, string_split(words, ' ') AS w FROM (VALUES {_TEMPLATES}) AS v(template, label, base, words)),
tg AS (SELECT template, label, base, len(w) - 1 AS grams, unnest(range(0, len(w) - 1)) AS spot, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM t),
dg AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM d WHERE len(w) > 1),
votes AS (SELECT DISTINCT doc_id, template, label, base, grams, pos - spot AS diagonal, spot FROM dg JOIN tg USING (w1, w2)),
diagonals AS (SELECT doc_id, template, label, base, grams, diagonal, min(spot) AS low, max(spot) AS high FROM votes GROUP BY ALL),
g AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp
      FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= CASE WHEN base THEN 0 ELSE {licenses.SLACK} END
                   THEN 0 ELSE 1 END AS far FROM diagonals)),
s AS (SELECT doc_id, template, label, base, grams, grp, count(DISTINCT spot) AS n, min(pos) AS first, max(pos) + 2 AS last
      FROM (SELECT g.*, spot, diagonal + spot AS pos FROM g JOIN votes USING (doc_id, template, label, base, grams, diagonal)) GROUP BY ALL),
ok AS (SELECT *, n / grams AS score FROM s WHERE CASE WHEN base THEN n = grams ELSE n / grams >= {licenses.COVER} AND last - first <= grams + 1 + {2 * licenses.SLACK} END),
r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM ok GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licenses", lambda x: x["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
                        names(base).alias("base_labels"), names(F.col("licenses")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["score"])), F.lit(0.0)).alias("score"))


@query("op7_sharding", f"""
WITH h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash FROM documents),
levels AS (SELECT depth, hash >> ({sharding.BITS} - depth) AS prefix, count(*) AS n, sum(bytes) AS total FROM h, range(0, {sharding.BITS + 1}) AS r(depth) GROUP BY ALL),
placed AS (SELECT doc_id, hash, min(depth) AS depth FROM h JOIN levels ON hash >> ({sharding.BITS} - depth) = prefix
           WHERE total <= {sharding.LIMIT} OR n = 1 GROUP BY doc_id, hash)
SELECT doc_id, CASE WHEN p.depth = 0 THEN '' ELSE substr(lpad(bin(prefix), {sharding.BITS}, '0'), ({sharding.BITS} - p.depth + 1)::INT) END AS shard, p.depth::INT AS depth,
       n::BIGINT AS shard_rows, total::BIGINT AS shard_bytes
FROM placed p JOIN levels l ON l.depth = p.depth AND l.prefix = p.hash >> ({sharding.BITS} - p.depth)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _fingerprint_sql() -> str:
    like = """CASE WHEN {0} = {1} THEN 1.0::DOUBLE ELSE coalesce(list_sum(list_transform(range(1, len(string_split({0}, '.')) + 1), lambda k: CASE WHEN string_split({0}, '.')[k] = string_split({1}, '.')[k] AND string_split({0}, '.')[k] <> '' THEN 1 ELSE 0 END))::DOUBLE
      / nullif(greatest(list_sum(list_transform(range(1, greatest(len(string_split({0}, '.')), len(string_split({1}, '.'))) + 1), lambda k: CASE WHEN coalesce(string_split({0}, '.')[k], '') <> '' OR coalesce(string_split({1}, '.')[k], '') <> '' THEN 1 ELSE 0 END)), 1), 0), 0) END"""
    return f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next,
                  coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM documents),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(next, 1, length(text) // 3) AS edited FROM o),
w AS (SELECT doc_id, 0 AS kind, text AS t, list_distinct({WORDS_SQL.format("text")}) AS w FROM e UNION ALL SELECT doc_id, 1, edited, list_distinct({WORDS_SQL.format("edited")}) FROM e),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM w WHERE kind = 0) GROUP BY term),
lex AS (SELECT term, ('0x' || substr(sha256(term), 1, 15))::BIGINT AS code FROM f WHERE df >= {fingerprints.LOW} * (SELECT count(*) FROM documents) AND df <= {fingerprints.HIGH} * (SELECT count(*) FROM documents)),
c AS (SELECT doc_id, kind, code & 63 AS k, substr(md5(string_agg(code::VARCHAR, ' ' ORDER BY code)), 1, 8) AS code FROM (SELECT doc_id, kind, unnest(w) AS term FROM w) JOIN lex USING (term) GROUP BY doc_id, kind, code & 63),
g AS (SELECT w.doc_id, w.kind, CASE WHEN count(code) = 0 THEN md5(any_value(w.t)) ELSE string_agg(coalesce(code, ''), '.' ORDER BY r.k) END AS fp
      FROM w CROSS JOIN range(0, {fingerprints.SUBSETS}) AS r(k) LEFT JOIN c ON c.doc_id = w.doc_id AND c.kind = w.kind AND c.k = r.k GROUP BY w.doc_id, w.kind)
SELECT e.doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       {like.format("a.fp", "b.fp")} AS near_edited, {like.format("a.fp", "n.fp")} AS near_next
FROM e JOIN g a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN g b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN g n ON n.doc_id = e.next_id AND n.kind = 0"""


@query("op6_fingerprints", _fingerprint_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op1_substring_dedup", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT gram, min(doc_id) AS low FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (gram) WHERE doc_id > low),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept FROM words LEFT JOIN hit USING (doc_id, p) WHERE hit.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_jaccard_join", """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x) USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op11_vector_search", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
             AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i]), lambda a, b: a + b) AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL is the exact search. At its size the vectors fill few lists, all of which are searched; tests measure recall on many lists."""
    return vectors.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


#: Unsigned CRC-32 of a decimal number in SQL, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''), lambda c: list_transform(range(0, 8), lambda b: ((ascii(c) >> b) & 1)::BIGINT)))),
      lambda crc, bit: xor(crc >> 1, CASE WHEN (xor(crc, bit) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR))::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


@query("op12_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {CRC_SQL.format('doc_id')} % 7 = 0 THEN 1 ELSE 0 END AS tamper FROM documents),
l AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('n_chars + tamper')} AS altered FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
nodes AS (SELECT lang, 0 AS level, pos AS i, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, place AS i, m AS n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
root AS (SELECT level AS height, h AS root FROM tops WHERE n = 1),
steps AS (SELECT v.lang, v.pos, 0 AS tree, level, xor(v.pos >> level, 1) AS i, (v.pos >> level) & 1 AS odd FROM leaves v JOIN subroots s ON s.lang IS NOT DISTINCT FROM v.lang, range(0, s.height) AS r(level)
  UNION ALL SELECT v.lang, v.pos, 1, level, xor(s.place >> level, 1), (s.place >> level) & 1 FROM leaves v JOIN subroots s ON s.lang IS NOT DISTINCT FROM v.lang, root, range(0, root.height) AS r(level)),
marked AS (SELECT s.lang, s.pos, list((CASE WHEN coalesce(n.h, t.h) IS NULL THEN '' WHEN odd = 1 THEN 'L' ELSE 'R' END) || coalesce(n.h, t.h, '') ORDER BY s.tree, s.level) AS proof
  FROM steps s LEFT JOIN nodes n ON s.tree = 0 AND n.lang IS NOT DISTINCT FROM s.lang AND n.level = s.level AND n.i = s.i
  LEFT JOIN tops t ON s.tree = 1 AND t.level = s.level AND t.i = s.i GROUP BY s.lang, s.pos),
folded AS (SELECT v.*, subroot, root, coalesce(proof, []) AS proof, list_reduce(list_prepend(altered, coalesce(proof, [])),
    lambda a, e: sha256(CASE WHEN e[1] = 'L' THEN e[2:] || a ELSE a || e[2:] END)) AS folded_root
  FROM leaves v JOIN subroots s ON s.lang IS NOT DISTINCT FROM v.lang CROSS JOIN root LEFT JOIN marked m ON m.lang IS NOT DISTINCT FROM v.lang AND m.pos = v.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda e: e[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    altered = F.when(tampered, manifest.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]))
    proofs, root = manifest.manifest(docs, docs.columns, "lang", "doc_id", {"altered": altered})
    folded = proofs.withColumn("folded_root", manifest.fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document (by a hash of its id) from some place on, replaced by a repetition of the first of them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op13_periodic_runs", f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC_SQL.format('doc_id')} AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END) ELSE w END AS w FROM e),
words AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM x),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(0, n - 4)) AS i FROM x WHERE n >= 6)),
periods AS (SELECT DISTINCT a.doc_id, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
same AS (SELECT p.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY p.doc_id, q ORDER BY a.i) AS island FROM periods p JOIN words a USING (doc_id) JOIN words b ON b.doc_id = a.doc_id AND b.i = a.i + q AND b.word = a.word),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretch r WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.length >= r.s + r.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, b.length::BIGINT AS length, q::BIGINT AS period, (1000 * b.length // q)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN listed USING (doc_id) LEFT JOIN best b ON b.doc_id = x.doc_id LEFT JOIN kept k ON k.doc_id = x.doc_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=repeated_tail)
    lines_of = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
                        F.floor(F.lit(1000) * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
                        F.sha2(F.when(F.size("runs") > 0, F.concat(lines_of, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
