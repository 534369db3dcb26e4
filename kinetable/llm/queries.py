"""Registered queries of the text operators; each reads its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, jaccard, language, near_vectors, packing, periodic, phrases, quality, sharding, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DEDUP_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)"""


@query("op10_exact_dedup", _DEDUP_SQL)
def op10(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


_U = "((('0x' || substr(md5({key} || '/' || {name}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def _tree_sql(n: int, grown: bool) -> str:
    """Rows (doc_id, shard) of the tree with n shards, 4 a rack and 8 a region; a grown tree adds one in a new region."""
    more = f" UNION ALL SELECT {n}, 'g{-(-n // 8)}', 'k{-(-n // 4)}'" if grown else ""
    u = _U.format(key="d.doc_id", name="c.name")
    return f"""
  WITH leaf AS (SELECT i AS shard, 'g' || (i // 8) AS region, 'k' || (i // 4) AS rack FROM range({n}) r(i){more}),
  regions AS (SELECT region AS name, count(*)::DOUBLE AS w FROM leaf GROUP BY region),
  racks AS (SELECT region, rack AS name, count(*)::DOUBLE AS w FROM leaf GROUP BY region, rack),
  a AS (SELECT d.doc_id, arg_min(c.name, -ln({u}) / c.w) AS region FROM documents d, regions c GROUP BY d.doc_id),
  b AS (SELECT d.doc_id, arg_min(c.name, -ln({u}) / c.w) AS rack FROM a d JOIN racks c ON c.region = d.region GROUP BY d.doc_id)
  SELECT d.doc_id, arg_min(c.shard, -ln({u})) AS shard
  FROM b d JOIN (SELECT shard, rack, 's' || shard AS name FROM leaf) c ON c.rack = d.rack GROUP BY d.doc_id"""


_SHARD_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
body AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
now AS ({_tree_sql(40, False)}),
grown AS ({_tree_sql(40, True)})
SELECT b.doc_id, b.size, b.text_crc32, 'key' AS law, now.shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY {_U.format(key="b.doc_id", name="'slot'")}, b.doc_id, b.size, b.text_crc32) - 1 AS slot, grown.shard AS grown_shard
FROM body b JOIN now USING (doc_id) JOIN grown USING (doc_id)"""


@query("op8_hash_tree_shards", _SHARD_SQL)
def op8(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public tokenizer file of the contract, wherever it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_pack_best_fit")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_language_hierarchy")
def op2(spark, sf_dir):
    return language.predict_language(table(spark, sf_dir, "documents"))


@query("op9_quality_random_indexing")
def op9(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_jaccard_rtree")
def op5(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_repeated_phrases")
def op4(spark, sf_dir):
    return phrases.remove_repeats(table(spark, sf_dir, "documents"))


@query("op7_benchmark_leaks")
def op7(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_separator_scan")
def op3(spark, sf_dir):
    # 49407 ends documents; ordinary text never encodes to it
    found = token_files.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), 49407)
    return found.select("doc_id", "n_tokens", "start", "ordinal")


_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.keep <> p.page_id THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000"""


@query("op6_warc_round_trip", _WARC_SQL)
def op6(spark, sf_dir):
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
root AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT r.id AS vec_id, coalesce(n.n_links, 0) AS n_links, r.component_id, r.id = r.component_id AS kept
FROM root r LEFT JOIN n ON n.a = r.id"""


@query("op11_pstable_near_vectors", _VECTORS_SQL)
def op11(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS own_total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT t.lang, t.source, k.term, coalesce(n.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (t.own_total + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (l.lang_total + l.v)::HUGEINT AS q
  FROM total t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term' AS part, item, value FROM terms),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM numbered WHERE part = 'pair' OR rank <= 200"""


@query("op12_source_divergence", _DIVERGENCE_SQL)
def op12(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_RUNS_SQL = rf"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: {_CRC_STEP}) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table),
a AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS k FROM d),
b AS (SELECT *, 1 + (n - a) // k AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM b),
grams AS (SELECT r, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda i: array_to_string(w[i + 1:i + 6], ' '))) AS gram FROM t WHERE n >= 12),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON y.r = x.r AND y.gram = x.gram AND y.i > x.i),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
chains AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM chains WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
best AS (
  SELECT r, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, [-length, start, period]) AS b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY r),
words AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM t),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words v
  WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = v.r AND v.i >= u.start + u.period AND v.i < u.start + u.length) GROUP BY r)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


def repeated_tail(doc_id, n: int) -> tuple[int, int] | None:
    """Of every tenth document by crc32, the tail from a word on repeats 3 to 10 times."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query("op13_grammar_runs", _RUNS_SQL)
def op13(spark, sf_dir):
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), repeat=repeated_tail)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    out = found.withColumn("b", best).withColumn("listed", listed)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), (-F.col("b.minus")).alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * -b.minus div b.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
