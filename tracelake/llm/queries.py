"""The queries opN_<name>: each applies one operator to its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, curve, hard_negatives, licenses, minhash, mixing, packing, quality, sharding, substring, suffix, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(docs, shards=16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "n_tokens", "epoch", "block_slot", F.round("source_weight", 9).alias("source_weight"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and, as none of them is a licence, a changed specimen of each known text, with an id below 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs.unionByName(licenses.specimens(docs))).select("doc_id", "canonical_chars", "canonical_sha256", "license_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_shared(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_minhash_dedup, op4_quality_rules, op5_histogram_shards, op6_temperature_mixing, op7_best_fit_packing, op8_prefix_forest, op9_license_scan, op10_suffix_dedup, op11_prefix_trie, op12_hard_negatives, op13_curve_packing)}


#: The words of a text, as a list.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op4_sql() -> str:
    """The base counts and the rules as SQL; the verdict is built from the same table of rules."""
    tests = []
    for r in quality.RULES:
        ratio = f"{r.numerator}::DOUBLE / greatest({r.denominator}, 1)"
        tests += [f"{ratio} >= {r.least}"] if r.least is not None else []
        tests += [f"{ratio} <= {r.most}"] if r.most is not None else []
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(3) t(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lin AS (SELECT r, count(*) AS n, count(DISTINCT line) AS u FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
ws AS (SELECT r, unnest(w) AS x FROM d),
wc AS (SELECT r, sum(length(x))::BIGINT AS c, count(*) FILTER (WHERE lower(x) IN ({stops})) AS s FROM ws GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lin.n, 0)::BIGINT AS n_lines,
  coalesce(lin.n - lin.u, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(s, 0)::BIGINT AS n_stop_words
  FROM d LEFT JOIN cov USING (r) LEFT JOIN lin USING (r) LEFT JOIN wc USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


def _op9_sql() -> str:
    from .license_texts import EQUIVALENT, known_texts
    from .licenses import HOLDER_LINE, LIST_MARK, NO_WORD, RIGHTS_LINE

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), '\\r\\n?', chr(10), 'g')"
        for line in (HOLDER_LINE, RIGHTS_LINE, LIST_MARK):
            x = f"regexp_replace({x}, {quoted('(?m)' + line)}, '', 'g')"
        x = f"' ' || regexp_replace({x}, {quoted(NO_WORD)}, '  ', 'g') || ' '"  # every word between two spaces of its own
        for other, usual in EQUIVALENT:
            x = f"replace({x}, ' {other.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    known = ", ".join(f"({i}, {quoted(k)}, {quoted(t)})" for i, (k, t) in enumerate(known_texts(), 1))
    return f"""
WITH texts AS (SELECT * FROM (VALUES {known}) v(i, k, t)),
known AS (SELECT sha256({canonical("t")}) AS h, min(k) AS license_id FROM texts GROUP BY 1),
rows AS (SELECT doc_id, text FROM documents UNION ALL
  SELECT -i, 'Copyright (c) 2021 Some Holder. All rights reserved.' || chr(13) || chr(10) || replace(upper(t), 'LICENSE', 'LICENCE') FROM texts),
d AS (SELECT doc_id, {canonical("text")} AS c FROM rows)
SELECT doc_id, length(c)::BIGINT AS canonical_chars, sha256(c) AS canonical_sha256, license_id
FROM d LEFT JOIN known ON known.h = sha256(c)"""


def _op1_sql() -> str:
    """The base32 form of a digest is spelled from its bits, five at a time."""
    bits = "list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || sha1_hex[i])::INTEGER), 4, '0')), 'string_agg', '')"
    letters = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: (substr(bits, 1 + i * 5 + k, 1))::INTEGER * (1 << (4 - k))))::BIGINT, 1)), 'string_agg', '')"
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha1_hex FROM pages),
b AS (SELECT *, {bits} AS bits, max(page_id) OVER (PARTITION BY sha1_hex) AS top FROM p)
SELECT page_id, payload_bytes, {letters} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM b"""


#: Fixed definition of the result: passages of 20 words and their first places.
_OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) t(k)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


#: The CRC-32 of a decimal number is taken bit by bit; a node's key are the digests of its turns, so subtrees are prefixes.
_OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT conv_id, list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))) AS b FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(b::BIGINT[],
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) % 4 AS h FROM bits),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i <= h
  UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h),
s AS (SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS k,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p AS (SELECT * FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM p GROUP BY k, d),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(k, d) AS k FROM p GROUP BY conv_id) GROUP BY k),
child AS (SELECT k[: 64 * (d - 1)] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sub AS (SELECT a.k, count(*) FILTER (WHERE child.n IS NULL) AS leaves, sum((b.n - 1) * b.words) AS saved
  FROM node a JOIN node b ON starts_with(b.k, a.k) LEFT JOIN child ON child.k = b.k GROUP BY a.k)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children,
  leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sub USING (k) LEFT JOIN child USING (k) LEFT JOIN ends USING (k) LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.k = node.k[: 64 * (node.d - 1)]"""

_OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _op1_sql(), "op2_substring_dedup": _OP2_SQL, "op4_quality_rules": _op4_sql(), "op9_license_scan": _op9_sql(), "op11_prefix_trie": _OP11_SQL, "op12_hard_negatives": _OP12_SQL}
