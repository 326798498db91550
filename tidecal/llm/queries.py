"""Queries over the test tables, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, exact_dedup, licenses, mixing, packing, pii, quality_model, quality_rules, sharding, simhash, spelling, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_docs(spark, sf_dir), _labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A window smaller than the labels of all test tables, so that every result comes through several sorted passes.
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), window=32, recall=0.9999)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_docs(spark, sf_dir))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"], m["edits"]))
    return found.withColumn("spans", F.array_join(spans, ",")).drop("matches")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return pii.find_pii(docs, pii.fit(docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_docs(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir)).drop("bucket")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(_docs(spark, sf_dir))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_license_scans": op5_license_scans,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_alignment": op13_token_alignment,
}

#: Lower-cases A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_P = sharding.PRIME
#: What scatters a row: its id, or 32 bits of its text's MD5 where it has none.
_SPREAD = "coalesce(doc_id, ('0x' || md5(coalesce(text, ''))[1:8])::BIGINT)"

#: The 256 entries of CRC-32.
_CRC_TABLE = """bits AS (
  SELECT v, list_reduce(list_prepend(v, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM (SELECT unnest(range(256)) AS v)
), crc_table AS (
  SELECT list(t ORDER BY v) AS t FROM bits
)"""


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text, where crc_table is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: (('0x' || h)::INTEGER)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, list_extract(t, xor(c & 255, x) + 1))), 4294967295)"


def _packing_sql(buckets: int, budget: int) -> str:
    """Each round of the dynamic program is one step r: best padding up to step j, and the last boundary before j."""
    rounds = "".join(
        f"""
), r{k} AS MATERIALIZED (
  SELECT b.j, least(b.best, m.f.cost) AS best, CASE WHEN m.f.cost < b.best THEN m.f.i ELSE -1 END AS came
  FROM r{k - 1} b LEFT JOIN (
    SELECT y.j, min({{'cost': r.best + y.step * (y.rows - x.rows) - (y.tokens - x.tokens), 'i': r.j}}) AS f
    FROM r{k - 1} r JOIN steps x ON x.j = r.j JOIN steps y ON x.j < y.j GROUP BY y.j
  ) m ON m.j = b.j"""
        for k in range(1, buckets)
    )
    choices = " UNION ALL ".join(f"SELECT {k} AS k, j, came FROM r{k}" for k in range(buckets))
    return rf"""
WITH RECURSIVE lengths AS MATERIALIZED (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, {_SPREAD} AS spread FROM documents
), histogram AS (
  SELECT n_tokens AS step, count(*) AS n, sum(n_tokens)::BIGINT AS t FROM lengths WHERE n_tokens <= {budget} GROUP BY 1
), steps AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY step) - 1 AS j, step, (sum(n) OVER (ORDER BY step))::BIGINT AS rows, (sum(t) OVER (ORDER BY step))::BIGINT AS tokens
  FROM histogram
), r0 AS MATERIALIZED (
  SELECT j, step * rows - tokens AS best, -1 AS came FROM steps{rounds}
), choices AS MATERIALIZED (
  {choices}
), path AS (
  SELECT {buckets - 1} AS k, max(j) AS j FROM steps
  UNION ALL
  SELECT path.k - 1, CASE WHEN c.came >= 0 THEN c.came ELSE path.j END FROM path JOIN choices c ON c.k = path.k AND c.j = path.j WHERE path.k > 0
), bounds AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY step) - 1 AS bucket, step AS bucket_len, coalesce(lag(step) OVER (ORDER BY step), -1) AS above
  FROM (SELECT DISTINCT step FROM path JOIN steps USING (j))
), bucketed AS (
  SELECT l.*, coalesce(bucket, (SELECT count(*) FROM bounds)) AS bucket, coalesce(bucket_len, n_tokens) AS bucket_len
  FROM lengths l LEFT JOIN bounds ON n_tokens > above AND n_tokens <= bounds.bucket_len
), sliced AS (
  SELECT doc_id, n_tokens, bucket, bucket_len, ((spread % 2147483648 * 1640531527 % 2147483648 + 2147483648) % 2147483648 * s.n) >> 31 AS slice
  FROM bucketed, (SELECT greatest(256, (count(*) + 199999) // 200000) AS n FROM lengths) s
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY slice, doc_id NULLS FIRST, n_tokens) - 1 AS place,
    greatest(1, {budget} // greatest(bucket_len, 1))::BIGINT AS batch_rows
  FROM sliced
)
SELECT doc_id, n_tokens, bucket::INTEGER AS bucket, bucket_len, (place // batch_rows)::BIGINT AS batch, batch_rows, bucket_len - n_tokens AS padding
FROM placed
"""


ORACLE_SQL = {
    "op2_packing": _packing_sql(packing.BUCKETS, packing.BUDGET),
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) >= {embeddings.COSINE} ELSE false END
), reach AS (
  SELECT vec_id AS node, vec_id AS met FROM usable
  UNION
  SELECT node, b FROM reach JOIN links ON met = a
), least AS (
  SELECT node, min(met) AS component_id FROM reach GROUP BY node
), counts AS (
  SELECT a AS node, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.node = vec_id LEFT JOIN counts ON counts.node = vec_id
""",
    "op4_sharding": f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_SPREAD} AS spread FROM documents
), {_CRC_TABLE}, bytes AS (
  SELECT rid, doc_id, spread, octet_length(encode(text)) + 16 AS size,
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (('0x' || h)::INTEGER)::BIGINT)) AS b
  FROM docs
), sums AS (
  SELECT rid, doc_id, spread, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, list_extract(t, xor(c & 255, x) + 1))), 4294967295) AS text_crc32
  FROM bytes, crc_table
), firsts AS (
  SELECT rid, doc_id, spread, size, text_crc32, s,
    (coalesce(((doc_id % {_P}) + {_P}) % {_P}, 0) + 1 + (s + 1) * 40503001 % {_P}) % {_P} * (48271 + 2 * s) % {_P} AS f
  FROM sums, (SELECT unnest(range(41)) AS s)
), seconds AS (
  SELECT *, xor(f, f >> 15) * 1812433253 % {_P} AS g FROM firsts
), draws AS (
  SELECT *, xor(g, g >> 13) * 69621 % {_P} AS d FROM seconds
), placed AS (
  SELECT rid, doc_id, spread, size, text_crc32,
    max_by(s, d * 64 + s) FILTER (s < 40) AS shard, max_by(s, d * 64 + s) AS grown_shard
  FROM draws GROUP BY ALL
), sliced AS (
  SELECT *, ((spread % 2147483648 * 1640531527 % 2147483648 + 2147483648) % 2147483648 * n) >> 31 AS slice
  FROM placed, (SELECT greatest(64, (count(*) + 199999) // 200000) AS n FROM documents)
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM sliced
""",
    "op10_mixing": rf"""
WITH words AS (
  SELECT doc_id, source, {_SPREAD} AS spread, source IS NULL AS no_source, coalesce(source, '') AS source_name,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sized AS (
  SELECT *, greatest(length(bin(size)) - 5, 0) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS bin,
    ((spread % 2147483648 * 1640531527) % 2147483648 + 2147483648) % 2147483648 AS mixed
  FROM words
), totals AS (
  SELECT no_source, source_name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY no_source, source_name) - 1 AS k FROM totals
), weighed AS (
  SELECT *, [5, 2, 1][1 + k % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0))::DOUBLE AS level
  FROM weighed WINDOW up AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT (min({{'r': cap / weight, 'k': k, 'level': level}}) FILTER (level * weight <= cap)).level AS water FROM levels
), targets AS (
  SELECT no_source, source_name, k, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target
  FROM levels, chosen
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    ('0x' || md5('{mixing.SEED}:' || CASE WHEN s.no_source THEN 'null' ELSE 'source' END || ':' || s.source_name)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY s.no_source, s.source_name ORDER BY s.bin, s.mixed, s.spread, s.size) - 1 AS place
  FROM sized s JOIN targets t USING (no_source, source_name)
), stepped AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS step
  FROM placed
)
SELECT doc_id, size, source_size, target,
  ((floor(u + step * (place + 1)) - floor(u + step * place)) * size)::BIGINT AS taken
FROM stepped
""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]{{5,}}')) AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32("id || ':' || run")} AS h FROM counted, crc_table
), results AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS MATERIALIZED (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION
  SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT f.word, forms.form FROM followed f JOIN forms ON forms.word = f.root WHERE forms.form IS NOT NULL
), last AS (
  SELECT f.word, f.root FROM followed f JOIN forms ON forms.word = f.root WHERE forms.form IS NULL
)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms LEFT JOIN last ON last.word = forms.word
""",
    "op12_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS norm FROM documents) WINDOW same AS (PARTITION BY norm)
""",
}
