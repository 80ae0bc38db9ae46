"""Registered queries of the operators, with check SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm import (bitsliced, chat, laesa, language_model, lines, merkle, minhash, mixing, pieces, quality,
                            quantised, sharding, toxicity)
from corpuslens.llm.common import documents, remainder

# White space the contracts strip and split at, as SQL.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1,
                            keep_first=False)
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM doc
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {_SPACES}), {_LOWER}) AS k FROM line
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return language_model.score(docs, language_model.held_out_seventh())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "score", F.col("kept").cast("int").alias("predicted"), "votes_bad")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return bitsliced.search(vectors, F.col("id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return quantised.near_duplicates(vectors, cosine=0.93)


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = pieces.encode(docs, pieces.Vocabulary.read(pieces.MODEL), k=2, whole=True)
    return coded.select("doc_id", "ids", "n_pieces", "score", F.get("others", F.lit(0)).alias("second_score"),
                        F.get("other_ids", F.lit(0)).alias("second_ids"), "decoded_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.weigh(documents(spark, sf_dir), target_entropy=0.97, max_repeats=2.0)
    return mixing.schedule(mix)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=4, percent=80)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return (toxicity.classify(documents(spark, sf_dir).select("doc_id", "text"), labels)
            .select("doc_id", "held_out", "score", "predicted", "n_hits"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    coded, book = laesa.compress(vectors)
    return coded.withColumn("codebooks_sha256", F.lit(laesa.digest(book) if book else ""))


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every round by brute force: all parts against all entries."""
    def round_(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, CAST(min(d) AS BIGINT) AS d, CAST(arg_min(e, d * {entries} + e) AS BIGINT) AS e
  FROM (SELECT part.r, part.p, part.x, b.e, list_inner_product(part.x, part.x)
        - 2 * list_inner_product(part.x, b.x) + list_inner_product(b.x, b.x) AS d FROM part JOIN b{n} AS b USING (p))
  GROUP BY r, p)"""

    def improved(n: int) -> str:
        return f"""m{n} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, CAST((s - ((s % c) + c) % c) // c AS DOUBLE) AS m FROM (
      SELECT p, e, i, sum(CAST(v AS BIGINT)) AS s, count(*) AS c
      FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{n - 1}) GROUP BY p, e, i))
  GROUP BY p, e
), b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m{n}.x, b.x) AS x FROM b{n - 1} AS b LEFT JOIN m{n} USING (p, e))"""

    steps = [round_(0)]
    for n in range(1, rounds + 1):
        steps += [improved(n), round_(n)]
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         [floor({scale} * x::DOUBLE) FOR x IN embedding] AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), part AS MATERIALIZED (
  SELECT r, p, c[p * len(c) // {parts} + 1 : (p + 1) * len(c) // {parts}] AS x FROM v, range({parts}) AS parts(p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM part WHERE r <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) FOR y IN x], ','), ',' ORDER BY p, e)) FROM b{rounds})
         AS codebooks_sha256
FROM coded JOIN v USING (r)
"""


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table.union(fixed).withColumn("content", chat.text_parts("text"))
    return chat.read_back(chat.format_chats(turns))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), formatted AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*(?:/?s>|\|(?:image|audio|document|file)\|>))', '<\\\1', 'g'),
                           '\[(\\*/?INST\])', '[\\\1', 'g') AS escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + 1 + length(escaped) + CASE WHEN role = 'assistant' THEN 7 ELSE 15 END) AS BIGINT)
         AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments,
       CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens
FROM formatted GROUP BY conv_id
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(remainder(F.col("doc_id"), 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _op13_sql(levels: int = 12) -> str:
    """Level by level, as many as a source of 3 ** levels rows needs; the second tree is that of the subroots."""
    def field(name: str, value: str | None = None) -> str:
        value = value or f"CAST({name} AS VARCHAR)"
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"

    def leaf(text: str | None = None) -> str:
        return f"sha256({' || '.join([field(c) for c in ('doc_id', 'source', 'lang', 'n_chars')] + [field('text', text)])})"

    def level(tree: str, at: int) -> str:
        run = "PARTITION BY source, pos // 3 ORDER BY pos ROWS BETWEEN"
        return f"""{tree}{at}s AS MATERIALIZED (
  SELECT source, pos, n, d,
         coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {tree}{at}
), {tree}{at + 1} AS MATERIALIZED (
  SELECT source, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n,
         CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
  FROM {tree}{at}s GROUP BY source, pos // 3
)"""

    def folded(name: str, tree: str, at: int) -> str:
        return f"""{name}{at + 1} AS MATERIALIZED (
  SELECT x.r, x.own, x.source, x.pos // 3 AS pos, CASE WHEN s.n = 1 THEN x.d ELSE sha256(s.lft || x.d || s.rgt) END AS d,
         x.proof || s.lft || s.rgt AS proof
  FROM {name}{at} AS x JOIN {tree}{at}s AS s ON s.source IS NOT DISTINCT FROM x.source AND s.pos = x.pos
)"""

    steps = range(levels)
    crc = ("list_reduce([ord(c) FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '') IF c <> ''], "
           "lambda h, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], "
           "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(h, CAST(b AS BIGINT))), CAST(4294967295 AS BIGINT))")
    return f"""
WITH leaf AS (
  SELECT doc_id, source, {leaf()} AS d,
         CASE WHEN {crc} % 2 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf()} END AS now
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS r FROM leaf
), t0 AS (SELECT source, pos, n, d FROM placed),
{", ".join(level("t", at) for at in steps)},
top AS MATERIALIZED (
  SELECT source AS name, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t{levels}
), w0 AS (SELECT 0 AS source, pos, n, d FROM top),
{", ".join(level("w", at) for at in steps)},
f0 AS (SELECT r, source AS own, source, pos, now AS d, '' AS proof FROM placed),
{", ".join(folded("f", "t", at) for at in steps)},
g0 AS (SELECT f.r, f.own, 0 AS source, top.pos, f.d, f.proof
       FROM f{levels} AS f JOIN top ON top.name IS NOT DISTINCT FROM f.own),
{", ".join(folded("g", "w", at) for at in steps)}
SELECT placed.doc_id, placed.d AS leaf, top.d AS subroot, w.d AS root, sha256(g.proof) AS proof_sha256,
       g.d AS folded_root, g.d = w.d AS verified
FROM g{levels} AS g JOIN placed USING (r) JOIN top ON top.name IS NOT DISTINCT FROM g.own, w{levels} AS w
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_language_model": op3_language_model,
    "op4_quality": op4_quality,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_mixing": op8_mixing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op5_exact_top_k": OP5_SQL, "op11_vector_codes": _op11_sql(),
              "op12_chat_formatting": OP12_SQL, "op13_merkle_manifest": _op13_sql()}
