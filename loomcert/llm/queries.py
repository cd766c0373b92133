"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, jaccard, langid, media, packing, pieces, quality, suffixes, toxicity
from .util import read_table, stored


def held_out(divisor: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor == remainder


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, ~held_out(4, 2))).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(read_table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_decode(read_table(spark, sf_dir, "documents"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_rows(read_table(spark, sf_dir, "documents"))


def to_pack(docs: DataFrame) -> DataFrame:
    """doc_id, length, source and cluster of each row of docs: near copies are of one cluster, what is alone or has no words of none."""
    rows = suffixes.with_row(docs).select("doc_id", F.octet_length("text").alias("length"), "source", "row")
    return rows.join(jaccard.clusters(docs), "row", "left").select("doc_id", "length", "source", "cluster")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stored(to_pack(read_table(spark, sf_dir, "documents")), "to_pack"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(*chat.turns_as_calls(read_table(spark, sf_dir, "conversations")), chat.ANSWER)


_OP8 = """
WITH c AS (
  SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN conv_id || '-' || turn END AS own,
         last_value(CASE WHEN role = 'user' THEN conv_id || '-' || turn END IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM conversations),
calls AS (SELECT *, CASE WHEN own IS NOT NULL THEN dense_rank() OVER (PARTITION BY conv_id, own IS NULL ORDER BY turn) - 1 END AS lvl FROM c WHERE role = 'user'),
ids AS (SELECT DISTINCT conv_id, own, lvl FROM calls WHERE own IS NOT NULL),
answered AS (SELECT DISTINCT conv_id, before FROM c WHERE role = 'assistant' AND before IS NOT NULL)
SELECT k.conv_id, k.turn, k.role, 'call' AS type, k.own AS call_id, CAST(2 * k.lvl AS BIGINT) AS level, a.before IS NOT NULL AS linked,
       concat_ws('; ', CASE WHEN k.text IS NULL THEN 'prompt: missing' WHEN k.text = '' THEN 'prompt: small' END, CASE WHEN k.turn IS NULL THEN 'turn: missing' WHEN k.turn < 0 THEN 'turn: small' END) AS errors,
       '{"arguments":{' || concat_ws(',', CASE WHEN k.text IS NOT NULL THEN '"prompt":' || CAST(to_json(k.text) AS VARCHAR) END, CASE WHEN k.turn IS NOT NULL THEN '"turn":' || k.turn END) || '},'
         || CASE WHEN k.own IS NULL THEN '' ELSE '"call_id":"' || k.own || '",' END || '"name":"answer","role":"user","type":"call","valid":'
         || CASE WHEN k.text IS NULL OR k.text = '' OR k.turn IS NULL OR k.turn < 0 THEN 'false' ELSE 'true' END || '}' AS json
FROM calls k LEFT JOIN answered a ON a.conv_id = k.conv_id AND a.before = k.own
UNION ALL
SELECT c.conv_id, c.turn, c.role, 'result', c.before, CAST(2 * k.lvl + 1 AS BIGINT), c.before IS NOT NULL, NULL,
       '{' || CASE WHEN c.before IS NULL THEN '' ELSE '"call_id":"' || c.before || '",' END || CASE WHEN c.text IS NULL THEN '' ELSE '"content":' || CAST(to_json(c.text) AS VARCHAR) || ',' END
         || '"role":"assistant","type":"result"}'
FROM c LEFT JOIN ids k ON k.conv_id = c.conv_id AND k.own = c.before WHERE c.role = 'assistant'
UNION ALL
SELECT conv_id, turn, role, 'message', NULL, CAST(-1 AS BIGINT), false, NULL,
       '{' || concat_ws(',', CASE WHEN text IS NOT NULL THEN '"content":' || CAST(to_json(text) AS VARCHAR) END, CASE WHEN role IS NOT NULL THEN '"role":' || CAST(to_json(role) AS VARCHAR) END, '"type":"message"') || '}'
FROM c WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_pieces": op4_pieces,
    "op5_fingerprints": op5_fingerprints,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_chat": op8_chat,
    "op9_suffixes": op9_suffixes,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op8_chat": _OP8}
