"""Registered queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, media, packing, pii, quality, simhash, suffixdedup, warc
from .common import documents, table

#: The vocabulary files of public tokenizers; their folder is a parameter of the operators.
RANKS = "byte_bpe_50k.tiktoken"
MODEL = "byte_bpe_50k.json"


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PNG, read back and described."""
    stored = media.encode_media(documents(spark, sf_dir)).select("doc_id", "media")
    return media.media_features(stored).drop("media")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, likelihood-ratio score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, indexed, and read back through the index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_and_read(pages).drop("url")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(rows.filter(~held)))
    return langid.identify(rows.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text loses to passages that repeat."""
    return suffixdedup.measured(documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one made of control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.canonical(rows.unionByName(more)))
    return chat.read_back(made.select("conv_id", F.struct("formatted", "loss_spans").alias("output"))).drop("output")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.personal_data(documents(spark, sf_dir)).drop("text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    import public_tokenizers

    df = bpe.digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return df.drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, cut and packed."""
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(MODEL), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_media": op1_media, "op2_quality": op2_quality, "op3_warc": op3_warc, "op4_langid": op4_langid, "op5_suffixes": op5_suffixes, "op6_chat": op6_chat, "op7_pii": op7_pii, "op8_bpe": op8_bpe, "op9_simhash": op9_simhash, "op10_packing": op10_packing}


#: What op3_warc returns, from the pages alone.
OP3_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""

#: What op6_chat returns: lengths of marks by role, and escapes counted as characters they add.
OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<ROLE:|</ROLE>>)', '\1\\\2\3', 'g'))
           + CASE WHEN role = 'user' THEN 18 WHEN role = 'assistant' THEN 6
                  WHEN regexp_matches(role, '^[A-Za-z0-9_.-]*$') THEN 20 + length(role)
                  ELSE 21 + 2 * strlen(role) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op6_chat": OP6_SQL}
