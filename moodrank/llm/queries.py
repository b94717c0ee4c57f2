"""The operators applied to their tables, and SQL for the same rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chat, embedding_dedup, jaccard_join, language_id, mixing, quality, sentencepiece_fst, substring_dedup, token_counts, topk_search
from .common import read


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = T.StructType().add("kept_sha256", "string")
    return substring_dedup.dedup(read(spark, sf_dir, "documents"), columns=(), derive=(digest, lambda texts, kept: [list(map(substring_dedup.sha256, kept))]))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _piece_digest(texts: list[str | None], ids: pa.Array, decoded: list[str | None]) -> list:
    lines = pc.binary_join(ids.cast(pa.list_(pa.string())), ",")
    return [
        pc.list_value_length(ids).cast(pa.int64()),
        [None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in lines.to_pylist()],
        [None if t is None else d == t.replace(sentencepiece_fst.SPACE, " ") for t, d in zip(texts, decoded)],
    ]


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids' number and digest, and whether decoding gives the text back."""
    digest = T.StructType().add("n_pieces", "long").add("ids_sha256", "string").add("round_trip", "boolean")
    return sentencepiece_fst.encode(read(spark, sf_dir, "documents"), columns=(), derive=(digest, _piece_digest))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), mixing.quality_weight(F.col("_quality")), labels=read(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_chats(chat.with_extra(read(spark, sf_dir, "conversations"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read(spark, sf_dir, "documents"))


def op8_quality_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_substring_dedup, op3_topk, op4_sentencepiece, op5_source_mix, op6_chat_format, op7_language_id, op8_quality_kn, op9_jaccard_join, op10_token_counts)}
ORACLE_SQL = {"op2_substring_dedup": substring_dedup.ORACLE, "op3_topk": topk_search.ORACLE, "op5_source_mix": mixing.ORACLE, "op6_chat_format": chat.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE}
