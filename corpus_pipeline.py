"""From raw documents to token ids: quality, near copies, repeated passages, source mix, tokens.

Each stage is written as Parquet and read again as the next one's documents. A stage hands its operator the
columns it needs and all others as one, so documents may have further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodrank.llm import jaccard_join, mixing, quality, sentencepiece_fst, substring_dedup
from moodrank.llm.common import packed_rest, read, saved

NEAR_WIDTH, NEAR_PERCENT = 5, 80
"""What counts as a near copy here; op 9's own query keeps the join's narrower default."""


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays below their language's threshold. Null, empty and blank texts go."""
    narrow, restore = packed_rest(docs, "doc_id", "lang", "text")
    return restore(quality.score(narrow, read(spark, sf_dir, "labels"), keep=("_rest", "text")).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of rows that repeat it, one. Rows
    of one id with different texts are different documents. All without an id or without a word stay."""
    found = saved(jaccard_join.join(docs, NEAR_WIDTH, NEAR_PERCENT), "pipeline-groups")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", F.col("first.key").alias("_key"))
    narrow, restore = packed_rest(docs, "doc_id", "text")
    grouped = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = narrow.withColumn("_key", F.xxhash64("text"))
    kept = keyed.where(grouped).join(first, ["doc_id", "_key"], "left_semi")
    if found.where("root IS NOT NULL").groupBy("doc_id", "key").count().where("count > 1").limit(1).count():  # rows that repeat
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return restore(kept.unionByName(keyed.where(~grouped)))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document has; one that is nothing else goes. A text of which
    nothing is cut stays as it is; n_chars follows the text."""
    narrow, restore = packed_rest(docs, "doc_id", "text")
    out = substring_dedup.dedup(narrow, keep=("_rest",), columns=("text", "kept_text")).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return restore(out, new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows of one id and text share what the mix takes of them."""
    narrow, restore = packed_rest(docs, "doc_id", "text", "source")
    keyed = narrow.withColumn("_key", F.xxhash64("text"))
    mix = mixing.mix(keyed, mixing.quality_weight(F.col("_quality")), keep=("_key",), labels=read(spark, sf_dir, "labels"))
    times = saved(mix.groupBy("doc_id", "_key").agg(F.sum("epochs").alias("all"), F.count("*").alias("rows")).where("all > 0"), "pipeline-times")
    times = times.select(F.col("doc_id").alias("id_"), F.col("_key").alias("key_"), "all", "rows")
    taken = keyed.join(times, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("_key") == F.col("key_")))
    even = taken.withColumn("n", F.floor(F.col("all") / F.col("rows")))
    if times.where("all % rows > 0").limit(1).count():  # at most one id and text of a source stands on the mix's border
        order = Window.partitionBy("doc_id", "_key").orderBy("_key")
        border = even.where("all % rows > 0").withColumn("n", F.col("n") + (F.row_number().over(order) <= F.col("all") % F.col("rows")).cast("long"))
        even = even.where("all % rows = 0").unionByName(border).where("n > 0")
    return restore(even.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, null for null text; a column `ids` of the documents is replaced."""
    narrow, restore = packed_rest(docs.drop("ids"), "doc_id", "text")
    out = sentencepiece_fst.encode(narrow, keep=("doc_id", "_rest"), columns=("text", "ids"))
    return restore(out, also=("ids",))


STAGES = [
    ("quality", reject_low_quality),
    ("near_copies", drop_near_copies),
    ("passages", cut_repeated_passages),
    ("mix", mix_sources),
    ("tokens", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
