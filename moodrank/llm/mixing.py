"""Mixing sources to target weights: weighted sampling by exponential keys.

Every document gets the key ``-ln(u) / weight`` with u uniform from a digest of its
id (Efraimidis and Spirakis). A source whose target is e whole epochs and a rest
takes every document e times, then documents in ascending key order until their
sizes add up to the rest; the document on the border is taken if more than half
of it fits. Only DataFrame functions run.

No task sees a whole source: keys map to buckets in ascending order, the buckets'
summed sizes find the bucket where the rest ends, that bucket is cut again in the
same way, and only the documents of the last small bucket are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, saved

BUCKETS = 512
QUALITY_WEIGHTS = {1: 1.0, 0: 0.25, None: 0.5}
"""Weight of a document by its quality label; None: it has no label."""


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from the digest of the id, of the text if there is no id: the same in every run and engine."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(text), F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) in, one row a source -> with target: sources by code
    point, null last, weigh `weights` in turn and share `share` times all words; a
    target stops at `most` times its source's size and the excess is reshared by
    weight. Sources fill up in ascending order of most * size / weight, so one
    pass over that order finds the level at which the rest share."""
    if share > most:
        raise ValueError("share is over most: the sources cannot hold it")
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    order = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = ranked.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(order), F.lit(0.0))).alias("over"),
        F.row_number().over(filling).alias("nth"),
    )
    # The level if all sources before this one are full; the first that stays below its cap sets it.
    here = F.col("left") / F.col("over")
    level = F.min(F.when(here <= F.col("cap") / F.col("w"), F.struct("nth", here.alias("level")))).over(whole)["level"]
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce(level, F.lit(float("inf")))).alias("target"))


def _border(rows: DataFrame, cut: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (source, rest, size, x, ...) with x in [0, 1): cut every source's x-range into
    BUCKETS, and return the rows with state: -1 before the bucket where the sizes
    reach the rest, 0 in it, 1 behind; rows of state 0 get the rest left for them."""
    rows = rows.withColumn("b", F.least(F.floor(cut * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    buckets = rows.groupBy("source", "b").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.select("source", "b", (F.sum("s").over(upto) - F.col("s")).alias("before"), F.sum("s").over(upto).alias("upto"), "rest")
    ends = buckets.where((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest"))).groupBy("source").agg(F.min("b").alias("end"), F.min_by("before", "b").alias("before"))
    return rows, ends


def mix(
    docs: DataFrame,
    weight: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
    labels: DataFrame | None = None,
) -> DataFrame:
    """docs(doc_id, text, source, *keep) -> doc_id, *keep, size, source_size, target, taken and epochs.

    `weight` is a column of docs, over 0; null or not positive weighs 1. With labels(doc_id, quality) it may
    use `_quality`, the label of a row's id. Null text has no words and is never taken; rows without an id
    get their key from their text, repeated rows are separate documents, equal keys go by id and then
    size. Sources are compared byte by byte and null is a source of its own. Other columns are ignored.
    Texts are read once, in place: only ids, sources and sizes are shuffled."""
    w = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1.0))
    factors = [c for c in ([] if weight is None else docs.columns) if c not in ("doc_id", "source", "text", "size", "_log", *keep)] if labels is None else []
    sized = docs.select("doc_id", *keep, "source", *factors, word_count().alias("size"), (-F.log(uniform(F.col("doc_id"), F.col("text"), seed))).alias("_log"))
    if labels is not None:
        sized = labelled(sized, labels)
    # Ids that repeat share a key; the row's place within them is of no account.
    sized = saved(sized.select("doc_id", *keep, "source", "size", (F.col("_log") / w).alias("_order")), "mix")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = saved(targets, "mix-targets").select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    few = targets.count() <= 100_000  # one row a source in all three tables joined by it
    small = lambda df: F.broadcast(df) if few else df
    by_source = lambda left, right: left.join(small(right.withColumnRenamed("source", "s_")), F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    rows = by_source(sized, targets)
    # exp(-key) is uniform for weight 1 and falls as the key rises.
    rows = rows.withColumn("x", 1 - F.exp(-F.col("_order")))
    rows, ends = _border(rows, F.col("x"))
    rows = by_source(rows, ends.withColumnsRenamed({"end": "end1", "before": "before1"})).withColumn("b1", F.col("b"))
    inner = rows.where(F.col("b1") == F.col("end1")).withColumn("rest", F.col("rest") - F.col("before1"))
    inner, ends2 = _border(inner, F.col("x") * BUCKETS - F.floor(F.col("x") * BUCKETS))
    rows = by_source(rows, ends2.withColumnsRenamed({"end": "end2", "before": "before2"}))
    b2 = F.least(F.floor((F.col("x") * BUCKETS - F.floor(F.col("x") * BUCKETS)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    state = (
        F.when(F.col("rest") <= 0, "out")
        .when(F.col("end1").isNull() | (F.col("b1") < F.col("end1")), "in")
        .when(F.col("b1") > F.col("end1"), "out")
        .when(F.col("end2").isNull() | (b2 < F.col("end2")), "in")
        .when(b2 > F.col("end2"), "out")
        .otherwise("border")
    )
    rows = rows.withColumn("state", state)
    within = Window.partitionBy("source").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before1") - F.col("before2")
    border = rows.where(F.col("state") == "border").withColumn("fits", F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2.0 <= room)
    settled = rows.where(F.col("state") != "border").withColumn("fits", F.col("state") == "in")
    return settled.unionByName(border).select(
        "doc_id",
        *keep,
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("epochs") + F.col("fits").cast("long"))).alias("taken"),
        (F.col("epochs") + F.col("fits").cast("long")).alias("epochs"),
    )


def quality_weight(quality: Column) -> Column:
    return F.when(quality == 1, QUALITY_WEIGHTS[1]).when(quality == 0, QUALITY_WEIGHTS[0]).otherwise(QUALITY_WEIGHTS[None])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with its quality label as `_quality`; ids that repeat in labels count once. Rows without an id
    go past the join, as they would be one key of it."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    named = docs.where("doc_id IS NOT NULL").join(one, "doc_id", "left")
    return named.unionByName(docs.where("doc_id IS NULL").withColumn("_quality", F.lit(None).cast(labels.schema["quality"].dataType)))


ORACLE = r"""
WITH d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE l.quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS w,
         ((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'text:' || coalesce(md5(d.text), ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) AS u
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) l ON d.doc_id = l.doc_id),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2::DOUBLE * sum(size)::DOUBLE AS cap,
        ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS sw FROM k GROUP BY source),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS lft,
        sum(sw) OVER () - coalesce(sum(sw) OVER o, 0) AS ovr, row_number() OVER (ORDER BY cap / sw, source NULLS LAST) AS nth
      FROM s WINDOW o AS (ORDER BY cap / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, arg_min(lft / ovr, nth) FILTER (lft / ovr <= cap / sw) OVER () AS lvl FROM f),
t AS (SELECT source, source_size, least(cap, sw * lvl) AS target,
        CASE WHEN source_size > 0 THEN floor(least(cap, sw * lvl) / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
r AS (SELECT k.*, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken,
  (epochs + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM r
"""
