"""Usage, overlays, reports and other state, as batch operators over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decayed(events: DataFrame, keys: list[str], ts: Column, now: Column, half_life_s: float, forget: float = 1e-3) -> DataFrame:
    """Each key's sum of weights that halve every half life; sums under `forget` go. Events after now count 1."""
    age = F.greatest(F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")), F.lit(0)) / 1e6
    total = events.groupBy(*keys).agg(F.sum(F.pow(F.lit(0.5), age / half_life_s)).alias("weight"))
    return total.where(F.col("weight") >= forget)


def pruned(usage: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """The heaviest rows, ties by keys with null first."""
    return usage.orderBy(F.col("weight").desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(most)


def bucket(count: Column) -> Column:
    """What a shared count tells: one, a few, some or many."""
    return F.when(count >= 20, "20+").when(count >= 5, "5-19").when(count >= 2, "2-4").otherwise("1")


def estimated(bucket_: Column) -> Column:
    return F.when(bucket_ == "20+", 25).when(bucket_ == "5-19", 10).when(bucket_ == "2-4", 3).otherwise(1)


def newest(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate, so that a hot key is summed in the map tasks."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*seq)).alias("row"))
    return last.select("row.*")


def unsent(rows: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    return rows.join(sent.select(key).distinct(), key, "left_anti")


def layered_pins(pins: DataFrame, most: int = 3) -> DataFrame:
    """pins(term, layer, rank, seq, face, clear) -> term, face, place: later layers first, each by rank and
    order in the file, nothing from layers up to a term's last clearing one, the first three faces."""
    cleared = pins.where("clear").groupBy("term").agg(F.max("layer").alias("cut"))
    left = pins.where("NOT clear").join(cleared, "term", "left").where(F.col("cut").isNull() | (F.col("layer") > F.col("cut")))
    once = left.groupBy("term", "face").agg(F.min(F.struct((-F.col("layer")).alias("l"), "rank", "seq")).alias("at"))
    order = Window.partitionBy("term").orderBy("at", "face")
    return once.withColumn("place", F.row_number().over(order).cast("int")).where(F.col("place") <= most).select("term", "face", "place")


def chains(aliases: DataFrame, hops: int = 8) -> DataFrame:
    """aliases(old, new) -> old, final, hops. A chain over `hops` long or a circle is an error."""
    at = aliases.select("old", F.col("new").alias("final"), F.lit(1).alias("hops"))
    for _ in range(hops):
        step = aliases.select(F.col("old").alias("final"), F.col("new").alias("next"))
        at = at.join(step, "final", "left").select("old", F.coalesce("next", "final").alias("final"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return at.select("old", F.when(F.col("hops") <= hops, F.col("final")).otherwise(F.raise_error(F.lit("alias chain too long or a circle"))).alias("final"), "hops")


MOST_WORDS = 100_000
"""Up to so many words asked for are sent to every task, so that other words of the items are never shuffled."""


def postings(items: DataFrame, key: str, words: Column, only: DataFrame | None = None) -> DataFrame:
    """Each word's items with the best tier of the word there: by its first place, 0 to 2. `only`(word): just these words."""
    each = items.select(key, F.posexplode(words).alias("at", "word"))
    if only is not None:
        wanted = only.select("word").distinct()
        each = each.join(F.broadcast(wanted) if wanted.count() <= MOST_WORDS else wanted, "word", "left_semi")
    return each.groupBy("word", key).agg(F.min("at").alias("at")).select("word", key, (2 - F.least(F.col("at"), F.lit(2))).cast("int").alias("tier"))
