"""Words against a vocabulary, as joins: completions, stems and spelling corrections of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import osa_distance
from ..plans.reader import SUFFIXES


def completions(prefixes: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """prefixes(prefix), vocab(key, tier, n, pinned) -> prefix, key, tier, n, place: single words that start so, those with
    canonical items first, then by tier and number of items. Keys are listed under each of their starts that is asked for."""
    lengths = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # a few lengths
    starts = vocab.where("NOT contains(key, ' ')").withColumn("prefix", F.explode(F.array(*[F.substring("key", 1, n) for n in lengths] or [F.lit(None)])))
    found = starts.join(prefixes.distinct(), "prefix").distinct()
    order = Window.partitionBy("prefix").orderBy(F.col("pinned").desc(), F.col("tier").desc(), F.col("n").desc(), "key")
    return found.withColumn("place", F.row_number().over(order).cast("int")).where(F.col("place") <= k).select("prefix", "key", "tier", "n", "place")


def stems(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """words(word), vocab(key, tier) -> word, key: the longest known word of four letters and more before an ending; before
    `y` not one of the lowest tier."""
    v = vocab.where(F.length("key") >= 4).select("key", "tier")
    cut = words.where(F.length("word") >= 5).select("word", F.explode(F.array(*map(F.lit, SUFFIXES))).alias("suffix")).where(F.endswith("word", "suffix"))
    cut = cut.withColumn("key", F.expr("substring(word, 1, length(word) - length(suffix))")).join(v, "key").where("suffix <> 'y' OR tier <> 0")
    return cut.groupBy("word").agg(F.max_by("key", F.length("key")).alias("key"))


def _without_letter(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def forms(c: Column, cap: int) -> Column:
    """A word and what is left of it without one, two, up to `cap` letters: words within `cap` edits share one."""
    out = last = F.array(c)
    for _ in range(cap):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda x: F.length(x) > 1), _without_letter)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def corrections(typed: DataFrame, vocab: DataFrame, alone: bool = True) -> DataFrame:
    """typed(typed), vocab(key, tier, n) -> typed, key, edits: the nearest single word, ties by tier, number of items and key;
    one edit for words of up to five letters, two up to eight, three beyond, in a longer query one; words of three
    letters stay, and keys of the lowest tier with fewer than five items are none."""
    length = F.length("typed")
    cap = F.when(length <= 5, 1).when(length <= 8, 2).otherwise(3) if alone else F.lit(1)
    v = vocab.where("NOT contains(key, ' ') AND (tier > 0 OR n >= 5)")
    out = None
    for edits in (1, 2, 3) if alone else (1,):
        mine = typed.select("typed").distinct().where(length > 3).where(cap == edits)
        left = mine.select("typed", F.explode(forms(F.col("typed"), edits)).alias("form"))
        right = v.select("key", "tier", "n", F.explode(forms(F.col("key"), edits)).alias("form"))
        near = left.join(right, "form").select("typed", "key", "tier", "n").distinct().where(F.abs(F.length("typed") - F.length("key")) <= edits)
        near = near.withColumn("edits", osa_distance(F.col("typed"), F.col("key"), F.lit(edits))).where(F.col("edits") <= edits)
        out = near if out is None else out.unionByName(near)
    best = F.struct("edits", (-F.col("tier")).alias("t"), (-F.col("n")).alias("m"), "key")
    return out.groupBy("typed").agg(F.min(best).alias("b")).select("typed", "b.key", "b.edits")
