"""Scores of items for a parsed query, as columns: every part a column of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The emotions in their order, weights, bounds and penalties of the score.
EMOTIONS = ["happy", "laughing", "excited", "love", "flirty", "playful", "smug", "proud", "calm", "sleepy", "sad", "angry", "scared", "surprised", "confused", "shy", "sorry", "bored", "disgusted"]
WEIGHTS = {"emotion": 0.5, "dense": 1.2, "engine": 1.2, "lexical": 0.2}
TIER_CREDIT = [0.5, 0.8, 1.0]
PIN_BONUS = [30.0, 20.0, 10.0]
USAGE_LIFT = {"off": 0.0, "low": 0.06, "normal": 0.15, "strong": 0.3}
LEAST_RATING = 0.08
CANDIDATE = 0.05
INNUENDO, SEXUAL, CRUDE, LONG_AT = 0.5, 1.5, 0.5, 14
FLAGS = ["suggestive", "explicit", "lenny", "crude", "multi", "not_face", "long"]


def dot(p: Column, r: Column) -> Column:
    return F.aggregate(F.zip_with(p, r, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def norm(p: Column) -> Column:
    return F.sqrt(dot(p, p))


def cosine(p: Column, r: Column) -> Column:
    return dot(p, r) / (norm(p) * norm(r))


def term_score(p: Column, r: Column, target: Column | None = None, negated: bool = False) -> Column:
    """How well ratings r suit a term's profile p: all of it, its absence, or the rating asked for."""
    if target is not None:
        close = F.zip_with(p, r, lambda x, y: F.when(y < LEAST_RATING, F.lit(0.0)).otherwise(x * (1 - F.abs(y - target))))
        return F.aggregate(close, F.lit(0.0), lambda a, x: a + x)
    return 1 - dot(p, r) if negated else dot(p, r)


def combined(mains: Sequence[Column], adverbs: Sequence[tuple[Column, float]] = (), sentence: bool = False) -> Column:
    """The least of the main terms, or their mean in a sentence, and 0.4 of each adverb by weight."""
    total = sum(mains[1:], mains[0]) / len(mains) if sentence else F.least(*mains) if len(mains) > 1 else mains[0]
    for score, weight in adverbs:
        total = total + 0.4 * weight * score
    return total


def list_credit(terms: DataFrame, lists: DataFrame) -> DataFrame:
    """terms(qid, term, weight, negated), lists(term, rank, item) -> qid, item, credit: each list's weight
    falls with the rank, over the weights of all terms with a list that are not negated."""
    listed = terms.where("NOT negated").join(lists.select("term").distinct(), "term")
    whole = listed.groupBy("qid").agg(F.sum("weight").alias("whole"))
    each = listed.join(lists, "term").groupBy("qid", "item").agg(F.sum(F.col("weight") / (1 + F.col("rank") / 10)).alias("sum"))
    return each.join(whole, "qid").select("qid", "item", (F.col("sum") / F.col("whole")).alias("credit"))


def lexical_credit(words: DataFrame, postings: DataFrame) -> DataFrame:
    """words(qid, word), postings(word, item, tier) -> qid, item, credit of the best tier."""
    credit = F.element_at(F.array(*map(F.lit, TIER_CREDIT)), F.col("tier") + 1)
    return words.distinct().join(postings, "word").groupBy("qid", "item").agg(F.max(credit).alias("credit"))


def figures_part(multi: Column, figures: str | None = None, preference: Column | None = None) -> Column:
    if figures == "single":
        return F.when(multi > 0.5, -0.35).otherwise(0.05)
    if figures == "pair":
        return 0.3 * (2 * multi - 1)
    if figures == "any":
        return F.lit(0.0)
    preference = F.lit(0.0) if preference is None else preference
    return F.when(preference > 0, 0.15 * preference * (2 * multi - 1)).otherwise(F.when(multi > 0.5, -(0.08 - 0.07 * preference)).otherwise(0.0))


def figure_preference(mean_m: Column) -> Column:
    return F.greatest(F.least((mean_m - 0.3) / 0.3, F.lit(1.0)), F.lit(-1.0))


def quality_part(quality: Column) -> Column:
    return 0.06 * F.greatest(F.least((quality - 5) / 3, F.lit(1.0)), F.lit(-1.0))


def length_part(length: Column, long_at: int = LONG_AT) -> Column:
    return 0 - F.least(0.012 * F.greatest(length - long_at, F.lit(0)), F.lit(0.2))


def suggestive_part(suggestive: Column, asked: bool = False, strict: bool = False, off: bool = False) -> Column:
    """A bonus where it was asked for and may be; else a penalty that safety `off` lifts."""
    v = 0.05 * F.pow(F.lit(4.0), suggestive - 1)
    return F.when(suggestive >= INNUENDO, 2 * v if asked and not strict else F.lit(0.0) if off else -v).otherwise(0.0)


def lenny_part(lenny: Column, asked: bool = False, allow: bool = False) -> Column:
    return 0.4 * lenny if asked else F.lit(0.0) if allow else -0.15 * lenny


def crude_part(crude: Column, asked: bool = False, allow: bool = False) -> Column:
    return F.when((crude >= CRUDE) & F.lit(not asked and not allow), -0.1).otherwise(0.0)


def structured_weights(structured: bool) -> dict[str, float]:
    """Queries with structure lean on ratings more than on lists."""
    if not structured:
        return dict(WEIGHTS)
    return WEIGHTS | {"emotion": WEIGHTS["emotion"] * 2, "dense": WEIGHTS["dense"] * 0.4, "engine": WEIGHTS["engine"] * 0.4}


def flags(suggestive: Column, lenny: Column, crude: Column, multi: Column, face: Column, length: Column) -> Column:
    """One bit for each name in FLAGS."""
    tests = [suggestive >= INNUENDO, suggestive >= SEXUAL, lenny >= 0.5, crude >= CRUDE, multi > 0.5, face < 0.5, length > LONG_AT]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def top_emotions(names: Sequence[str], r: Column, n: int) -> Column:
    """Names of the n highest ratings, ties by name."""
    pairs = F.arrays_zip(F.transform(r, lambda x: -x).alias("v"), F.array(*map(F.lit, names)).alias("name"))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: x["name"])


def usage_weight(everywhere: Column, for_term: Column) -> Column:
    unit = lambda c: F.coalesce(F.greatest(F.least(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    return (unit(everywhere) + 4 * unit(for_term)) / 5


def squash(weight: Column) -> Column:
    return weight / (weight + 1)
