"""Filters, orders, thinning and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard
from .scoring import CRUDE, LONG_AT, SEXUAL

THINNING = {"off": 1.0, "normal": 0.55, "strong": 0.40}
HEAD = 20
"""Thinning looks at this many times the page first."""


def admissible(items: DataFrame, *, strict=False, hide=(), max_len=None, faces_only=False, min_quality=None, least=None, most=None) -> DataFrame:
    """Hard filters; with none nothing is planned, and bounds that contradict each other empty the scan."""
    least, most = least or {}, most or {}
    if any(least[k] > most[k] for k in least.keys() & most.keys()):
        return items.where("false")
    tests: list[Column] = [F.col("r")[i] >= v for i, v in least.items()] + [F.col("r")[i] <= v for i, v in most.items()]
    tests += [F.col("suggestive") < SEXUAL] if strict else []
    tests += [{"lenny": F.col("lenny") < 0.5, "crude": F.col("crude") < CRUDE, "long": F.col("len") <= LONG_AT}[h] for h in hide]
    tests += [F.col("len") <= max_len] if max_len is not None else []
    tests += [F.col("face") >= 0.5] if faces_only else []
    tests += [F.col("quality") >= min_quality] if min_quality is not None else []
    for t in tests:
        items = items.where(t)
    return items


def without(items: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return items.join(ids.select(key).distinct(), key, "left_anti")


def ranked(scored: DataFrame, key: str, by: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """With rank from 0: higher scores first, then smaller keys."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def page(scored: DataFrame, key: str, by: tuple[str, ...] = (), offset: int = 0, limit: int = 10) -> DataFrame:
    return ranked(scored, key, by).where((F.col("rank") >= offset) & (F.col("rank") < offset + limit))


def _fold(items: Column, threshold: float, want: int) -> Column:
    """Keeps an item of an ordered array if it is no more like any kept one than the threshold, until `want` are kept."""
    empty = F.slice(items, 1, 0)
    like = lambda kept, x: F.exists(kept, lambda k: jaccard(k["chars"], x["chars"]) > threshold)
    return F.aggregate(items, empty, lambda kept, x: F.when((F.size(kept) >= want) | like(kept, x), kept).otherwise(F.array_append(kept, x)))


def thinned(scored: DataFrame, key: str, by: tuple[str, ...], thinning: str = "normal", offset: int = 0, limit: int = 10) -> DataFrame:
    """scored(*by, key, score, chars) -> the page of *by, key, score, rank after thinning.

    Only the HEAD of each query's ranking is gathered, HEAD times the page; a query that thinning leaves
    short of its page is thinned again over its whole ranking. The sizes of both arrays follow
    the page and the query, not the number of queries."""
    threshold = THINNING[thinning]
    if threshold >= 1:
        return page(scored, key, by, offset, limit).select(*by, key, "score", "rank")
    want = offset + limit
    order = ranked(scored, key, by)
    item = F.struct(F.col("rank"), F.col(key), F.col("score"), F.col("chars"))

    def folded(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("n")).select(*by, "n", _fold(F.col("items"), threshold, want).alias("kept"))

    head = folded(order.where(F.col("rank") < HEAD * want))
    is_short = (F.size("kept") < want) & (F.col("n") >= HEAD * want)
    short = head.where(is_short)
    again = folded(order.join(short.select(*by), list(by), "left_semi") if by else order.crossJoin(F.broadcast(short.select(F.lit(1).alias("_short")))))  # one row or none
    full = head.join(short.select(*by), list(by), "left_anti") if by else head.where(~is_short)
    rows = full.unionByName(again).select(*by, F.posexplode(F.slice("kept", 1, want)).alias("rank", "k"))
    return rows.where(F.col("rank") >= offset).select(*by, F.col(f"k.{key}").alias(key), F.col("k.score").alias("score"), "rank")


def blended(found: DataFrame, key: str) -> DataFrame:
    """found(qid, completion, key, score): each item's best score less a quarter for each place of the completion."""
    return found.groupBy("qid", key).agg(F.max(F.col("score") - 0.25 * F.col("completion")).alias("score"))


def similar(items: DataFrame, source: DataFrame, key: str, thinning: float = 0.55) -> DataFrame:
    """Items like the source's one row: by ratings, less what differs in multi, cute and suggestive."""
    from .scoring import cosine, norm, quality_part

    s = source.limit(1).select(*[F.col(c).alias(f"s_{c}") for c in ("r", "multi", "cute", "suggestive", "chars", key)])
    both = items.join(F.broadcast(s), F.col(key) != F.col(f"s_{key}"))  # the source is one row
    both = both.where((norm(F.col("r")) > 0) & (norm(F.col("s_r")) > 0) & (jaccard(F.col("chars"), F.col("s_chars")) <= thinning))
    gap = lambda c: F.abs(F.col(c) - F.col(f"s_{c}"))
    score = cosine(F.col("r"), F.col("s_r")) - 0.2 * gap("multi") - 0.1 * gap("cute") - 0.1 * gap("suggestive") + quality_part(F.col("quality")) - 0.4 * F.greatest(1 - F.col("face"), F.lit(0.0))
    return both.withColumn("score", score)
