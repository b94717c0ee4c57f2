"""Exact top-k search with an impact-ordered index, processed score at a time.

Components become integers, floor(256 * x). A block of candidates is indexed as postings (component,
candidate, value) cut into segments by quantised impact, the power of two of the value's size; segments
are processed from the highest impact down, for a block of queries at once. What the segments left out can
still add to a score is at most the product of the query's length and the length of the
candidate's unprocessed rest (Cauchy-Schwarz). Processing stops when that proves that few candidates can
still be among the k best; these are then scored exactly. Without such a proof every segment
is processed, and the scores are exact by themselves.

Queries and candidates meet in blocks of fixed sizes, each row sent to one block of the other kind after
another, so no task holds more than two blocks, and every block hands on k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
FEW = 4
"""A stop is worth while when at most FEW * k candidates of a query are left on average."""


def usable(vector: Column) -> Column:
    """No nulls, no non-finite components, at least one component."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the query, candidate ids and exact scores of every query's k best, ties to
    smaller ids, its own id left out. All arrays hold integers."""
    exact_floats = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1] < 2**53
    if not exact_floats:
        # Python's integers: right for any size, and such sizes are rare.
        scores = queries.astype(object) @ rows.astype(object).T
        return _best(scores, query_ids, ids, np.ones(scores.shape, bool), k)
    q, r = queries.astype(np.float64), rows.astype(np.float64)
    own = query_ids[:, None] == ids[None, :]
    impact = np.frexp(np.abs(r))[1]  # the quantised impact of each posting; 0 for value 0
    impact[r == 0] = 0
    scores = np.zeros((len(q), len(r)))
    rest = r.copy()
    lengths = _lengths(q)
    possible = ~own
    for level in range(int(impact.max(initial=0)), 0, -1):
        segment = np.where(impact == level, r, 0)
        scores += q @ segment.T
        rest[impact == level] = 0
        if not rest.any():
            break
        # A little is added for the rounding of the lengths.
        slack = np.outer(lengths, _lengths(rest)) * (1 + 1e-9) + 1e-6
        low = np.where(own, -np.inf, scores - slack)
        if low.shape[1] > k:
            bar = np.partition(low, low.shape[1] - k, axis=1)[:, -k]
            possible = ~own & (scores + slack >= bar[:, None])
        if possible.sum() <= FEW * k * len(q):
            break
    which, at = np.nonzero(possible)
    scores = np.full(scores.shape, -np.inf)
    for lo in range(0, len(which), 200_000):
        a, b = which[lo : lo + 200_000], at[lo : lo + 200_000]
        scores[a, b] = np.einsum("ij,ij->i", q[a], r[b])
    return _best(scores, query_ids, ids, possible, k)


def _best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, possible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    which, at, best = [], [], []
    for i in range(len(query_ids)):
        c = np.flatnonzero(possible[i] & (ids != query_ids[i]))
        if len(c) > k:
            s = scores[i, c]
            if s.dtype != object:
                c = c[s >= np.partition(s, len(s) - k)[len(s) - k]]
        c = c[np.array(sorted(range(len(c)), key=lambda j: (-scores[i, c[j]], ids[c[j]])), int)][:k] if len(c) else c
        which += [i] * len(c)
        at += ids[c].tolist()
        best += [int(x) for x in scores[i, c]]
    return np.array(which, int), np.array(at, np.int64), np.array(best, object)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: the k best of all other rows.

    Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no
    part. Vectors of other lengths than a query's are not its candidates. Ties go to the smaller
    id; rows with the query's id are never its candidates, rows that repeat an id are
    candidates each, and a query row that repeats asks once. Other columns are ignored."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("v"), F.size("embedding").alias("width"), is_query.alias("is_query")
    )
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).head()
    n_c, n_q = -(-counts["n"] // candidate_block) or 1, -(-counts["q"] // query_block) or 1
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id", F.monotonically_increasing_id() if salt == "c" else F.lit(0)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "v", "width", F.lit(False).alias("asks"), block("c", n_c).alias("cb")).withColumn("qb", every(n_q))
    queries = rows.where("is_query").select("vec_id", "v", "width").distinct().select("vec_id", "v", "width", F.lit(True).alias("asks"), block("q", n_q).alias("qb")).withColumn("cb", every(n_c))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in pdf.groupby("width"):
            asks = same["asks"].to_numpy()
            if asks.any() and not asks.all():
                v, ids = np.stack(same["v"].to_numpy()), same["vec_id"].to_numpy()
                which, found, scores = search_block(v[asks], ids[asks], v[~asks], ids[~asks], k)
                out.append(pd.DataFrame({"query_id": ids[asks][which], "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = candidates.unionByName(queries).groupBy("qb", "cb").applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
