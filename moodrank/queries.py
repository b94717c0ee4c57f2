"""Queries of the engine's own operators on the driver's tables, each beside SQL for the same rows.

Documents joined with vectors of the same id serve as rated items: 19 vector components as emotions, the next
as attributes. Reals are rounded to six places, every order ends with an id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as tx
from .operators import ranking, reports, scoring, search, state, words
from .plans import reader
from .sources import catalog, compile, config, overlays

PAIR_BLOCK = 512
"""Items that are paired with as many others at once."""

VECTOR_BLOCK = 8192
"""Vectors that are compared with as many others at once."""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("a"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("len"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").withColumnRenamed("quality", "good")
    a = lambda i: F.col("a")[i]
    return d.join(e, "doc_id").join(labels, "doc_id", "left").select(
        "doc_id", "text", "len", F.slice("a", 1, 19).alias("r"), a(20).alias("multi"), a(21).alias("cute"), a(22).alias("intensity"),
        (a(23) * 3).alias("suggestive"), a(24).alias("lenny"), a(25).alias("face"), (1 + 7 * a(26)).alias("quality"), a(27).alias("crude"), F.coalesce("good", F.lit(-1)).alias("good"),
    )


FV = """fv AS (SELECT d.doc_id, d.text, length(d.text) AS len, a[1:19] AS r, a[21] AS multi, a[22] AS cute, a[23] AS intensity, a[24] * 3 AS suggestive,
  a[25] AS lenny, a[26] AS face, 1 + 7 * a[27] AS quality, a[28] AS crude, coalesce(l.quality, -1) AS good
  FROM documents d JOIN (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS a FROM embeddings) e ON d.doc_id = e.vec_id
  LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
P = [round(0.1 - 0.005 * i, 4) for i in range(19)]
PROFILE = f"{[float(p) for p in P]}::DOUBLE[]"
DOT = f"list_sum(list_transform(list_zip({PROFILE}, r), lambda z: z[1] * z[2]))"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}''$]+')"


def profile() -> Column:
    return F.array(*[F.lit(float(p)) for p in P])


# Text functions and ids


@query("SELECT doc_id, ('0x' || substr(sha1(text), 1, 12))::BIGINT AS face_id, 'k' || substr(sha1(text), 1, 12) AS shown FROM documents")
def face_id_sha1(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.face_id(F.col("text")).alias("face_id"), tx.shown_id(F.col("text")).alias("shown"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokenise_docs(spark, d):
    t = read(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(r"SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\S'))), '') AS chars FROM benchmark")
def char_set_docs(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(tx.char_set(F.col("text")), "").alias("chars"))


@query(r"""WITH c AS (SELECT item_id, list_distinct(regexp_extract_all(text, '\S')) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard
FROM c a JOIN c b ON a.item_id < b.item_id WHERE len(list_distinct(list_concat(a.s, b.s))) > 0""")
def jaccard_pairs(spark, d):
    """Every pair of items, block against block."""
    c = read(spark, d, "benchmark").select("item_id", tx.char_set(F.col("text")).alias("s"))
    n = -(-c.count() // PAIR_BLOCK) or 1
    c = c.withColumn("g", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    left = c.select(F.col("item_id").alias("l"), F.col("s").alias("x"), F.col("g").alias("i"), F.explode(F.sequence("g", F.lit(n - 1))).alias("j"))
    right = c.select(F.col("item_id").alias("r"), F.col("s").alias("y"), F.explode(F.sequence(F.lit(0), "g")).alias("i"), F.col("g").alias("j"))
    both = left.join(right, ["i", "j"]).where("(i < j AND l <> r) OR (i = j AND l < r)").where("size(x) + size(y) > 0")
    return both.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), r6(tx.jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


@query("""WITH c AS (SELECT conv_id, turn, string_split(text, '') AS s FROM conversations)
SELECT conv_id, turn,
  md5(array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: i < 3 OR s[i] <> s[i - 1] OR s[i] <> s[i - 2]), lambda i: s[i]), '')) AS two,
  md5(array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: i < 2 OR s[i] <> s[i - 1]), lambda i: s[i]), '')) AS one FROM c""")
def stretch_forms(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(tx.squeezed_to_two(F.col("text"))).alias("two"), F.md5(tx.squeezed_to_one(F.col("text"))).alias("one"))


@query("""SELECT page_id, row_number() OVER (ORDER BY length(html), page_id)::BIGINT - 1 AS rank,
  round(1 - 0.001 * (row_number() OVER (ORDER BY length(html), page_id) - 1), 6)::DOUBLE AS score FROM pages WHERE contains(html, '<p') ORDER BY length(html), page_id LIMIT 50""")
def glyph_substring(spark, d):
    """The 50 shortest pages that hold a string, as a pasted symbol finds items."""
    p = read(spark, d, "pages").where(F.contains("html", F.lit("<p"))).select("page_id", F.length("html").alias("len"))
    top = p.orderBy("len", "page_id").limit(50)  # a page: the window sees 50 rows
    rank = F.row_number().over(Window.orderBy("len", "page_id")).cast("long") - 1
    return top.select("page_id", rank.alias("rank")).withColumn("score", r6(1 - F.col("rank") * F.lit(0.001)))


GLYPHY = ["!!", "...", "a.b", "$5", "½", "ok!", "huh?!", "naïve", "don't", "so-so", "(╯°□°)", "two words", "寒い", "10"]
"""Short texts beside those of the conversations: end marks alone, symbols inside, digits that are no ASCII, plain words."""


@query(r"""WITH t AS (SELECT 'c' || conv_id || '/' || turn AS key, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'x' || text, text FROM (SELECT unnest({}) AS text)),
b AS (SELECT key, CASE WHEN regexp_replace(text, '[!?.,;:]+$', '') = '' THEN text ELSE regexp_replace(text, '[!?.,;:]+$', '') END AS text FROM t)
SELECT key, regexp_matches(text, '[^\p{{L}}\p{{M}}\p{{N}}\s''-]') OR regexp_matches(text, '[^\x00-\x7F\p{{L}}\p{{M}}]') AS glyphy FROM b""".format([x.replace("'", "’’") for x in GLYPHY]).replace("’’", "''").replace('"', "'"))
def is_glyphy_flag(spark, d):
    c = read(spark, d, "conversations").where("text IS NOT NULL").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("key"), "text")
    x = spark.range(1).select(F.explode(F.array(*map(F.lit, GLYPHY))).alias("text")).select(F.concat(F.lit("x"), "text").alias("key"), "text")
    return c.unionByName(x).select("key", tx.is_glyphy(F.col("text")).alias("glyphy"))


@query("SELECT conv_id, turn, substr(sha1(coalesce(role, '') || chr(0) || substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 256) || chr(0) || 's'), 1, 16) AS key FROM conversations")
def report_key_sha1(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.report_key(F.coalesce("role", F.lit("")), tx.cut(tx.collapsed(F.col("text"))), F.lit("s")).alias("key"))


# Filters


@query(f"""WITH {FV} SELECT doc_id, ((suggestive >= 0.5)::INT * 1 + (suggestive >= 1.5)::INT * 2 + (lenny >= 0.5)::INT * 4 + (crude >= 0.5)::INT * 8
  + (multi > 0.5)::INT * 16 + (face < 0.5)::INT * 32 + (len > 14)::INT * 64)::INT AS flags FROM fv""")
def flags_bitmask(spark, d):
    c = lambda n: F.col(n)
    return items(spark, d).select("doc_id", scoring.flags(c("suggestive"), c("lenny"), c("crude"), c("multi"), c("face"), c("len")).alias("flags"))


@query(f"""WITH {FV}, x AS (SELECT doc_id, unnest(r) AS v, unnest({scoring.EMOTIONS}) AS name FROM fv),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, name) AS n FROM x)
SELECT doc_id, string_agg(name, ',' ORDER BY n) AS top FROM k WHERE n <= 3 GROUP BY doc_id""")
def top_emotions(spark, d):
    return items(spark, d).select("doc_id", F.array_join(scoring.top_emotions(scoring.EMOTIONS, F.col("r"), 3), ",").alias("top"))


@query(f"WITH {FV} SELECT doc_id, len FROM fv WHERE suggestive < 1.5 AND lenny < 0.5 AND len <= 5000 AND face >= 0.5 AND quality >= 4 AND r[1] >= 0.4 AND r[11] <= 0.6")
def hard_filters(spark, d):
    kept = ranking.admissible(items(spark, d), strict=True, hide=("lenny",), max_len=5000, faces_only=True, min_quality=4, least={0: 0.4}, most={10: 0.6})
    return kept.select("doc_id", "len")


@query(f"WITH {FV} SELECT doc_id, len FROM fv WHERE false")
def contradiction_empty(spark, d):
    return ranking.admissible(items(spark, d), least={0: 0.9}, most={0: 0.1}).select("doc_id", "len")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def blocklist_anti(spark, d):
    return ranking.without(read(spark, d, "documents"), read(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def selection_semi(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


# Lists, postings and credits


POSTINGS = f"""t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM t),
postings AS (SELECT word, doc_id, (2 - least(min(pos), 2))::INT AS tier FROM w GROUP BY word, doc_id)"""


def doc_postings(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    return state.postings(read(spark, d, "documents"), "doc_id", tx.tokens(F.col("text")), only)


@query(f"WITH {POSTINGS} SELECT word, count(*)::BIGINT AS n, min(doc_id) AS first_doc, sum(tier)::BIGINT AS tiers FROM postings GROUP BY word")
def postings_build(spark, d):
    return doc_postings(spark, d).groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.sum("tier").alias("tiers"))


QWORDS = f"q AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS.format('text')}) AS word FROM benchmark)"


def query_words(spark: SparkSession, d: str) -> DataFrame:
    """All words of each benchmark text."""
    words = tx.tokens(F.col("text"))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(words).alias("word")).where(F.length("word") >= 2).distinct()


LEXICAL = f"""{POSTINGS}, {QWORDS}, credit AS (SELECT q.qid, p.doc_id AS item, max([0.5, 0.8, 1.0][p.tier + 1])::DOUBLE AS credit
  FROM q JOIN postings p ON p.word = q.word WHERE length(q.word) >= 2 GROUP BY q.qid, p.doc_id)"""


@query(f"WITH {LEXICAL} SELECT qid, item, credit FROM credit")
def lexical_credit(spark, d):
    asked = query_words(spark, d)
    return scoring.lexical_credit(asked, doc_postings(spark, d, asked).withColumnRenamed("doc_id", "item"))


NEIGHBOURS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sim AS (SELECT a.vec_id AS term, b.vec_id AS item, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
lists AS (SELECT term, (row_number() OVER (PARTITION BY term ORDER BY c DESC, item) - 1)::INT AS rank, item FROM sim QUALIFY rank < 32)"""


def nearest(terms: np.ndarray, t: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """Unit vectors t of the terms against v of the ids, which ascend: the k best of each, ties to smaller ids."""
    out = []
    for lo in range(0, len(terms), 256):
        score = np.round(t[lo : lo + 256] @ v.T, 6)
        score[terms[lo : lo + 256, None] == ids[None, :]] = -np.inf
        bar = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
        for term, s, least in zip(terms[lo : lo + 256], score, bar):
            at = np.flatnonzero((s >= least) & (s > -np.inf))
            at = at[np.argsort(-s[at], kind="stable")][:k]
            out.append(pd.DataFrame({"term": term, "item": ids[at], "score": s[at]}))
    return pd.concat(out)


def neighbours(spark: SparkSession, d: str, k: int = 32) -> DataFrame:
    """Every vector's list of its k nearest others, block against block. Vectors without a direction take no part."""
    v = read(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding", F.size("embedding").alias("width"))
    n = -(-v.count() // VECTOR_BLOCK) or 1
    v = v.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    # Each pair of blocks once, for the lists of both.
    pairs = v.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("vec_id", "embedding", "width", "g", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        e = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        length = np.sqrt((e * e).sum(axis=1))
        able = (length > 0) & np.isfinite(length)
        e, ids, g = e[able] / length[able, None], pdf["vec_id"].to_numpy()[able], pdf["g"].to_numpy()[able]
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = [(g == i, g == j)] + ([(g == j, g == i)] if i != j else [])
        found = [nearest(ids[x], e[x], ids[y], e[y], k) for x, y in sides if x.any() and y.any()]
        return pd.concat(found) if found else pd.DataFrame({"term": [], "item": [], "score": []})

    found = pairs.groupBy("width", "i", "j").applyInPandas(run, "term long, item long, score double")
    return ranking.page(found, "item", ("term",), 0, k).select("term", "rank", "item")


@query(f"WITH {NEIGHBOURS} SELECT * FROM lists")
def dense_topk_lists(spark, d):
    """Lists of all vectors."""
    return neighbours(spark, d)


@query(f"""WITH {NEIGHBOURS}, t AS (SELECT c_custkey % 8 AS qid, c_custkey AS term, 0.5 + (c_custkey % 2) * 0.5 AS weight, c_custkey % 5 = 0 AS negated FROM customer),
l AS (SELECT * FROM t WHERE NOT negated AND term IN (SELECT term FROM lists)), s AS (SELECT qid, sum(weight)::DOUBLE AS whole FROM l GROUP BY qid)
SELECT l.qid, lists.item, round(sum(l.weight::DOUBLE / (1 + lists.rank::DOUBLE / 10)) / any_value(s.whole), 6) AS credit
FROM l JOIN lists ON l.term = lists.term JOIN s ON s.qid = l.qid GROUP BY l.qid, lists.item""")
def dense_credit(spark, d):
    """All customers as terms, with the lists of all vectors."""
    key = F.col("c_custkey")
    terms = read(spark, d, "customer").select((key % 8).alias("qid"), key.alias("term"), (0.5 + (key % 2) * 0.5).alias("weight"), (key % 5 == 0).alias("negated"))
    return scoring.list_credit(terms, neighbours(spark, d)).withColumn("credit", r6(F.col("credit")))


# Scores


@query(f"""WITH {FV} SELECT doc_id, round({DOT}, 6) AS dot,
  round(list_cosine_similarity({PROFILE}, r), 6) AS cosine, round(1 - {DOT}, 6) AS negated FROM fv""")
def emotion_dot(spark, d):
    r = F.col("r")
    return items(spark, d).select("doc_id", r6(scoring.dot(profile(), r)).alias("dot"), r6(scoring.cosine(profile(), r)).alias("cosine"), r6(scoring.term_score(profile(), r, negated=True)).alias("negated"))


TARGET = f"list_sum(list_transform(list_zip({PROFILE}, r), lambda z: CASE WHEN z[2] < 0.08 THEN 0 ELSE z[1] * (1 - abs(z[2] - 0.35)) END))"


@query(f"WITH {FV} SELECT doc_id, round({TARGET}, 6) AS score FROM fv")
def term_target_score(spark, d):
    return items(spark, d).select("doc_id", r6(scoring.term_score(profile(), F.col("r"), F.lit(0.35))).alias("score"))


@query(f"""WITH {FV} SELECT doc_id, round(least(r[1], r[4], r[9]), 6) AS least_, round((r[1] + r[4] + r[9]) / 3, 6) AS mean_,
  round(least(r[1], r[4]) + 0.4 * 0.5 * r[9], 6) AS adverb FROM fv""")
def min_vs_mean_terms(spark, d):
    a, b, c = (F.col("r")[i] for i in (0, 3, 8))
    return items(spark, d).select(
        "doc_id", r6(scoring.combined([a, b, c])).alias("least_"), r6(scoring.combined([a, b, c], sentence=True)).alias("mean_"), r6(scoring.combined([a, b], [(c, 0.5)])).alias("adverb")
    )


@query(f"""WITH {FV} SELECT doc_id, round(CASE WHEN multi > 0.5 THEN -0.35 ELSE 0.05 END, 6)::DOUBLE AS single, round(0.3 * (2 * multi - 1), 6) AS pair,
  round(CASE WHEN multi > 0.5 THEN -0.08 ELSE 0 END, 6)::DOUBLE AS plain, round(0.15 * 0.5 * (2 * multi - 1), 6) AS preferred FROM fv""")
def figures_adjust(spark, d):
    m = F.col("multi")
    half = scoring.figure_preference(F.lit(0.45))
    parts = {"single": scoring.figures_part(m, "single"), "pair": scoring.figures_part(m, "pair"), "plain": scoring.figures_part(m), "preferred": scoring.figures_part(m, None, half)}
    return items(spark, d).select("doc_id", *[r6(c).alias(n) for n, c in parts.items()])


ADJUST = {
    "quality_part": "0.06 * greatest(least((quality - 5) / 3, 1), -1)",
    "length_part": "(0 - least(0.012 * greatest(len - 14, 0), 0.2))::DOUBLE",
    "suggestive_part": "CASE WHEN suggestive >= 0.5 THEN -0.05 * pow(4, suggestive - 1) ELSE 0 END",
    "lenny_part": "-0.15 * lenny",
    "crude_part": "CASE WHEN crude >= 0.5 THEN -0.1 ELSE 0 END::DOUBLE",
    "face_part": "-0.4 * greatest(1 - face, 0)",
}


def adjustments() -> dict[str, Column]:
    c = F.col
    return {
        "quality_part": scoring.quality_part(c("quality")),
        "length_part": scoring.length_part(c("len")),
        "suggestive_part": scoring.suggestive_part(c("suggestive")),
        "lenny_part": scoring.lenny_part(c("lenny")),
        "crude_part": scoring.crude_part(c("crude")),
        "face_part": -0.4 * F.greatest(1 - c("face"), F.lit(0.0)),
    }


@query(f"WITH {FV} SELECT doc_id, {', '.join(f'round({v}, 6) AS {k}' for k, v in ADJUST.items())} FROM fv")
def score_adjustments(spark, d):
    return items(spark, d).select("doc_id", *[r6(c).alias(n) for n, c in adjustments().items()])


SCORED = f"""{FV}, scored AS (SELECT *, 0.5 * {DOT} AS emotion_part, 0.06 * 0 + 0.15 * intensity AS high_part,
  {', '.join(f'{v} AS {k}' for k, v in ADJUST.items())} FROM fv),
total AS (SELECT *, emotion_part + high_part + {' + '.join(ADJUST)} AS score FROM scored)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    parts = {"emotion_part": 0.5 * scoring.term_score(profile(), F.col("r")), "high_part": 0.15 * F.col("intensity"), **adjustments()}
    return items(spark, d).withColumns(parts).withColumn("score", sum((F.col(p) for p in list(parts)[1:]), F.col("emotion_part")))


@query(f"WITH {SCORED} SELECT doc_id, round(emotion_part, 6) AS emotion_part, round(high_part, 6) AS high_part, {', '.join(f'round({k}, 6) AS {k}' for k in ADJUST)}, round(score, 6) AS score FROM total")
def full_score_why(spark, d):
    s = scored(spark, d)
    return s.select("doc_id", *[r6(F.col(c)).alias(c) for c in ["emotion_part", "high_part", *ADJUST, "score"]])


@query(f"WITH {SCORED} SELECT doc_id, (row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1)::INT AS rank, round(score, 6) AS score FROM total QUALIFY rank < 30")
def rank_topk(spark, d):
    top = scored(spark, d).select("doc_id", r6(F.col("score")).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(30)
    return ranking.page(top, "doc_id", (), 0, 30)


@query(f"WITH {SCORED}, k AS (SELECT doc_id, good, (row_number() OVER (PARTITION BY good ORDER BY round(score, 6) DESC, doc_id) - 1)::INT AS rank, round(score, 6) AS score FROM total) SELECT * FROM k WHERE rank >= 5 AND rank < 12")
def rank_paged(spark, d):
    return ranking.page(scored(spark, d).select("doc_id", "good", r6(F.col("score")).alias("score")), "doc_id", ("good",), 5, 7)


@query(r"""WITH RECURSIVE c AS (SELECT item_id % 4 AS qid, item_id, list_distinct(regexp_extract_all(text, '\S')) AS s, (row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id % 7 DESC, item_id))::INT AS n FROM benchmark),
f(qid, n, kept) AS (SELECT DISTINCT qid, 0, []::STRUCT(id BIGINT, s VARCHAR[])[] FROM c UNION ALL
  SELECT f.qid, c.n, CASE WHEN len(list_filter(f.kept, lambda k: len(list_intersect(k.s, c.s))::DOUBLE / len(list_distinct(list_concat(k.s, c.s))) > 0.55)) > 0 THEN f.kept
    ELSE list_append(f.kept, {'id': c.item_id, 's': c.s}) END FROM f JOIN c ON c.qid = f.qid AND c.n = f.n + 1),
l AS (SELECT qid, arg_max(kept, n) AS kept FROM f GROUP BY qid), u AS (SELECT qid, unnest(kept) AS k, unnest(range(len(kept)))::INT AS rank FROM l)
SELECT qid, k.id AS item_id, rank, (k.id % 7)::DOUBLE AS score FROM u WHERE rank < 5""")
def greedy_thin(spark, d):
    b = read(spark, d, "benchmark")
    rows = b.select((F.col("item_id") % 4).alias("qid"), "item_id", (F.col("item_id") % 7).cast("double").alias("score"), tx.char_set(F.col("text")).alias("chars"))
    return ranking.thinned(rows, "item_id", ("qid",), "normal", 0, 5)


@query(f"""WITH {FV}, s AS (SELECT * FROM fv WHERE doc_id = 0)
SELECT fv.doc_id, round(list_cosine_similarity(fv.r, s.r) - 0.2 * abs(fv.multi - s.multi) - 0.1 * abs(fv.cute - s.cute) - 0.1 * abs(fv.suggestive - s.suggestive)
  + 0.06 * greatest(least((fv.quality - 5) / 3, 1), -1) - 0.4 * greatest(1 - fv.face, 0), 6) AS score FROM fv, s WHERE fv.doc_id <> 0""")
def cosine_similar(spark, d):
    fv = items(spark, d).withColumn("chars", F.array(F.col("doc_id").cast("string")))
    return ranking.similar(fv, fv.where("doc_id = 0"), "doc_id").select("doc_id", r6(F.col("score")).alias("score"))


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, p_size % 3 AS completion, p_partkey FROM part)
SELECT (p_partkey % 16)::BIGINT AS qid, word, max(length(word) - 0.25 * completion)::DOUBLE AS score FROM v GROUP BY 1, 2""")
def blend_completions(spark, d):
    v = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"), (F.col("p_size") % 3).alias("completion"), (F.col("p_partkey") % 16).alias("qid"))
    return ranking.blended(v.withColumn("score", F.length("word").cast("double")), "word")


# Words


VOCAB = "vocab AS (SELECT word AS key, count(*)::BIGINT AS n, (count(*) % 3)::INT AS tier FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part) WHERE length(word) >= 2 GROUP BY word)"


def vocab(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("key")).where(F.length("key") >= 2)
    return words.groupBy("key").agg(F.count("*").alias("n")).withColumn("tier", (F.col("n") % 3).cast("int"))


@query(f"WITH {VOCAB}, p AS (SELECT DISTINCT substr(key, 1, 2) AS prefix FROM vocab), k AS (SELECT prefix, key, tier, n, (row_number() OVER (PARTITION BY prefix ORDER BY tier DESC, n DESC, key))::INT AS place FROM p JOIN vocab ON starts_with(key, prefix)) SELECT * FROM k WHERE place <= 5")
def complete_prefix(spark, d):
    v = vocab(spark, d).withColumn("pinned", F.lit(False))
    return words.completions(v.select(F.substring("key", 1, 2).alias("prefix")), v, 5)


@query(f"""WITH {VOCAB}, t AS (SELECT key AS meant, substr(key, 1, 2) || substr(key, 4) AS typed FROM vocab WHERE length(key) >= 6),
c AS (SELECT t.meant, t.typed, v.key, damerau_levenshtein(t.typed, v.key)::INT AS edits, v.tier, v.n FROM t JOIN vocab v ON abs(length(v.key) - length(t.typed)) <= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY meant ORDER BY edits, tier DESC, n DESC, key) AS place FROM c WHERE edits <= 1)
SELECT meant, typed, key, edits FROM k WHERE place = 1""")
def spell_correct(spark, d):
    """Words without their third letter, against the vocabulary: at most one edit, where all edit distances agree."""
    v = vocab(spark, d)
    typed = v.where(F.length("key") >= 6).select(F.col("key").alias("meant"), F.concat(F.substring("key", 1, 2), F.substring("key", 4, 1000)).alias("typed"))
    found = words.corrections(typed.select("typed"), v.withColumn("tier", F.col("tier") + 1), alone=False)
    return typed.join(found, "typed").select("meant", "typed", "key", "edits")


@query()
def spell_correct_far(spark, d):
    """Words without their third letter and with their last two swapped, against the vocabulary: up to three edits."""
    v = vocab(spark, d).withColumn("tier", F.col("tier") + 1)
    wrong = F.concat(F.substring("key", 1, 2), F.expr("substring(key, 4, length(key) - 5)"), F.right("key", F.lit(1)), F.expr("substring(key, length(key) - 1, 1)"))
    return words.corrections(v.where(F.length("key") >= 8).select(wrong.alias("typed")), v)


SUFFIXES = reader.SUFFIXES


@query(f"""WITH {VOCAB}, w AS (SELECT key || suffix AS word FROM vocab, (SELECT unnest({SUFFIXES}) AS suffix) WHERE length(key) >= 4),
k AS (SELECT w.word, v.key, row_number() OVER (PARTITION BY w.word ORDER BY length(v.key) DESC) AS place FROM (SELECT DISTINCT word FROM w) w JOIN vocab v
  ON starts_with(w.word, v.key) AND length(w.word) >= 5 AND length(v.key) >= 4 AND substr(w.word, length(v.key) + 1) IN (SELECT unnest({SUFFIXES})) AND (substr(w.word, length(v.key) + 1) <> 'y' OR v.tier <> 0))
SELECT word, key FROM k WHERE place = 1""")
def stem_suffix(spark, d):
    v = vocab(spark, d)
    typed = v.where(F.length("key") >= 4).select(F.explode(F.array(*[F.concat("key", F.lit(x)) for x in SUFFIXES])).alias("word")).distinct()
    return words.stems(typed, v)


# Tables and overlays


@query("""WITH k AS (SELECT p_brand AS term, p_name AS face, min(p_partkey) AS seq, max(p_size) AS rank_ FROM part GROUP BY 1, 2),
r AS (SELECT term, face, (row_number() OVER (PARTITION BY term ORDER BY rank_ DESC, seq, face))::INT AS place FROM k) SELECT * FROM r WHERE place <= 3""")
def canonical_top3(spark, d):
    p = read(spark, d, "part").groupBy(F.col("p_brand").alias("term"), F.col("p_name").alias("face")).agg(F.min("p_partkey").alias("seq"), F.max("p_size").alias("rank_"))
    order = Window.partitionBy("term").orderBy(F.col("rank_").desc(), "seq", "face")
    return p.withColumn("place", F.row_number().over(order).cast("int")).where("place <= 3").select("term", "face", "place")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS boost, max(event_id) AS seq FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type")
def boost_last_wins(spark, d):
    e = read(spark, d, "events").where("value IS NOT NULL")
    return state.newest(e.select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", F.col("value").alias("boost"), F.col("event_id").alias("seq"))


@query("""WITH p AS (SELECT l_partkey % 200 AS term, l_linenumber AS layer, (l_quantity)::INT AS rank, l_orderkey AS seq, l_suppkey AS face, l_returnflag = 'R' AND l_linenumber < 3 AND l_orderkey % 7 = 0 AS clear FROM lineitem),
c AS (SELECT term, max(layer) AS cut FROM p WHERE clear GROUP BY term),
l AS (SELECT p.* FROM p LEFT JOIN c ON p.term = c.term WHERE NOT clear AND (c.cut IS NULL OR layer > c.cut)),
o AS (SELECT term, face, min((-layer, rank, seq)) AS place_ FROM l GROUP BY term, face),
r AS (SELECT term, face, (row_number() OVER (PARTITION BY term ORDER BY place_, face))::INT AS place FROM o) SELECT * FROM r WHERE place <= 3""")
def pin_layers(spark, d):
    c = F.col
    clear = (c("l_returnflag") == "R") & (c("l_linenumber") < 3) & (c("l_orderkey") % 7 == 0)
    pins = read(spark, d, "lineitem").select((c("l_partkey") % 200).alias("term"), c("l_linenumber").alias("layer"), c("l_quantity").cast("int").alias("rank"), c("l_orderkey").alias("seq"), c("l_suppkey").alias("face"), clear.alias("clear"))
    return state.layered_pins(pins)


@query("""WITH RECURSIVE a AS (SELECT n_nationkey AS old, n_nationkey + 5 AS new FROM nation),
c(old, final, hops) AS (SELECT old, new, 1 FROM a UNION ALL SELECT c.old, a.new, hops + 1 FROM c JOIN a ON a.old = c.final)
SELECT old, arg_max(final, hops)::INT AS final, max(hops)::INT AS hops FROM c GROUP BY old""")
def alias_chain(spark, d):
    n = read(spark, d, "nation")
    return state.chains(n.select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 5).alias("new")))


@query("""WITH k AS (SELECT 1 AS section, c_custkey AS face, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer QUALIFY n <= 20
  UNION ALL SELECT 2, user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) AS n FROM events GROUP BY user_id QUALIFY n <= 40
  UNION ALL SELECT 3, s_suppkey, row_number() OVER (ORDER BY s_suppkey) FROM supplier),
f AS (SELECT face, min((section, n)) AS place_ FROM k GROUP BY face)
SELECT face, (row_number() OVER (ORDER BY place_, face) - 1)::INT AS rank FROM f QUALIFY rank < 100""")
def browse_sections(spark, d):
    """First 20 of one order, 40 by use, then all: each item at its first place, a page of 100."""

    def section(i: int, rows: DataFrame, order: list[Column], most: int) -> DataFrame:
        top = rows.orderBy(*order).limit(most)  # at most a page, so one window's rows are few
        return top.select(F.lit(i).alias("section"), F.col("face").cast("long").alias("face"), F.row_number().over(Window.orderBy(*order)).alias("n"))

    first = section(1, read(spark, d, "customer").select(F.col("c_custkey").alias("face"), "c_acctbal"), [F.col("c_acctbal").desc(), F.col("face")], 20)
    used = read(spark, d, "events").groupBy(F.col("user_id").alias("face")).agg(F.count("*").alias("used"))
    second = section(2, used, [F.col("used").desc(), F.col("face")], 40)
    third = section(3, read(spark, d, "supplier").select(F.col("s_suppkey").alias("face")), [F.col("face")], 160)
    once = first.union(second).union(third).groupBy("face").agg(F.min(F.struct("section", "n")).alias("at"))
    top = once.orderBy("at", "face").limit(100)
    return top.select("face", (F.row_number().over(Window.orderBy("at", "face")) - 1).cast("int").alias("rank"))


@query("SELECT c_custkey, least((c_custkey % 9)::INT, 3) AS innuendo, CASE WHEN c_mktsegment = 'BUILDING' THEN 'hide' ELSE 'allow' END AS crude, c_mktsegment = 'BUILDING' OR c_custkey % 9 > 3 AS clamped FROM customer")
def policy_clamp_batch(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 9).cast("int").alias("innuendo"), F.lit("allow").alias("crude"), (F.col("c_mktsegment") == "BUILDING").alias("locked"))
    return config.clamped_rows(rows, ceilings={"innuendo": 3}, locks={"crude": ("locked", "hide")}).select("c_custkey", "innuendo", "crude", "clamped")


@query("""WITH k AS (SELECT user_id, event_type, value, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS layer FROM events WHERE value IS NOT NULL)
SELECT user_id, arg_max(value, (layer, event_id)) AS value, arg_max(event_type, (layer, event_id)) AS origin FROM k GROUP BY user_id""")
def config_layers(spark, d):
    layers = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
    e = read(spark, d, "events").where("value IS NOT NULL").withColumn("layer", F.create_map(*[F.lit(x) for kv in layers.items() for x in kv])[F.col("event_type")])
    return state.newest(e.select("user_id", "value", "event_type", "layer", "event_id"), ["user_id"], ["layer", "event_id"]).select("user_id", "value", F.col("event_type").alias("origin"))


# Usage and reports


NOW = "TIMESTAMP '2030-01-01 00:00:00'"


@query(f"SELECT user_id, event_type, round(sum(pow(0.5, date_diff('microsecond', ts, {NOW}) / 1e6 / (86400 * 365))), 6) AS weight FROM events GROUP BY user_id, event_type HAVING sum(pow(0.5, date_diff('microsecond', ts, {NOW}) / 1e6 / (86400 * 365))) >= 0.001")
def usage_decay(spark, d):
    return state.decayed(read(spark, d, "events"), ["user_id", "event_type"], F.col("ts"), F.expr(NOW), 86400 * 365).withColumn("weight", r6(F.col("weight")))


@query("""WITH g AS (SELECT user_id, count(*)::DOUBLE AS g, count(*) FILTER (event_type = 'click')::DOUBLE AS t FROM events GROUP BY user_id)
SELECT user_id, round((least(g / (g + 1), 1) + 4 * least(t / (t + 1), 1)) / 5, 6) AS weight, round(0.15 * (least(g / (g + 1), 1) + 4 * least(t / (t + 1), 1)) / 5, 6) AS lift FROM g""")
def usage_squash_lift(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("g"), F.count_if(F.col("event_type") == "click").cast("double").alias("t"))
    w = scoring.usage_weight(scoring.squash(F.col("g")), scoring.squash(F.col("t")))
    return g.select("user_id", r6(w).alias("weight"), r6(scoring.USAGE_LIFT["normal"] * w).alias("lift"))


@query("SELECT user_id, event_type, count(*)::DOUBLE AS weight FROM events GROUP BY user_id, event_type ORDER BY weight DESC, event_type NULLS FIRST, user_id LIMIT 200")
def usage_prune(spark, d):
    w = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").cast("double").alias("weight"))
    return state.pruned(w, 200, ["event_type", "user_id"])


@query("""WITH c AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT week, event_type, CASE WHEN n >= 20 THEN '20+' WHEN n >= 5 THEN '5-19' WHEN n >= 2 THEN '2-4' ELSE '1' END AS bucket, count(*)::BIGINT AS keys FROM c GROUP BY ALL""")
def tally_buckets(spark, d):
    c = read(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type", "user_id").agg(F.count("*").alias("n"))
    return c.groupBy("week", "event_type", state.bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("keys"))


@query("""WITH f AS (SELECT user_id, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) = 1 AS w,
  row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) = 1 AS m FROM events)
SELECT day::DATE AS day, count(*)::BIGINT AS uploads, count(*) FILTER (w)::BIGINT AS first_week, count(*) FILTER (m)::BIGINT AS first_month FROM f GROUP BY day""")
def active_day_week_month(spark, d):
    first = lambda unit: F.row_number().over(Window.partitionBy("user_id", F.date_trunc(unit, "ts")).orderBy("ts", "event_id")) == 1
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), first("week").alias("w"), first("month").alias("m"))
    return e.groupBy("day").agg(F.count("*").alias("uploads"), F.count_if("w").alias("first_week"), F.count_if("m").alias("first_month"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(CASE WHEN n >= 20 THEN 25 WHEN n >= 5 THEN 10 WHEN n >= 2 THEN 3 ELSE 1 END)::BIGINT AS picks FROM c GROUP BY user_id ORDER BY picks DESC, user_id LIMIT 20""")
def most_picked_estimate(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.sum(state.estimated(state.bucket(F.col("n")))).alias("picks")).orderBy(F.col("picks").desc(), "user_id").limit(20)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey")
def pending_latest_per_key(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return state.newest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def pending_anti_sent(spark, d):
    sent = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.unsent(read(spark, d, "orders"), sent, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_hour(spark, d):
    e = read(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return e.where("n > 1").select("user_id", "hour", "n")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, (turn, role)) AS role FROM conversations GROUP BY conv_id")
def supersede_channel(spark, d):
    return state.newest(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"])


@query("WITH m AS (SELECT max(ts) - INTERVAL 2 MINUTE AS ready FROM events) SELECT event_id, user_id FROM events, m WHERE ts <= ready AND ts > ready - INTERVAL 30 DAY")
def settle_ready(spark, d):
    e = read(spark, d, "events")
    ready = e.agg((F.max("ts") - F.expr("INTERVAL 2 MINUTES")).alias("ready"))  # one row
    return e.join(F.broadcast(ready), (F.col("ts") <= F.col("ready")) & (F.col("ts") > F.col("ready") - F.expr("INTERVAL 30 DAYS"))).select("event_id", "user_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL AS invalid FROM events")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return read(spark, d, "events").select("event_id", k.alias("k"), k.isNull().alias("invalid"))


@query("SELECT vec_id, greatest(least(floor((embedding[1]::DOUBLE + 1) / 2 * 256), 255), 0)::INT AS bin, round((greatest(least(floor((embedding[1]::DOUBLE + 1) / 2 * 256), 255), 0) + 0.5) / 256, 6)::DOUBLE AS value FROM embeddings")
def quantise_bins(spark, d):
    x = (F.col("embedding")[0].cast("double") + 1) / 2
    bin_ = F.greatest(F.least(F.floor(x * 256), F.lit(255)), F.lit(0)).cast("int")
    return read(spark, d, "embeddings").select("vec_id", bin_.alias("bin"), r6((bin_ + 0.5) / 256).alias("value"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query()
def checksum_table(spark, d):
    """Rows and checksum of every table; the same for the same rows in any order, and equal rows count each."""
    parts = [catalog.checksum_row(read(spark, d, t)).select(F.lit(t).alias("name"), "rows", "checksum") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def jitter_variety(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.jitter(F.lit(7).cast("long"), tx.face_id(F.col("text"))).alias("jitter"))


@query(f"""WITH {LEXICAL}, s AS (SELECT c.qid, c.item AS doc_id, round(0.2 * c.credit + CASE l.quality WHEN 1 THEN 0.06 WHEN 0 THEN -0.06 ELSE 0 END, 6)::DOUBLE AS score FROM credit c LEFT JOIN labels l ON l.doc_id = c.item)
SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM s QUALIFY rank < 5""")
def search_batch(spark, d):
    """Every benchmark item as a query against all documents: the best five of each."""
    return flagship(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    asked = query_words(spark, d)
    credit = scoring.lexical_credit(asked, doc_postings(spark, d, asked).withColumnRenamed("doc_id", "item")).withColumnRenamed("item", "doc_id")
    labels = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.06).when(F.col("quality") == 0, -0.06).otherwise(0.0).alias("good"))
    rows = credit.join(labels, "doc_id", "left").withColumn("score", r6(scoring.WEIGHTS["lexical"] * F.col("credit") + F.coalesce("good", F.lit(0.0))))
    return ranking.page(rows, "doc_id", ("qid",), 0, 5).select("qid", "doc_id", "score", "rank")


@query()
def read_queries(spark, d):
    """What the query reader makes of each benchmark text, a batch at a time on the executors."""
    return reader.read_batch(read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), reader.SMALL)


# Catalog operators


ROUNDED = ", ".join(f"round(r[{i + 1}], 3) AS {e}" for i, e in enumerate(scoring.EMOTIONS[:5]))


@query(f"""WITH {FV} SELECT doc_id, {ROUNDED}, round(quality, 2) AS quality, round(multi, 3) AS multi, array_to_string(list_filter([
  CASE WHEN suggestive >= 0.5 THEN 'suggestive' END, CASE WHEN suggestive >= 1.5 THEN 'explicit' END, CASE WHEN lenny >= 0.5 THEN 'lenny' END, CASE WHEN crude >= 0.5 THEN 'crude' END, CASE WHEN multi > 0.5 THEN 'multi' END,
  CASE WHEN face < 0.5 THEN 'not_face' END, CASE WHEN len > 14 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS flags FROM fv""")
def entry_shape(spark, d):
    """Items as a search sends them: named emotions to three places, quality to two, names of flags."""
    rows = items(spark, d).withColumns({"score": F.lit(0.0), "rank": F.lit(0), "pinned": F.lit(False), "canonical_for": F.array().cast("array<string>"), "qid": F.col("doc_id")})
    shaped, _ = search.shaped(rows, scoring.EMOTIONS, ["flags", "emotions_all", "quality", "attrs"])
    return shaped.select(F.col("qid").alias("doc_id"), *[F.col("emotions_all")[e].alias(e) for e in scoring.EMOTIONS[:5]], "quality", F.col("attrs.multi").alias("multi"), F.array_join("flags", ",").alias("flags"))


@query("SELECT l_suppkey AS face, array_to_string(list_sort(list_distinct(list('t' || (l_partkey % 50)))), ',') AS concepts FROM lineitem GROUP BY l_suppkey")
def canonical_for_index(spark, d):
    pins = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("face_id"), F.concat(F.lit("t"), F.col("l_partkey") % 50).alias("term"))
    return search.canonical_for(pins).select(F.col("face_id").alias("face"), F.array_join("canonical_for", ",").alias("concepts"))


@query("""WITH o AS (SELECT DISTINCT p_brand AS term FROM part WHERE p_size > 48),
own AS (SELECT p_brand AS term, p_partkey AS face, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part WHERE p_size > 48 AND p_partkey % 3 > 0)
SELECT p_brand AS term, p_partkey AS face, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS place, false AS mine FROM part WHERE p_brand NOT IN (SELECT term FROM o) AND p_partkey % 7 > 0 QUALIFY place <= 3
UNION ALL SELECT term, face, place::INT, true FROM own WHERE place <= 3""")
def overlay_override(spark, d):
    """Shipped pins under a person's own: a term that they pinned anything for, or cleared, has only theirs; what they demoted goes."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("face_id"), "p_size")
    order = Window.partitionBy("term").orderBy("face_id")
    shipped = p.where("face_id % 7 > 0").withColumn("place", F.row_number().over(order) - 1).where("place < 3")
    mine = p.where("p_size > 48").select("term", F.lit(1).alias("layer"), F.col("p_size").cast("long").alias("rank"), F.col("face_id").alias("seq"), F.col("face_id").alias("face"), F.lit(False).alias("clear"))
    cleared = p.where("p_size > 48").select("term", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("rank"), F.col("face_id").alias("seq"), F.col("face_id").alias("face"), F.lit(True).alias("clear"))
    demoted = p.where("face_id % 7 = 0").select("term", "face_id", F.lit(-3.0).alias("boost"))
    force = overlays.canonical_in_force(shipped, overlays.Overlay(pins=[mine.where("face % 3 > 0"), cleared]), demoted)
    return force.select("term", F.col("face_id").alias("face"), (F.col("place") + 1).cast("int").alias("place"), F.col("user").alias("mine"))


@query("""WITH s AS (SELECT p_partkey AS seq, p_brand AS key, unnest([lower(p_name), lower(p_type)]) AS spelling FROM part) SELECT spelling, arg_min(key, seq) AS key FROM s GROUP BY spelling""")
def phrase_index_first(spark, d):
    """Each spelling belongs to the first phrase that has it."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("key"), F.array("p_name", "p_type").alias("match"))
    own = rows.select(F.lower("key").alias("spelling")).distinct()
    # Keys are spellings too; those of this table hold a mark that no word has and become two words.
    found = compile.phrase_index(rows).select("spelling", "key")
    return found.join(own.select(F.regexp_replace("spelling", "#", " ").alias("spelling")), "spelling", "left_anti")


@query("""WITH x AS (SELECT unnest(['s:kmoji', CASE WHEN source IS NULL THEN 'none' ELSE lang || ':' || source END]) AS class FROM documents) SELECT class, count(*)::BIGINT AS n FROM x WHERE class <> 's:kmoji' GROUP BY class""")
def policy_violations(spark, d):
    """Classes of provenance that a public catalog may not hold, and how often they stand."""
    label = F.when(F.col("source").isNull(), "none").otherwise(F.concat("lang", F.lit(":"), "source"))
    docs = read(spark, d, "documents").select("doc_id", F.array(F.concat(F.lit("s:kmoji, "), label)).alias("wc"))
    return compile.violations(docs, "doc_id", F.col("wc"), compile.PUBLIC_FACE)


EDGES = "[-1, -0.75, -0.5, -0.25, -0.1, 0, 0.1, 0.25, 0.5, 0.75]"


@query(f"SELECT vec_id, len(list_filter({EDGES}::DOUBLE[], lambda e: e <= embedding[2]::DOUBLE AND e > -1))::INT AS bin, embedding[2]::DOUBLE >= 0.1 AS above FROM embeddings")
def quantise_thresholds(spark, d):
    """Bins with thresholds among their edges: no value changes sides of one."""
    edges = compile.cut_bins([-0.1, 0.1], -1.0, 1.0, 8)
    x = F.col("embedding")[1].cast("double")
    bin_, middle = compile.quantised(x, edges)
    return read(spark, d, "embeddings").select("vec_id", bin_.cast("int").alias("bin"), (middle >= 0.1).alias("above"))


# Reports and the collector


REPORTS = """r AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, ['great_fit', 'no_fit', 'offensive', 'read_well', 'missing', 'note', 'clear', 'bad'][(conv_id + turn) % 8 + 1] AS reason,
  CASE WHEN conv_id % 3 > 0 THEN conv_id END AS face_id, CASE WHEN turn % 2 = 0 THEN left(text, 20) END AS note FROM conversations)"""


def sample_reports(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    reasons = ["great_fit", "no_fit", "offensive", "read_well", "missing", "note", "clear", "bad"]
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("index"), "conv_id", "turn", F.col("text").alias("query"), F.element_at(F.array(*map(F.lit, reasons)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")).alias("reason"),
        F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")).alias("face_id"), F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 20)).alias("note"), F.array().cast("array<long>").alias("shown"), F.lit("offensive").alias("clears"), F.lower("role").alias("term_key"),
    )


@query(f"""WITH {REPORTS} SELECT id, CASE WHEN reason = 'bad' THEN 'unknown reason' WHEN reason IN ('great_fit', 'no_fit', 'offensive') AND face_id IS NULL THEN 'reason needs a face'
  WHEN reason IN ('read_well', 'missing') AND face_id IS NOT NULL THEN 'reason needs a query' WHEN reason = 'note' AND trim(coalesce(note, '')) = '' THEN 'note required' END AS error FROM r WHERE error IS NOT NULL""")
def report_validity(spark, d):
    return reports.checked(sample_reports(spark, d))[1].select(F.col("index").alias("id"), "error")


@query(f"""WITH {REPORTS}, e AS (SELECT r.*, CASE reason WHEN 'clear' THEN 'offensive' ELSE reason END AS what, lower(role) AS term FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn WHERE face_id IS NOT NULL)
SELECT CASE what WHEN 'offensive' THEN 'block' WHEN 'great_fit' THEN 'pick' ELSE 'demote' END AS effect, term, reason = 'clear' AS undo, count(*)::BIGINT AS n FROM e WHERE what IN ('offensive', 'great_fit') OR (what = 'no_fit' AND term IS NOT NULL) GROUP BY ALL""")
def report_effects(spark, d):
    return reports.effects(sample_reports(spark, d)).groupBy("effect", "term", "undo").agg(F.count("*").alias("n"))


@query("""WITH last AS (SELECT arg_max(event_id, event_id) AS event_id, user_id, arg_max(event_type, event_id) AS reason, arg_max(ts, event_id) AS ts FROM events GROUP BY user_id),
sent AS (SELECT user_id, arg_max(l_returnflag = 'R', l_orderkey * 10 + l_linenumber) AS cleared FROM lineitem JOIN (SELECT DISTINCT user_id FROM events) u ON l_suppkey = user_id GROUP BY user_id),
m AS (SELECT max(ts) AS now FROM events)
SELECT event_id, user_id FROM last, m WHERE ts <= now - INTERVAL 120 SECOND AND event_id % 11 > 0 AND (reason <> 'error' OR user_id IN (SELECT user_id FROM sent WHERE NOT cleared))""")
def report_pending(spark, d):
    """The last report of each key that is settled and not sent; a clearing one (here `error`) only if what it clears was."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    queue = e.select(F.col("event_id").alias("report_id"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "clear").otherwise(F.col("event_type")).alias("reason"), "ts", F.col("event_id").alias("seq"))
    sent = read(spark, d, "lineitem").select((F.col("l_orderkey") * 11_000_000).alias("report_id"), F.col("l_suppkey").alias("key"), (F.col("l_returnflag") == "R").alias("clear"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sent_at"))
    done = e.where("event_id % 11 = 0").select(F.col("event_id").alias("report_id"), F.lit(None).cast("long").alias("key"), F.lit(False).alias("clear"), F.lit(0).cast("long").alias("sent_at"))
    now = e.agg(F.max("ts").alias("now")).head()["now"]
    found = reports.pending(queue, sent.unionByName(done), F.lit(now).cast("timestamp"))
    return found.select(F.col("report_id").alias("event_id"), F.col("key").alias("user_id"))


@query("""WITH p AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
f AS (SELECT day, row_number() OVER (PARTITION BY user_id, date_trunc('week', day) ORDER BY day) = 1 AS w, row_number() OVER (PARTITION BY user_id, date_trunc('month', day) ORDER BY day) = 1 AS m FROM p)
(SELECT 'days' AS part, day::VARCHAR AS period, count(*)::BIGINT AS n FROM f GROUP BY day ORDER BY day DESC LIMIT 14)
UNION ALL (SELECT 'weeks', strftime(day, '%Y-W%W') AS k, sum(w::INT)::BIGINT FROM f GROUP BY k ORDER BY k DESC LIMIT 8)
UNION ALL (SELECT 'months', strftime(day, '%Y-%m') AS k, sum(m::INT)::BIGINT FROM f GROUP BY k ORDER BY k DESC LIMIT 6)""")
def collector_rollups(spark, d):
    """Installs a day, week and month of the last 14, 8 and 6 that have any."""
    pings = read(spark, d, "events").select(F.col("user_id").alias("install"), F.to_date("ts").alias("day"))
    parts = reports.rollups(reports.with_firsts(pings), read(spark, d, "events").select(F.col("user_id").alias("face"), F.lit("1").alias("bucket")))
    out = None
    for name in ("days", "weeks", "months"):
        rows = parts[name].select(F.lit(name).alias("part"), "period", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH p AS (SELECT ('0x' || substr(sha1(event_type), 1, 12))::BIGINT AS face_id, 'user ' || (user_id % 10) AS term, pow(0.5, (1.9e9 - epoch(ts)) / (86400 * 3650)) AS w FROM events WHERE event_id % 3 > 0),
b AS (SELECT face_id, term, w FROM p UNION ALL SELECT face_id, NULL, w FROM p) SELECT face_id, term, round(sum(w), 6) AS weight FROM b GROUP BY face_id, term""")
def import_picks(spark, d):
    """A pick log as usage weights: rows of other kinds left out, every pick for the item and for its query."""
    e = read(spark, d, "events")
    log = e.select(F.when(F.col("event_id") % 3 == 0, "search").alias("kind"), F.concat(F.lit(" User   "), F.col("user_id") % 10).alias("q"), F.col("event_type").alias("text"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    out = reports.import_picks(log, F.timestamp_seconds(F.lit(1.9e9)), 86400 * 3650)
    return out.select("face_id", "term", r6(F.col("weight")).alias("weight"))


@query("SELECT min(event_id) AS event_id, user_id FROM events WHERE user_id NOT IN (SELECT l_suppkey FROM lineitem) GROUP BY user_id")
def ingest_once(spark, d):
    """A posted batch into a store: keys that are there stay as they are, a key twice in the batch counts once."""
    batch = read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    stored = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"))
    return reports.accepted(batch, stored, "user_id").select("event_id", "user_id")
