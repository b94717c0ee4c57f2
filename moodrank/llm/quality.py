"""Quality classifier: a modified Kneser-Ney model of bytes, trained on trusted text.

A text is read as its words joined by one space; a word that equals the one before it is read as
the symbol REPEAT and its last three bytes, so that a word said over and over never becomes likely.
Runs of four symbols are counted over every trusted document, runs with REPEAT once in each
(partial counts in each partition, then sums by shard). Joins of the count tables on their shared contexts give modified
Kneser-Ney discounts, back-off weights and interpolated probabilities of all orders. A document's
perplexity is two to the mean bits a symbol; it is rejected above its language's threshold, a fence
set from quantiles of trusted documents of that language that were held out from the counts.

The finished tables are small, since there are few distinct runs of four symbols: up to
MOST_CONTEXTS contexts they are compiled into lookup tables and broadcast; beyond that bound the
documents' own counts are joined with the sharded tables instead. Both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import START, SYMBOLS, ContextTables, sums
from .common import encoded, give_back, saved

ORDER = 4
REPEAT_BYTE = b"\xff"
"""Stands for REPEAT: no UTF-8 text holds this byte."""
SLICE_SYMBOLS = 2_000_000
"""Symbols that a task counts at once, about."""
MOST_CONTEXTS = 250_000
MOST_LABELS = 2_000_000
FENCE = 3.0
"""The threshold in bits a symbol: the upper quartile and FENCE times the distance between quartiles."""
LEAST_SPREAD = 0.08
"""Least distance between quartiles, in bits a symbol."""
HELD_OUT = 4
"""One in so many trusted documents is not counted: what the model says of it, it says of unseen text."""
LEAST_DOCS = 8
"""A language with fewer trusted documents held out gets the threshold of all."""
SHORT = 7.5
"""The mean of n symbols varies by about SHORT / sqrt(n) bits; where that is over SHORT_FREE, texts
of a few hundred symbols and less, the threshold is higher by the rest."""
SHORT_FREE = 0.3


def symbols(text: str) -> bytes:
    words = encoded(text).split()
    return b"".join([REPEAT_BYTE + w[-3:] if w == p else b" " + w for w, p in zip(words, [b"", *words])])[1:]


def _codes(texts: list[bytes], once: bool = False) -> np.ndarray:
    """Codes, base SYMBOLS, of every run of ORDER symbols; START stands three times before a text.
    once: runs with REPEAT count once in each text."""
    texts = [t for t in texts if t]
    if not texts:
        return np.empty(0, np.int64)
    s = np.concatenate([x for t in texts for x in (np.full(3, START, np.int64), np.frombuffer(t, np.uint8))])
    ends = np.arange(3, len(s))
    ends = ends[s[ends] != START]
    code = np.zeros(len(ends), np.int64)
    repeat = np.zeros(len(ends), bool)
    for k in range(3, -1, -1):
        code = code * SYMBOLS + s[ends - k]
        repeat |= s[ends - k] == REPEAT_BYTE[0]
    if once and repeat.any():
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        pairs = np.unique(np.stack([text[repeat], code[repeat]]), axis=1)
        code = np.concatenate([code[~repeat], pairs[1]])
    return code


def run_counts(docs: DataFrame) -> DataFrame:
    """docs(text) -> code, n: how often each run of four symbols occurs in all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            texts = [symbols(t) for t in pdf["text"] if t]
            while texts:
                size, k = 0, 0
                while k < len(texts) and size < SLICE_SYMBOLS:
                    size += len(texts[k])
                    k += 1
                found, n = np.unique(_codes(texts[:k], once=True), return_counts=True)
                texts = texts[k:]
                codes, back = np.unique(np.concatenate([codes, found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        for at in range(0, len(codes), 100_000):
            yield pd.DataFrame({"code": codes[at : at + 100_000], "n": counts[at : at + 100_000]})
        del codes, counts
        give_back()

    return docs.select("text").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class KneserNey:
    """p[k](code, p): probability of a run's last symbol after the others, k + 1 symbols; back[k](code,
    w): weight of the shorter context after a context of k symbols. All sharded tables."""

    def __init__(self, counts: DataFrame):
        tables = {ORDER: saved(counts, "kn-4")}
        for k in range(ORDER - 1, 0, -1):
            # A shorter run counts the different symbols that stand before it.
            tables[k] = saved(tables[k + 1].groupBy((F.col("code") % SYMBOLS**k).alias("code")).agg(F.count("*").alias("n")), f"kn-{k}")
        self.counts = tables
        self.probabilities: dict[int, DataFrame] = {}
        self.weights: dict[int, DataFrame] = {}
        self.floor = 1.0 / SYMBOLS
        for k in range(1, ORDER + 1):
            d = self.discounts(tables[k])
            cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            context = F.floor(F.col("code") / SYMBOLS).cast("long")
            sums_ = tables[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
            sums_ = sums_.withColumn("w", F.col("cut") / F.col("total"))
            joined = tables[k].withColumn("context", context).join(sums_, "context")
            own = (F.col("n") - cut) / F.col("total")
            if k == 1:
                p = joined.select("code", (own + F.col("w") * self.floor).alias("p"))
            else:
                lower = self.probabilities[k - 1].select(F.col("code").alias("suffix"), F.col("p").alias("q"))
                p = joined.withColumn("suffix", F.col("code") % SYMBOLS ** (k - 1)).join(lower, "suffix").select("code", (own + F.col("w") * F.col("q")).alias("p"))
            self.probabilities[k] = saved(p, f"kn-p{k}")
            self.weights[k - 1] = saved(sums_.select(F.col("context").alias("code"), "w"), f"kn-w{k}")

    @staticmethod
    def discounts(table: DataFrame) -> tuple[float, float, float]:
        """For counts of one, two and more, from how many runs have each count."""
        n = {r["n"]: r["m"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()}
        n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [i - (i + 1) * y * b / a if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return tuple(min(max(x, 0.1), i + 0.9) if x else 0.5 for i, x in enumerate(d))

    def tables(self) -> ContextTables | None:
        """Compiled for lookups; None if there are too many contexts for that."""
        if self.weights[3].count() > MOST_CONTEXTS:
            return None
        after: dict[int, dict[int, tuple]] = {}
        weights: dict[int, dict[int, float]] = {}
        for k in range(1, ORDER + 1):
            got = self.probabilities[k].toPandas().sort_values("code")
            code, p = got["code"].to_numpy(), got["p"].to_numpy()
            context, symbol = code // SYMBOLS, code % SYMBOLS
            starts = np.flatnonzero(np.diff(context, prepend=-1))
            after[k - 1] = {int(context[a]): (symbol[a:b], p[a:b]) for a, b in zip(starts, [*starts[1:], len(code)])}
            w = self.weights[k - 1].toPandas()
            weights[k - 1] = dict(zip(w["code"].tolist(), w["w"].tolist()))
        alphabet = sorted({int(s) for s in after.get(0, {}).get(0, ([],))[0]})
        place = np.full(SYMBOLS, len(alphabet), np.int64)
        place[alphabet] = np.arange(len(alphabet))

        def split(code: int, k: int) -> tuple[int, ...]:
            out = []
            for _ in range(k):
                code, s = divmod(code, SYMBOLS)
                out.append(s)
            return tuple(out[::-1])

        n = len(alphabet) + 2
        memo: dict[tuple, np.ndarray] = {}

        def probability(context: tuple[int, ...]) -> np.ndarray:
            if context in memo:
                return memo[context]
            code = 0
            for s in context:
                code = code * SYMBOLS + s
            k = len(context)
            lower = probability(context[1:]) if context else np.full(n, self.floor)
            out = lower * weights[k].get(code, 1.0)
            if code in after[k]:
                which, p = after[k][code]
                out[place[which]] = p
            if k < 3:
                memo[context] = out
            return out

        contexts = {split(code, k) for k in (1, 2, 3) for code in after[k]}
        contexts |= {c[i:] for c in contexts for i in (1, 2) if len(c) > i}
        return ContextTables(alphabet, contexts, lambda c: -np.log2(probability(c)))

    def joined_bits(self, docs: DataFrame) -> DataFrame:
        """docs(row, text) -> row, bits: by joins with the sharded tables, longest context first."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row, text in zip(pdf["row"], pdf["text"]):
                    codes, n = np.unique(_codes([symbols(text or "")]), return_counts=True)
                    yield pd.DataFrame({"row": row, "code": codes, "m": n})

        runs = docs.select("row", "text").mapInPandas(run, "row string, code long, m long")
        # Each distinct run is looked up once, however many documents hold it.
        known = runs.select("code").distinct()
        p, factor = F.lit(None).cast("double"), F.lit(1.0)
        for k in range(ORDER, 0, -1):
            table = self.probabilities[k].select(F.col("code").alias(f"c{k}"), F.col("p").alias(f"p{k}"))
            known = known.join(table, F.col("code") % SYMBOLS**k == F.col(f"c{k}"), "left").drop(f"c{k}")
            w = self.weights[k - 1].select(F.col("code").alias(f"x{k}"), F.col("w").alias(f"w{k}"))
            known = known.join(w, F.floor((F.col("code") % SYMBOLS**k) / SYMBOLS) == F.col(f"x{k}"), "left").drop(f"x{k}")
            p = F.coalesce(p, factor * F.col(f"p{k}"))
            factor = factor * F.coalesce(F.col(f"w{k}"), F.lit(1.0))
        bits = known.select("code", (-F.log2(F.coalesce(p, factor * self.floor))).alias("b"))
        return runs.join(bits, "code").groupBy("row").agg(F.sum(F.col("m") * F.col("b")).alias("bits"))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents labelled good; the ids are broadcast only if they are few."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(F.broadcast(good) if labels.count() <= MOST_LABELS else good, "doc_id", "left_semi")


def _scored(docs: DataFrame, model: KneserNey, tables: ContextTables | None) -> DataFrame:
    """docs(text, ...) -> with n_symbols and bits."""
    schema = docs.select("*").schema.add("n_symbols", "long").add("bits", "double")
    if tables is not None:
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = [symbols(t or "") for t in pdf["text"]]
                yield pdf.assign(n_symbols=[len(t) for t in texts], bits=sums(shared.value, texts))
            give_back()

        return docs.mapInPandas(run, schema)
    rows = saved(docs.withColumn("row", F.uuid()), "kn-docs")
    length = F.udf(lambda t: len(symbols(t or "")), "long")
    return rows.join(model.joined_bits(rows), "row", "left").withColumn("n_symbols", length("text")).withColumn("bits", F.coalesce("bits", F.lit(0.0))).select(*schema.names)


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), sharded: bool = False) -> DataFrame:
    """docs(doc_id, text, lang, *keep), labels(doc_id, quality) -> doc_id, lang, *keep, n_symbols, perplexity,
    threshold, kept; with "text" in keep the text, too.

    A null, empty or blank text has no symbols, null perplexity and is not kept. A
    null lang is a language of its own; a language with few trusted documents held out goes by
    the threshold of all languages, and if none is held out nothing is rejected.
    Rows that repeat are each scored. Null ids are not labelled; labels that repeat
    count as good if one of them is. Columns named as the new ones are not carried along."""
    held_out = F.pmod(F.xxhash64(F.lit("held out"), "text"), F.lit(HELD_OUT)) == 0  # copies are all held out or none
    good = trusted(docs, labels).select("lang", "text", held_out.alias("held_out"))
    model = KneserNey(run_counts(good.where("NOT held_out")))
    tables = None if sharded else model.tables()
    rate = F.try_divide("bits", "n_symbols")
    rates = saved(_scored(good.where("held_out").select("lang", "text"), model, tables).where("n_symbols > 0").select("lang", rate.alias("rate")), "kn-rates")
    stats = [F.percentile_approx("rate", [0.25, 0.75], 10_000).alias("q"), F.count("*").alias("n")]
    everything = rates.agg(*stats).head()
    fence = lambda low, high: high + FENCE * F.greatest(high - low, F.lit(LEAST_SPREAD))
    overall = fence(*map(F.lit, everything["q"])) if everything["n"] else F.lit(float("inf"))
    fences = rates.groupBy("lang").agg(*stats).where(F.col("n") >= LEAST_DOCS).select(F.col("lang").alias("l_"), fence(F.col("q")[0], F.col("q")[1]).alias("fence"))
    new = ("n_symbols", "bits", "perplexity", "threshold", "kept", "l_", "fence")
    columns = list(dict.fromkeys(["doc_id", "lang", "text", *[c for c in keep if c not in new]]))
    scored = _scored(docs.select(*columns), model, tables)
    short = F.greatest(F.lit(SHORT) / F.sqrt(F.greatest("n_symbols", F.lit(1))) - SHORT_FREE, F.lit(0.0))
    # One row a language that has trusted documents.
    out = scored.join(saved(fences, "kn-fences"), F.col("lang").eqNullSafe(F.col("l_")), "left").withColumn("fence", F.coalesce("fence", overall) + short)
    return out.select(
        *[c for c in columns if c != "text" or c in keep],
        "n_symbols",
        F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), rate)).alias("perplexity"),
        F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), F.col("fence"))).alias("threshold"),
        ((F.col("n_symbols") > 0) & (rate <= F.col("fence"))).alias("kept"),
    )
