"""Language identification by partial matching of byte contexts.

For every language a tree of byte contexts of up to three bytes is counted on a bounded
sample of labelled rows. After a context, a byte seen n times costs -log2(n / (total +
kinds)); one never seen there costs the escape, -log2(kinds / (total + kinds)), and then
its cost after the context without its first byte, down to equal chances for all symbols.
The counts are frozen: costs are compiled into tables, and a text's code length under every
language is a sum of lookups. The language with the shortest code is predicted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import START, SYMBOLS, ContextTables, sums
from .common import encoded, mapped

TRAIN_DOCS = 600
"""Expected number of different texts a language is fitted on; all of them if it has fewer."""
TRAIN_BYTES = 20_000
"""Longer rows are not drawn for fitting."""
TRAIN_TOTAL = 100_000_000
"""Bytes of text that all languages together are fitted on, at most: with many of them each gets fewer rows."""
PIECES = 10
"""A language all of whose rows are longer is fitted on so many pieces of its shortest row, from its start to its end."""
LEAST_CONTEXT = 3
"""A context is kept if it was seen this often in all samples ..."""
MOST_CELLS = 24_000_000
"""... or more often, so that the tables (contexts x symbols x languages) have no more costs than this."""


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, docs_each: int = TRAIN_DOCS, bytes_most: int = TRAIN_BYTES) -> list[tuple[str, str]]:
    """(lang, text) of rows with both whose id's remainder is not 2: about docs_each different texts of each
    language, by the hash of id and text."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(remainder(F.col("doc_id")), F.lit(2)) != 2) & F.col("text").rlike(r"\p{L}"))
    short = F.octet_length("text") <= bytes_most
    counts = able.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.xxhash64("text"))).alias("n")).collect()  # one row a language
    if not counts:
        return []
    docs_each = min(docs_each, max(1, TRAIN_TOTAL // (bytes_most * len(counts))))
    share = able.sparkSession.createDataFrame([(r["lang"], min(1.0, docs_each / max(r["n"], 1))) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(2**40)) / F.lit(float(2**40))
    drawn = able.where(short).select("lang", "text", draw.alias("draw")).join(F.broadcast(share), "lang").where("draw < share")
    # Copies count once, so that no text, however often it stands, fills the sample.
    rows = drawn.select("lang", "text").distinct().collect()
    long_only = [r["lang"] for r in counts if r["n"] == 0]
    if long_only:
        step = F.length("text") / F.lit(PIECES)
        pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", F.floor(i * step).cast("int") + 1, F.lit(bytes_most // PIECES)))
        one = able.where(F.col("lang").isin(long_only)).groupBy("lang").agg(F.min_by(F.array_join(pieces, " "), F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text"))
        rows += one.select("lang", "text").collect()
    return [(r["lang"], r["text"]) for r in rows]


class LanguageModel:
    def __init__(self, sample: list[tuple[str, str]], least: int = LEAST_CONTEXT):
        self.languages = sorted({lang for lang, _ in sample})
        grams: list[list[Counter]] = []
        for language in self.languages:
            texts = [np.frombuffer(encoded(t), np.uint8) for lang, t in sample if lang == language]
            padded = np.concatenate([x for t in texts for x in (np.full(3, START, np.int64), t.astype(np.int64))])
            counts = []
            for order in range(4):
                ends = np.arange(3, len(padded))
                ends = ends[padded[ends] != START]
                codes = np.zeros(len(ends), np.int64)
                for k in range(order, -1, -1):
                    codes = codes * SYMBOLS + padded[ends - k]
                values, n = np.unique(codes, return_counts=True)
                counts.append(dict(zip(values.tolist(), n.tolist())))
            grams.append(counts)
        self.alphabet = sorted({s for counts in grams for s in counts[0]})
        place = {s: i for i, s in enumerate(self.alphabet)}
        n = len(self.alphabet) + 2
        # after[language][order][context code] -> {symbol: count}
        after = [[{} for _ in range(4)] for _ in grams]
        totals: Counter = Counter()
        for mine, counts in zip(after, grams):
            for order, table in enumerate(counts):
                for code, c in table.items():
                    context, symbol = divmod(code, SYMBOLS)
                    mine[order].setdefault(context, []).append((place[symbol], c))
                    if order == 3:
                        totals[context] += c

        def code_of(context: tuple[int, ...]) -> int:
            code = 0
            for s in context:
                code = code * SYMBOLS + s
            return code

        memo: dict[tuple, np.ndarray] = {}

        def cost(context: tuple[int, ...]) -> np.ndarray:
            """(symbols, languages) bits after a context."""
            if context in memo:
                return memo[context]
            below = cost(context[1:]) if context else np.full((n, len(grams)), np.log2(n))
            out = below.copy()
            code = code_of(context)
            for j, mine in enumerate(after):
                seen = mine[len(context)].get(code)
                if not seen:
                    continue
                which = np.array([x[0] for x in seen])
                c = np.array([x[1] for x in seen], float)
                total = c.sum() + len(c)
                out[:, j] += -np.log2(len(c) / total)
                out[which, j] = -np.log2(c / total)
            if len(context) < 3:
                memo[context] = out
            return out

        def symbols_of(code: int, k: int) -> tuple[int, ...]:
            out = []
            for _ in range(k):
                code, s = divmod(code, SYMBOLS)
                out.append(s)
            return tuple(out[::-1])

        # Seen in all samples, by order; a context's suffix was seen no less often.
        seen: Counter = Counter()
        for counts in grams:
            for k in (1, 2):
                for code, c in counts[k].items():
                    seen[k, code // SYMBOLS] += c
        seen.update({(3, code): c for code, c in totals.items() if c >= least})
        most = MOST_CELLS // (n * max(1, len(grams)))
        if len(seen) > most:
            least = sorted(seen.values(), reverse=True)[most] + 1
            seen = Counter({x: c for x, c in seen.items() if c >= least})
        contexts = {symbols_of(code, k) for k, code in seen}
        contexts = {c for c in contexts if START not in c or all(s == START for s in c[: c.index(next((x for x in c if x != START), START))])}
        self.tables = ContextTables(self.alphabet, contexts, cost) if grams else None

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its probability if all languages were equally likely before."""
        bits = sums(self.tables, texts)
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.log(2)
        return best, 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)


def predict(docs: DataFrame, docs_each: int = TRAIN_DOCS) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score.

    Fitted on rows with text and lang whose id's crc32 mod 4 is not 2. `und` with score 0 if the
    text is null or has no letter, or nothing could be learned. Whole texts are scored; a null
    id is not held out and not learned from; equal lengths go to the first language in
    code point order. Repeated rows are predicted alike; other columns are ignored. There may be any number of languages: the
    more there are, the fewer rows each is fitted on and the rarer contexts are left out of the tables."""
    spark = docs.sparkSession
    model = LanguageModel(training_sample(docs, docs_each))
    # Its size is bounded by the sample's, which the parameters bound.
    shared = spark.sparkContext.broadcast(model)

    def prepare() -> Callable[[pa.RecordBatch], list]:
        m = shared.value

        def make(rows: pa.RecordBatch) -> list:
            texts = rows.column("text").to_pylist()
            able = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & bool(m.languages)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if able.any():
                best, p = m.predict([encoded(t) for t, a in zip(texts, able) if a])
                pred[able] = np.array(m.languages, object)[best]
                score[able] = p
            return [pred.tolist(), score]

        return make

    rows = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"))
    return mapped(rows, ("doc_id", "held_out"), T.StructType().add("lang_pred", "string").add("score", "double"), prepare)
