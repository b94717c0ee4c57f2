"""Search, browse, complete, similar, look-ups: the operations of a catalog, each one plan for a batch of queries.

A query's side (terms, words, keys) is small and sent to every task; items, postings and lists are only joined on it.
Every part of a score is a column until the end, so `why` is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jitter, parsed_id, shown_id
from ..plans.reader import Plan, Words, plan
from ..sources.config import Options
from . import ranking, scoring
from .state import chains

MOST_QUERIES = 512
"""Queries whose terms are sent to every task at once; a longer batch is several plans."""
PIN_KEYS = "term string, face_id long, place int, user boolean"
BLEND_STEP = 0.25
STARTERS = 20
"""Canonical items that a browser sees before what was used."""
TERM = "struct<p:array<double>,each:array<double>,target:double,negated:boolean,weight:double>"
READING = f"qid long, rid long, place int, terms array<{TERM}>, sentence boolean, high boolean, structured boolean, only_flags boolean, flags array<string>, preference double, pin_key string, term_key string, boost_term string"
SIGNALS = ["canon", "dense", "engine", "lexical", "used", "used_here", "boost"]


@dataclass
class Tables:
    """items, neighbours(list, term, rank, face_id), postings(word, face_id, tier), canonical(term, face_id, place, user),
    boosts(term, face_id, boost), usage(term, face_id, weight), aliases(old, new), blocked(face_id), hidden(face_id).
    Missing ones are empty."""

    spark: SparkSession
    items: DataFrame
    words: Words
    others: dict[str, DataFrame] = field(default_factory=dict)

    SCHEMAS = {
        "neighbours": "list string, term string, rank int, face_id long", "postings": "word string, face_id long, tier int", "canonical": PIN_KEYS, "boosts": "term string, face_id long, boost double",
        "usage": "term string, face_id long, weight double", "aliases": "old long, new long", "blocked": "face_id long", "hidden": "face_id long", "retired": "face_id long, reason string",
    }

    def __getitem__(self, name: str) -> DataFrame:
        return self.others.get(name) if name in self.others else self.spark.createDataFrame([], self.SCHEMAS[name])

    def live_ids(self, ids: DataFrame) -> DataFrame:
        """ids(face_id, ...) with ids that moved replaced by what they became."""
        if "aliases" not in self.others:
            return ids
        moved = chains(self["aliases"]).select(F.col("old").alias("face_id"), "final")
        return ids.join(moved, "face_id", "left").withColumn("face_id", F.coalesce("final", "face_id")).drop("final")


def admissible(t: Tables, o: Options) -> DataFrame:
    """Items that options, blocklist and overlays let through."""
    index = {e: i for i, e in enumerate(t.words.emotions or scoring.EMOTIONS)}
    by_index = lambda bounds: {index[k]: v for k, v in bounds.items() if k in index}
    items = ranking.admissible(
        t.items, strict=o.safety == "strict", hide=tuple(k for k, v in o.styles.items() if v == "hide"), max_len=o.max_len, faces_only=o.faces_only, min_quality=o.min_quality,
        least=by_index(o.emotions_min), most=by_index(o.emotions_max),
    )
    gone = [t.live_ids(t[name].select("face_id")) for name in ("blocked", "hidden") if name in t.others]
    if o.exclude:
        gone.append(t.live_ids(t.spark.createDataFrame([(i,) for i in o.exclude], "face_id long")))
    for ids in gone:
        items = ranking.without(items, ids, "face_id")
    return items


def warnings(t: Tables, o: Options) -> list[str]:
    known = set(t.words.emotions or scoring.EMOTIONS)
    named = [k for bounds in (o.emotions_min, o.emotions_max, o.target) for k in bounds]
    out = [f"unknown emotion {k}" for k in dict.fromkeys(named) if k not in known]
    return out + [f"{k}: least is over most" for k in o.emotions_min.keys() & o.emotions_max.keys() if o.emotions_min[k] > o.emotions_max[k]]


def _reading_rows(qid: int, first: int, p: Plan) -> list[tuple]:
    rows = []
    for place, r in enumerate(p.readings):
        terms = [(list(map(float, t.p)), [None if x is None else float(x) for x in t.each] or None, t.target, t.negated, float(t.weight)) for t in r.terms if t.main and t.p]
        pairs = [t.pair for t in r.terms if t.pair is not None]
        flags = set(r.flags) | ({"pair" if pairs[0] else "single"} if pairs else set())
        ms = [t.m for t in r.terms if t.m is not None]
        lean = max(-1.0, min(1.0, (sum(ms) / len(ms) - 0.3) / 0.3)) if ms else 0.0
        only = not r.terms and bool(flags & {"lenny", "lewd", "cute"})
        rows.append((qid, first + place, place, terms, r.sentence, any(t.high for t in r.terms), r.structured, only, sorted(flags), lean, r.pin_key, r.term_key if p.kind == "score" else None, r.boost_term))
    return rows


def term_value(t: Column, r: Column) -> Column:
    """How well ratings suit a term: near what was asked of each emotion, all of the profile, its absence, or near one rating."""
    near = lambda p, x, wanted: F.when((x < scoring.LEAST_RATING) | wanted.isNull(), F.lit(0.0)).otherwise(p * (1 - F.abs(x - wanted)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    each = total(F.zip_with(F.zip_with(t["p"], r, lambda p, x: F.struct(p.alias("p"), x.alias("x"))), t["each"], lambda px, w: near(px["p"], px["x"], w)))
    plain = total(F.zip_with(t["p"], r, lambda p, x: p * x))
    level = total(F.zip_with(t["p"], r, lambda p, x: near(p, x, t["target"])))
    return F.when(t["each"].isNotNull(), each).when(t["negated"], 1 - plain).when(t["target"].isNotNull(), level).otherwise(plain)


def emotion(terms: Column, sentence: Column, r: Column) -> Column:
    """Least of the main terms, or their mean in a sentence, and the share of each adverb."""
    mains = F.transform(F.filter(terms, lambda t: t["weight"] >= 1), lambda t: term_value(t, r))
    mean = F.aggregate(mains, F.lit(0.0), lambda a, x: a + x) / F.size(mains)
    main = F.when(F.size(mains) == 0, 0.0).when(sentence, mean).otherwise(F.array_min(mains))
    return main + F.aggregate(F.filter(terms, lambda t: t["weight"] < 1), F.lit(0.0), lambda a, t: a + 0.4 * t["weight"] * term_value(t, r))


def signals(t: Tables, plans: dict[int, Plan], readings: DataFrame, o: Options) -> DataFrame:
    """rid, face_id and a column for each thing but ratings that speaks for an item."""
    spark, first = t.spark, 0
    terms, words = [], []
    for p in plans.values():
        for place, r in enumerate(p.readings):
            counted = [x for x in r.terms if x.listed and not x.negated and x.kind != "target"]
            whole = sum(x.weight for x in counted)
            terms += [(first + place, x.key, x.weight / whole) for x in counted if whole]
            words += [(first + place, w) for w in set(r.lexical) if len(w) >= 2]
        first += len(p.readings)
    terms_df, words_df = spark.createDataFrame(terms, "rid long, term string, share double"), spark.createDataFrame(words, "rid long, word string")
    value = lambda **given: [F.coalesce(given[s], F.lit(0.0)).cast("double").alias(s) if s in given else F.lit(0.0).alias(s) for s in SIGNALS]
    decayed = F.col("share") / (1 + F.col("rank") / 10)
    listed = t["neighbours"].join(F.broadcast(terms_df), "term")
    parts = [listed.select("rid", "face_id", *value(dense=F.when(F.col("list") == "dense", decayed), engine=F.when(F.col("list") == "engine", decayed)))]
    credit = F.element_at(F.array(*map(F.lit, scoring.TIER_CREDIT)), F.col("tier") + 1)
    found = t["postings"].join(F.broadcast(words_df), "word").groupBy("rid", "face_id").agg(F.max(credit).alias("credit"))
    parts.append(found.select("rid", "face_id", *value(lexical=F.least("credit", F.lit(1.0)))))
    keys = F.broadcast(readings.select("rid", "pin_key", "term_key", "boost_term"))
    if o.pinned:
        bonus = F.element_at(F.array(*map(F.lit, scoring.PIN_BONUS)), F.col("place") + 1)
        pins = t["canonical"].where(F.col("place") < len(scoring.PIN_BONUS)).join(keys, F.col("term") == F.col("pin_key"))
        parts.append(pins.select("rid", "face_id", *value(canon=bonus)))
    if o.usage != "off":
        unit = lambda c: F.greatest(F.least(F.nanvl(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        used = t.live_ids(t["usage"]).withColumn("weight", unit(F.col("weight")))
        everywhere = used.where("term IS NULL").crossJoin(F.broadcast(readings.select("rid")))  # at most MOST_QUERIES rows
        parts.append(everywhere.select("rid", "face_id", *value(used=F.col("weight"))))
        here = used.join(keys, F.col("term") == F.col("term_key"))
        parts.append(here.select("rid", "face_id", *value(used_here=F.col("weight"))))
    boosts = t.live_ids(t["boosts"]).join(keys, F.col("term") == F.col("boost_term"))
    parts.append(boosts.select("rid", "face_id", *value(boost=F.col("boost"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    most = {"used", "used_here"}
    return out.groupBy("rid", "face_id").agg(*[(F.least(F.sum(s), F.lit(1.0)) if s in most else F.sum(s)).alias(s) for s in SIGNALS])


def scored(pool: DataFrame, readings: DataFrame, found: DataFrame, o: Options) -> DataFrame:
    """Every admissible item for every reading, with its score and parts, but items that nothing speaks for."""
    c, has = F.col, lambda name: F.array_contains("flags", name)
    r = F.transform("r", lambda x: x.cast("double"))
    both = pool.join(F.broadcast(readings)).withColumn("e", emotion(c("terms"), c("sentence"), r))
    both = both.join(found, ["rid", "face_id"], "left").fillna(0.0, SIGNALS)
    candidate = (c("canon") != 0) | (c("e") >= scoring.CANDIDATE) | (c("dense") != 0) | (c("engine") != 0) | (c("lexical") != 0) | (c("used_here") != 0) | c("only_flags")
    both = both.where(candidate)
    w, s = scoring.WEIGHTS, scoring.structured_weights(True)
    weight = lambda name: F.when(c("structured"), s[name]).otherwise(w[name])
    strict, off = o.safety == "strict", o.safety == "off"
    allow = lambda style: o.styles.get(style) == "allow"
    multi = c("multi").cast("double")
    figures = F.lit(0.0) if o.figures == "any" else F.when(has("single"), scoring.figures_part(multi, "single")).when(has("pair"), scoring.figures_part(multi, "pair")).otherwise(scoring.figures_part(multi, None, c("preference")))
    ask = lambda flag, part: F.when(has(flag), part(True)).otherwise(part(False))
    adjust = {
        "high": F.when(c("high"), 0.15 * c("intensity")).otherwise(0.0),
        "figures": figures,
        "quality": scoring.quality_part(c("quality").cast("double")),
        "cute": F.when(has("cute"), 0.2 * c("cute")).otherwise(0.0),
        "boost": 0.08 * c("boost"),
        "face": -0.4 * F.greatest(1 - c("face"), F.lit(0.0)),
        "length": F.lit(0.0) if allow("long") else scoring.length_part(c("len"), o.long_at),
        "suggestive": ask("lewd", lambda asked: scoring.suggestive_part(c("suggestive").cast("double"), asked, strict, off)),
        "lenny": ask("lenny", lambda asked: scoring.lenny_part(c("lenny").cast("double"), asked, allow("lenny"))),
        "crude": ask("lewd", lambda asked: scoring.crude_part(c("crude"), asked, allow("crude"))),
    }
    both = both.withColumns({f"adjust_{k}": v.cast("double") for k, v in adjust.items()})
    parts = {
        "canon": c("canon"),
        "emotion": weight("emotion") * c("e"),
        "dense": weight("dense") * c("dense"),
        "engine": weight("engine") * c("engine"),
        "lexical": weight("lexical") * F.least(c("lexical"), F.lit(1.0)),
        "adjust": sum((c(f"adjust_{k}") for k in adjust), F.lit(0.0)),
        "usage": scoring.USAGE_LIFT[o.usage] * (c("used") + 4 * c("used_here")) / 5,
        "jitter": F.when(c("canon") == 0, o.variety * 0.4 * (jitter(F.lit(o.seed).cast("long"), c("face_id")).cast("double") - 0.5)).otherwise(0.0) if o.variety else F.lit(0.0),
    }
    both = both.withColumns({f"why_{k}": v for k, v in parts.items()})
    total = sum((F.col(f"why_{k}") for k in parts), F.lit(0.0))
    why = F.struct(*[F.col(f"why_{k}").alias(k) for k in parts], F.struct(*[F.col(f"adjust_{k}").alias(k) for k in adjust]).alias("adjusted"))
    return both.select("qid", "place", "face_id", "chars", (c("canon") != 0).alias("pinned"), total.alias("score"), why.alias("why"))


def glyph_hits(pool: DataFrame, needles: DataFrame, o: Options) -> DataFrame:
    """needles(qid, needle): admissible faces whose text holds it, short ones first."""
    hits = pool.where("face >= 0.5").join(F.broadcast(needles), F.contains("text", F.col("needle")))
    order = Window.partitionBy("qid").orderBy("len", "face_id")
    ranked = hits.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))
    return ranked.where((F.col("rank") >= o.offset) & (F.col("rank") < o.offset + o.limit)).select("qid", "face_id", "rank", (1 - 0.001 * F.col("rank")).alias("score"), F.lit(False).alias("pinned"))


def plans_of(t: Tables, texts: Sequence[str], o: Options) -> dict[int, Plan]:
    target = {k: v for k, v in o.target.items() if k in t.words.emotions} or None
    return {i: plan(x, t.words, o.figures, o.intensity, target, o.complete, o.glyph) for i, x in enumerate(texts)}


def search(t: Tables, texts: Sequence[str], o: Options = Options()) -> DataFrame:  # noqa: B008
    """qid (the text's place), rank, face_id, score, pinned, why: the page of every text. An empty text has no hits here
    (browse shows something for it), symbols find the items that hold them, unfinished words those of their completions."""
    out = None
    for at in range(0, max(len(texts), 1), MOST_QUERIES):
        part = _search(t, texts[at : at + MOST_QUERIES], o).withColumn("qid", F.col("qid") + at)
        out = part if out is None else out.unionByName(part)
    return out


def _search(t: Tables, texts: Sequence[str], o: Options) -> DataFrame:
    plans = plans_of(t, texts, o)
    pool = admissible(t, o)
    glyph = {i: p for i, p in plans.items() if p.kind == "glyph"}
    hits = None
    if glyph:
        needles = t.spark.createDataFrame([(i, p.text) for i, p in glyph.items()], "qid long, needle string")
        hits = glyph_hits(pool, needles, o)
        every = pool.where("face >= 0.5").join(F.broadcast(needles), F.contains("text", F.col("needle"))).select("qid").distinct()
        found = {r["qid"] for r in every.collect()}  # at most MOST_QUERIES rows
        plans = {i: p for i, p in plans.items() if i not in found}
    plans = {i: p for i, p in plans.items() if p.readings}
    rows, first = [], 0
    for i, p in plans.items():
        rows += _reading_rows(i, first, p)
        first += len(p.readings)
    readings = t.spark.createDataFrame(rows, READING)
    scores = scored(pool, readings, signals(t, plans, readings, o), o)
    best = scores.groupBy("qid", "face_id").agg(
        F.max(F.col("score") - BLEND_STEP * F.col("place")).alias("score"), F.first("chars").alias("chars"), F.max("pinned").alias("pinned"), F.max_by("why", F.struct(F.col("score") - BLEND_STEP * F.col("place"), -F.col("place"))).alias("why"),
    )
    page = ranking.thinned(best, "face_id", ("qid",), o.thinning, o.offset, o.limit)
    page = page.join(best.select("qid", "face_id", "pinned", "why"), ["qid", "face_id"]).select("qid", "rank", "face_id", "score", "pinned", "why")
    if hits is None:
        return page
    return page.unionByName(hits.select("qid", "rank", "face_id", "score", "pinned", F.lit(None).cast(page.schema["why"].dataType).alias("why")))


def entries(t: Tables) -> DataFrame:
    """Every item in the order of ids."""
    return t.items.orderBy("face_id")


def get(t: Tables, ids: Sequence[int | str]) -> DataFrame:
    """id (as asked), item columns: by number or shown id, through aliases; unknown ones are left out."""
    asked = t.spark.createDataFrame([(str(i),) for i in ids], "id string")
    asked = asked.withColumn("face_id", F.coalesce(F.col("id").try_cast("long"), parsed_id(F.col("id"))))
    return t.live_ids(asked).join(t.items, "face_id")


def find_text(t: Tables, text: str) -> DataFrame:
    return t.items.where(F.col("text") == text)


def browse(t: Tables, o: Options = Options()) -> DataFrame:  # noqa: B008
    """rank, face_id, score, pinned, user_pin: first items of the concepts (the user's own first, then by items of the
    concept), after STARTERS of them what was used, then the rest; each item once, admissible ones only."""
    counts = t.spark.createDataFrame([(k, v.count) for k, v in t.words.vocab.items()] or [("", 0)], "term string, n int")
    firsts = t["canonical"].where("place = 0").join(F.broadcast(counts), "term", "left")
    order = Window.orderBy(F.col("user").desc(), F.coalesce("n", F.lit(0)).desc(), "term")  # one row a concept
    pins = firsts.select("face_id", "user", (F.row_number().over(order) - 1).alias("at")) if o.pinned else firsts.where("false").select("face_id", "user", F.lit(0).alias("at"))
    pins = pins.select("face_id", F.lit(True).alias("pinned"), F.col("user").alias("user_pin"), F.when(F.col("at") < STARTERS, 0).otherwise(2).alias("section"), F.col("at").cast("double").alias("at"))
    if o.usage != "off":
        used = t.live_ids(t["usage"].where("term IS NULL")).groupBy("face_id").agg(F.sum("weight").alias("weight"))
        pins = pins.unionByName(used.select("face_id", F.lit(False).alias("pinned"), F.lit(False).alias("user_pin"), F.lit(1).alias("section"), (-F.col("weight")).alias("at")))
    place = F.struct("section", "at", "face_id")
    once = pins.groupBy("face_id").agg(F.min(place).alias("place"), F.min_by("pinned", place).alias("pinned"), F.min_by("user_pin", place).alias("user_pin"))
    once = once.join(admissible(t, o).select("face_id"), "face_id", "left_semi")
    top = once.orderBy("place").limit(o.offset + o.limit)  # a page: the window sees no more
    out = top.withColumn("rank", (F.row_number().over(Window.orderBy("place")) - 1).cast("int")).where(F.col("rank") >= o.offset)
    return out.select("rank", "face_id", (1 - 0.001 * F.col("rank")).alias("score"), "pinned", "user_pin")


def similar(t: Tables, face_id: int, o: Options = Options()) -> DataFrame:  # noqa: B008
    """rank, face_id, score of items like one: near copies of it and inadmissible items aside, thinned."""
    source = t.items.where(F.col("face_id") == face_id)
    like = ranking.similar(admissible(t, o), source, "face_id", ranking.THINNING[o.thinning] if o.thinning != "off" else 1.0)
    if o.variety:
        like = like.withColumn("score", F.col("score") + o.variety * 0.4 * (jitter(F.lit(o.seed).cast("long"), F.col("face_id")).cast("double") - 0.5))
    return ranking.thinned(like.select("face_id", "score", "chars"), "face_id", (), o.thinning, o.offset, o.limit).select("rank", "face_id", "score")


def info(t: Tables) -> DataFrame:
    """One row of counts."""
    concepts = t["canonical"].agg(F.countDistinct("term").alias("canonical_terms"))
    boosted = t["boosts"].agg(F.countDistinct("term").alias("boost_terms"))
    return t.items.agg(F.count("*").alias("items")).crossJoin(concepts).crossJoin(boosted).select(  # one row each
        "items", F.lit(len(t.words.vocab)).alias("terms"), F.lit(len(t.words.phrases)).alias("phrases"), "canonical_terms", "boost_terms"
    )


# What a hit shows


FIELDS = ["flags", "emotions", "emotions_all", "quality", "attrs", "canonical_for", "why"]


def canonical_for(canonical: DataFrame) -> DataFrame:
    """face_id, concepts that it stands for."""
    return canonical.groupBy("face_id").agg(F.sort_array(F.collect_set("term")).alias("canonical_for"))


def with_entries(t: Tables, hits: DataFrame) -> DataFrame:
    """Hits with the columns of their items, and the concepts they stand for."""
    items = t.items.select("face_id", "text", "r", "multi", "cute", "intensity", "suggestive", "lenny", "face", "quality", "crude", "len")
    return hits.join(items, "face_id").join(canonical_for(t["canonical"]), "face_id", "left")


def flag_names(bits: Column) -> Column:
    names = [*scoring.FLAGS, "pinned"]
    return F.filter(F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(names)]), lambda x: x.isNotNull())


def hint(emotions: Sequence[str], r: Column, concepts: Column) -> Column:
    """The first two concepts, else the two strongest emotions that are felt at all."""
    pairs = F.arrays_zip(F.transform(r, lambda x: -x).alias("v"), F.array(*map(F.lit, emotions)).alias("name"))
    felt = F.transform(F.slice(F.array_sort(F.filter(pairs, lambda x: -x["v"] > 0.05)), 1, 2), lambda x: x["name"])
    return F.array_join(F.when(F.size(concepts) > 0, F.slice(concepts, 1, 2)).otherwise(felt), ", ")


def shaped(hits: DataFrame, emotions: Sequence[str], fields: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Rows as they are sent: id, text, score to four places, rank and the fields asked for; emotions and attributes to
    three places, quality to two. And a warning for each unknown field."""
    c = F.col
    bits = scoring.flags(c("suggestive"), c("lenny"), c("crude"), c("multi"), c("face"), c("len"))
    bits = bits.bitwiseOR(F.when(F.coalesce(c("pinned"), F.lit(False)), 1 << len(scoring.FLAGS)).otherwise(0))
    r = F.transform("r", lambda x: F.round(x.cast("double"), 3))
    strong = F.transform(F.slice(F.array_sort(F.arrays_zip(F.transform(r, lambda x: -x).alias("v"), F.array(*map(F.lit, emotions)).alias("name"))), 1, 3), lambda x: F.struct(x["name"].alias("key"), (-x["v"]).alias("value")))
    known = {
        "flags": flag_names(bits),
        "emotions": F.map_from_entries(strong),
        "emotions_all": F.map_from_arrays(F.array(*map(F.lit, emotions)), r),
        "quality": F.round(c("quality").cast("double"), 2),
        "attrs": F.struct(*[F.round(c(a).cast("double"), 3).alias(a) for a in ("multi", "cute", "intensity", "suggestive", "lenny", "face", "crude")]),
        "canonical_for": F.coalesce("canonical_for", F.array().cast("array<string>")),
        "why": c("why") if "why" in hits.columns else F.lit(None),
    }
    columns = [shown_id(c("text")).alias("id"), "text", F.round("score", 4).alias("score"), "rank"]
    keep = [k for k in ("qid",) if k in hits.columns]
    return hits.select(*keep, *columns, hint(emotions, F.transform("r", lambda x: x.cast("double")), c("canonical_for")).alias("hint"), *[known[f].alias(f) for f in fields if f in known]), [f"unknown field {f}" for f in fields if f not in known]


def origin(pinned: Column) -> Column:
    """Why a browser shows an item."""
    return F.when(pinned, "canonical").otherwise("history")


def lines(rows: DataFrame, form: str) -> DataFrame:
    """Shaped rows as lines of text: plain, dmenu, tsv, jsonl, or alfred's items."""
    c = F.col
    forms = {
        "plain": c("text"),
        "dmenu": F.concat_ws("  ", "text", "hint"),
        "tsv": F.concat_ws("\t", "id", F.regexp_replace("text", r"[\t\r\n]", " "), F.format_number("score", 4), c("rank").cast("string")),
        "jsonl": F.to_json(F.struct(*rows.columns)),
        "alfred": F.to_json(F.struct(c("id").alias("uid"), c("text").alias("title"), c("hint").alias("subtitle"), c("text").alias("arg"))),
    }
    if form not in forms:
        raise ValueError(f"unknown form {form}")
    return rows.select(*[k for k in ("qid",) if k in rows.columns], "rank", forms[form].alias("line"))
