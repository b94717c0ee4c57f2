"""From an export directory and curated files to a catalog: reading, checking, building, and the manifest."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_id, tokens
from ..operators.scoring import EMOTIONS
from ..operators.state import chains, newest
from .catalog import Catalog, CatalogError, build_canonical, build_items, build_neighbours, check_items, open_catalog

NONE = 0xFFFFFFFF
LONGEST_PHRASE = 8
EXTRAS = ["multi", "cute", "intensity", "suggestive", "lenny", "face"]
FACE = "id STRING, text STRING, r ARRAY<DOUBLE>, x ARRAY<DOUBLE>, q DOUBLE, w ARRAY<STRUCT<word: STRING, tier: TINYINT>>, c BOOLEAN, wc ARRAY<STRING>"
VOCAB = "t STRING, p MAP<STRING, DOUBLE>, m DOUBLE, n INT, src STRING, ev ARRAY<STRING>"
CURATED = {
    "canonical": "term STRING, text STRING, rank BIGINT, hand BOOLEAN",
    "boosts": "term STRING, id STRING, text STRING, boost DOUBLE",
    "phrases": "key STRING, match ARRAY<STRING>, p MAP<STRING, DOUBLE>, level INT, pair BOOLEAN, words ARRAY<STRING>, attr ARRAY<STRING>, over BOOLEAN",
}
# Classes of provenance that a public catalog may hold.
PUBLIC_FACE = "a m l o s:kmoji s:kaomojiru s:fontvibe s:emojicombos".split()
PUBLIC_VOCAB = "own:cat own:lexicon own:agent own:model own:corpus own:phrase own:situation own:canonical own:gloss u:glyph ja:reduced s:kmoji s:kaomojiru s:fontvibe s:emojicombos".split()


def numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with their place in the file as `seq`; bad lines are left out."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    rows = lines.select("seq", F.from_json("value", schema + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return rows.where("j IS NOT NULL AND j._bad IS NULL").select("seq", "j.*").drop("_bad")


def read_lists(spark: SparkSession, path: str, k: int, name: str) -> DataFrame:
    """A file of little-endian 32-bit numbers, k a term -> list, term_idx, rank, row; NONE is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                own = np.frombuffer(blob, "<u4")
                at = np.flatnonzero(own != NONE)
                yield pd.DataFrame({"list": name, "term_idx": at // k, "rank": at % k, "row": own[at].astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "list string, term_idx int, rank int, row long")


def normalised(p: Column, emotions: list[str]) -> Column:
    """A profile as an array over the emotions, of sum 1 unless all is zero."""
    raw = F.transform(F.array(*map(F.lit, emotions)), lambda e: F.coalesce(F.try_element_at(p, e), F.lit(0.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: F.when(total == 0, x).otherwise(x / total).cast("float"))


def read_faces(faces: DataFrame) -> DataFrame:
    """Rows of faces.jsonl -> export rows: three attributes are given in thirds, quality is 5 if it is missing."""
    x = {n: F.coalesce(F.col("x")[i], F.lit(1.0 if n == "face" else 0.0)) / (3 if i < 3 else 1) for i, n in enumerate(EXTRAS)}
    return faces.select(
        "seq", "text", F.transform("r", lambda v: v.cast("float")).alias("r"), *[c.cast("float").alias(n) for n, c in x.items()],
        F.coalesce("q", F.lit(5.0)).cast("float").alias("quality"), F.when(F.col("c"), 1.0).otherwise(0.0).cast("float").alias("crude"), F.col("w").alias("words"), "wc",
    )


def read_vocab(vocab: DataFrame, emotions: list[str]) -> DataFrame:
    """Rows of vocab.jsonl -> key, p, m, n, tier, weak; the last of a key counts."""
    tier = F.when(F.col("src") == "cat", 2).when(F.contains("src", F.lit("engine")), 1).otherwise(0)
    rows = vocab.select("seq", F.col("t").alias("key"), normalised(F.col("p"), emotions).alias("p"), F.col("m").cast("float").alias("m"), F.coalesce("n", F.lit(0)).alias("n"), tier.alias("tier"), (F.col("src") == "e5").alias("weak"), "ev")
    return newest(rows, ["key"], ["seq"])


def read_aliases(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line) -> moved(old, new), retired(old, reason). Any bad line is an error."""
    rows = lines.where("trim(line) <> ''").select("line", F.from_json("line", "old STRING, new STRING, retired STRING, why STRING").alias("j")).select("line", "j.*")
    rows = rows.withColumns({"old": parsed_id(F.col("old")), "to": parsed_id(F.col("new"))})
    bad = F.col("old").isNull() | (F.col("new").isNotNull() == F.col("retired").isNotNull()) | (F.col("new").isNotNull() & F.col("to").isNull())
    wrong = rows.where(bad).select("line").limit(1).collect()
    if wrong:
        raise CatalogError(f"bad alias line: {wrong[0]['line']}")
    return rows.where("to IS NOT NULL").select("old", F.col("to").alias("new")), rows.where("retired IS NOT NULL").select("old", F.col("retired").alias("reason"))


def check_aliases(moved: DataFrame, retired: DataFrame, items: DataFrame) -> DataFrame:
    """moved with chains followed to their end. An id that is live, moves to itself, twice, or is moved and retired, one
    whose end is no item, and a circle are errors."""
    ids = items.select(F.col("face_id").alias("old"))
    for what, wrong in {
        "is live": moved.select("old").unionByName(retired.select("old")).join(ids, "old", "left_semi"),
        "moves to itself": moved.where("old = new").select("old"),
        "stands twice": moved.select("old").unionByName(retired.select("old")).groupBy("old").count().where("count > 1").select("old"),
    }.items():
        found = wrong.limit(1).collect()
        if found:
            raise CatalogError(f"alias {found[0]['old']} {what}")
    out = chains(moved).select("old", F.col("final").alias("new"))
    ends = out.select(F.col("new").alias("old")).join(ids.unionByName(retired.select("old")), "old", "left_anti").limit(1).collect()
    if ends:
        raise CatalogError(f"alias to unknown {ends[0]['old']}")
    return out


def read_selection(lines: DataFrame) -> DataFrame:
    """lines(line): one id a line, comments behind # -> face_id, each once. A line that is no id is an error."""
    clean = lines.select(F.trim(F.regexp_replace("line", "#.*$", "")).alias("t")).where("t <> ''").select("t", parsed_id(F.col("t")).alias("face_id"))
    wrong = clean.where("face_id IS NULL").limit(1).collect()
    if wrong:
        raise CatalogError(f"not an id: {wrong[0]['t']}")
    return clean.select("face_id").distinct()


def phrase_index(phrases: DataFrame) -> DataFrame:
    """phrases(seq, key, match) -> spelling (words joined by a space), key: the first phrase of a spelling has it; the key
    is a spelling too; spellings over LONGEST_PHRASE words are left out."""
    each = phrases.select("seq", "key", F.explode(F.array_union(F.array("key"), F.coalesce("match", F.array().cast("array<string>")))).alias("s"))
    each = each.withColumn("t", tokens(F.col("s"))).where((F.size("t") > 0) & (F.size("t") <= LONGEST_PHRASE))
    return each.groupBy(F.array_join("t", " ").alias("spelling")).agg(F.min_by("key", "seq").alias("key"), F.first(F.size("t")).alias("words"))


def sorted_situations(situations: DataFrame) -> DataFrame:
    """situations(name, ...) by name; a name twice is an error."""
    twice = situations.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise CatalogError(f"situation {twice[0]['name']} stands twice")
    return situations.orderBy("name")


def violations(rows: DataFrame, key: str, labels: Column, allowed: list[str]) -> DataFrame:
    """class, n: how often each class that a public catalog may not hold stands on rows; rows without labels count as
    class `unlabelled`."""
    each = rows.select(F.explode(F.when(F.size(labels) > 0, F.flatten(F.transform(labels, lambda x: F.split(x, ",")))).otherwise(F.array(F.lit("unlabelled")))).alias("c"))
    return each.select(F.trim("c").alias("class")).where(~F.col("class").isin(allowed)).groupBy("class").agg(F.count("*").alias("n"))


def check_public(faces: DataFrame, vocab: DataFrame, policy: str | None) -> None:
    """Raises with every class and count that breaks the public policy."""
    worded = faces.where("size(words) > 0").withColumn("wc", F.when(F.size("wc") == F.size("words"), F.col("wc")))
    found = [("face", r["class"], r["n"]) for r in violations(worded, "text", F.col("wc"), PUBLIC_FACE).collect()] + [("vocab", r["class"], r["n"]) for r in violations(vocab, "key", F.col("ev"), PUBLIC_VOCAB).collect()]
    if policy != "public":
        found.append(("meta", f"policy {policy}", 1))
    if found:
        raise CatalogError("the export breaks the public policy: " + ", ".join(f"{a} {b}: {n}" for a, b, n in sorted(found)))


def source_digest(parts: list[bytes]) -> str:
    """SHA-256 over the parts, each behind its length, so that no two lists of parts run together."""
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.hexdigest()


def is_stale(target: str, sources: list[str]) -> bool:
    """Whether a built catalog is missing or older than a source that is there."""
    if not os.path.exists(target):
        return True
    built = os.path.getmtime(target)
    return any(os.path.exists(s) and os.path.getmtime(s) > built for s in sources)


def merged_grammars(grammars: list[dict[str, list[str]]]) -> dict[str, list[str]]:
    """Word lists of all languages, each word once, in order."""
    out: dict[str, list[str]] = {}
    for g in grammars:
        for name, found in g.items():
            if isinstance(found, list):
                out[name] = list(dict.fromkeys([*out.get(name, []), *found]))
    return out


def compiled(faces: DataFrame, vocab: DataFrame, lists: DataFrame, canonical: DataFrame, boosts: DataFrame, phrases: DataFrame, moved: DataFrame, retired: DataFrame, manifest: dict[str, str], keep: DataFrame | None = None) -> Catalog:
    """Export rows -> a checked catalog. lists(list, term_idx, rank, row) count rows of faces in their order and terms by
    `idx` of vocab; the last boost of a term and item counts."""
    items = build_items(faces)
    check_items(items)
    rows = faces.select("row", "text").join(items.select("text", "face_id"), "text")
    near = build_neighbours(lists, rows).join(vocab.select(F.col("idx").alias("term_idx"), F.col("key").alias("term")), "term_idx").select("list", "term", "rank", "face_id")
    posted = items.select("face_id", F.explode("words").alias("w")).groupBy(F.lower("w.word").alias("word"), "face_id").agg((2 - F.min("w.tier")).cast("int").alias("tier"))
    pins = build_canonical(canonical, items)
    last = newest(boosts, ["term", "face_id"], ["seq"]).select("term", "face_id", "boost")
    tables = {"items": items.orderBy("face_id"), "terms": vocab, "neighbours": near, "postings": posted, "canonical": pins, "boosts": last, "phrases": phrase_index(phrases), "aliases": check_aliases(moved, retired, items)}
    out = Catalog(tables, dict(manifest) | {"emotions": ",".join(EMOTIONS)})
    if keep is not None:
        from .catalog import subset

        out = subset(out, keep, 1 << 30)
    return out


def read_export(spark: SparkSession, folder: str, emotions: list[str] = EMOTIONS) -> dict[str, DataFrame]:
    """meta.json, faces.jsonl, vocab.jsonl, dense.bin and engine.bin -> faces, vocab, lists, with rows numbered in order."""
    meta = spark.read.option("multiLine", True).json(f"{folder}/meta.json").head().asDict(recursive=True)
    order = lambda df, name: df.withColumn(name, F.row_number().over(_by_seq) - 1)
    from pyspark.sql.window import Window

    _by_seq = Window.orderBy("seq")  # numbers in the order of the file: one task, for an export of some hundred thousand rows
    faces = order(read_faces(numbered(spark, f"{folder}/faces.jsonl", FACE)), "row")
    vocab = order(read_vocab(numbered(spark, f"{folder}/vocab.jsonl", VOCAB), emotions), "idx")
    k = int(meta.get("dense_k", 32))
    lists = read_lists(spark, f"{folder}/dense.bin", k, "dense").unionByName(read_lists(spark, f"{folder}/engine.bin", k, "engine"))
    return {"faces": faces, "vocab": vocab, "lists": lists, "meta": spark.createDataFrame([(str(a), str(b)) for a, b in sorted(meta.items())], "key string, value string")}


def open_dataset(spark: SparkSession, folder: str, name: str = "full", others: tuple[str, ...] = ("core", "lite"), version: str | None = None) -> tuple[Catalog, list[str]]:
    """The dataset of that name, or the first other that can be opened, with a warning."""
    problems = []
    for n in (name, *(x for x in others if x != name)):
        try:
            found = open_catalog(spark, f"{folder}/{n}", version)
        except Exception as e:  # noqa: BLE001 - a missing folder is Spark's own error
            problems.append(f"{n}: {str(e).splitlines()[0]}")
            continue
        return found, [] if n == name else [f"dataset_fallback: {n} for {name} ({problems[0]})"]
    raise CatalogError("; ".join(problems))


def cut_bins(thresholds: list[float], low: float, high: float, bins: int) -> list[float]:
    """Edges of equal bins between low and high, with every threshold an edge too, so no value changes sides."""
    step = (high - low) / bins
    return sorted({low + step * i for i in range(bins + 1)} | {t for t in thresholds if low < t < high})


def quantised(value: Column, edges: list[float]) -> tuple[Column, Column]:
    """A value's bin and the middle of the bin."""
    inside = F.greatest(F.least(value, F.lit(edges[-1])), F.lit(edges[0]))
    bin_ = sum((F.when(inside >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    middles = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    return bin_, F.element_at(middles, bin_ + 1)
