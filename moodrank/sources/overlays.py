"""A person's own files over a catalog: pins, phrases, boosts, blocked items; layers on top of each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import face_id, norm_term, parsed_id, tokens
from ..operators.state import layered_pins, newest
from .catalog import read_blocklist, read_boosts

FILES = {"canonical.jsonl": "canonical", "phrases.jsonl": "phrases", "boosts.jsonl": "boosts", "blocklist.txt": "blocklist"}
PIN = "term STRING, id STRING, text STRING, rank BIGINT, clear BOOLEAN, _bad STRING"
PHRASE = "key STRING, match ARRAY<STRING>, p MAP<STRING, DOUBLE>, level INT, pair BOOLEAN, words ARRAY<STRING>, attr ARRAY<STRING>, alias_of STRING, _bad STRING"
DEMOTED = -3.0


def kind_of(name: str) -> str | None:
    return FILES.get(name.rsplit("/", 1)[-1])


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    rows = lines.withColumn("seq", F.monotonically_increasing_id()).where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    return rows.select("seq", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j")).select("seq", "j.*")


def read_pins(lines: DataFrame, layer: int) -> tuple[DataFrame, DataFrame]:
    """lines(line) -> pins(term, layer, rank, seq, face, clear), warnings(n, warning)."""
    row = _parsed(lines, PIN).withColumn("face", F.coalesce(parsed_id(F.col("id")), F.when(F.col("text").isNotNull(), face_id(F.col("text")))))
    warning = F.when(F.col("_bad").isNotNull(), "not JSON").when(F.trim(F.coalesce("term", F.lit(""))) == "", "no term").when(~F.coalesce("clear", F.lit(False)) & F.col("face").isNull(), "no item")
    row = row.withColumn("warning", warning)
    good = row.where("warning IS NULL").select(norm_term(F.col("term")).alias("term"), F.lit(layer).alias("layer"), F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "seq", "face", F.coalesce("clear", F.lit(False)).alias("clear"))
    return good, row.where("warning IS NOT NULL").select(F.col("seq").alias("n"), "warning")


def read_phrases(lines: DataFrame, layer: int) -> tuple[DataFrame, DataFrame]:
    """lines(line) -> spellings(spelling, layer, seq, key, p, level, pair, words, attr, alias_of), warnings(n, warning)."""
    row = _parsed(lines, PHRASE)
    known = F.coalesce(F.map_filter("p", lambda k, v: v > 0), F.create_map().cast("map<string,double>"))
    warning = (
        F.when(F.col("_bad").isNotNull(), "not JSON").when(F.trim(F.coalesce("key", F.lit(""))) == "", "no key")
        .when(F.col("alias_of").isNull() & (F.size(known) == 0), "no profile").when(~F.coalesce("level", F.lit(2)).isin(1, 2, 3), "level is 1, 2 or 3")
    )
    row = row.withColumn("warning", warning)
    spelt = row.where("warning IS NULL").withColumn("s", F.explode(F.array_union(F.array("key"), F.coalesce("match", F.array().cast("array<string>")))))
    spelt = spelt.withColumn("spelling", F.array_join(tokens(F.col("s")), " ")).where("spelling <> ''")
    return spelt.select("spelling", F.lit(layer).alias("layer"), "seq", norm_term(F.col("key")).alias("key"), known.alias("p"), "level", "pair", "words", "attr", "alias_of"), row.where("warning IS NOT NULL").select(F.col("seq").alias("n"), "warning")


@dataclass
class Overlay:
    """All layers in force, lowest first."""

    pins: list[DataFrame] = field(default_factory=list)
    phrases: list[DataFrame] = field(default_factory=list)
    boosts: list[DataFrame] = field(default_factory=list)
    hidden: list[DataFrame] = field(default_factory=list)
    warnings: list[DataFrame] = field(default_factory=list)
    layers: int = 0

    def add(self, files: dict[str, DataFrame]) -> Overlay:
        """One more layer: file name -> lines(line). A file of another name is told of and not read."""
        self.layers += 1
        for name, lines in files.items():
            kind = kind_of(name)
            note = lambda df, name=name: self.warnings.append(df.select(F.lit(name).alias("file"), "n", "warning"))
            if kind == "canonical":
                good, bad = read_pins(lines, self.layers)
                self.pins.append(good)
                note(bad)
            elif kind == "phrases":
                good, bad = read_phrases(lines, self.layers)
                self.phrases.append(good)
                note(bad)
            elif kind == "boosts":
                good, bad = read_boosts(lines)
                self.boosts.append(good.withColumn("layer", F.lit(self.layers)))
                note(bad)
            elif kind == "blocklist":
                self.hidden.append(read_blocklist(lines))
            else:
                note(lines.limit(1).select(F.lit(0).cast("long").alias("n"), F.lit("unknown file").alias("warning")))
        return self


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def canonical_in_force(shipped: DataFrame, overlay: Overlay, boosts: DataFrame | None = None) -> DataFrame:
    """shipped(term, face_id, place) under the overlay's pins -> term, face_id, place, user. A term with any line of an
    overlay, clearing ones too, has only the overlay's; what a person demoted is no longer pinned, unless they pinned it."""
    own = _union(overlay.pins)
    base = shipped.select("term", "face_id", "place", F.lit(False).alias("user"))
    if boosts is not None:
        base = base.join(boosts.where(F.col("boost") <= DEMOTED).select("term", "face_id"), ["term", "face_id"], "left_anti")
    if own is None:
        return base
    pinned = layered_pins(own).select("term", F.col("face").alias("face_id"), (F.col("place") - 1).alias("place"), F.lit(True).alias("user"))
    return base.join(own.select("term").distinct(), "term", "left_anti").unionByName(pinned)


def boosts_in_force(shipped: DataFrame, overlay: Overlay) -> DataFrame:
    """shipped(term, face_id, boost), each pair's boost by the highest layer that has it."""
    rows = _union([shipped.select("term", "face_id", F.col("boost").cast("double").alias("boost"), F.lit(0).alias("layer")), *[b.select("term", "face_id", F.col("boost").cast("double").alias("boost"), "layer") for b in overlay.boosts]])
    return newest(rows, ["term", "face_id"], ["layer"]).select("term", "face_id", "boost")


def spellings_in_force(overlay: Overlay) -> DataFrame | None:
    """Each spelling's last phrase, of the highest layer."""
    rows = _union(overlay.phrases)
    return None if rows is None else newest(rows, ["spelling"], ["layer", "seq"])


def hidden_in_force(overlay: Overlay, *blocklists: DataFrame) -> DataFrame | None:
    """Blocked by any file or hidden by any layer, each id once."""
    rows = _union([*overlay.hidden, *blocklists])
    return None if rows is None else rows.select("face_id").distinct()


def read_folder(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(FILES)) -> dict[str, DataFrame]:
    """The overlay files that a folder holds."""
    jvm = spark.sparkContext._jvm
    out = {}
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.read.text(f"{folder}/{name}").select(F.col("value").alias("line"))
    return out
