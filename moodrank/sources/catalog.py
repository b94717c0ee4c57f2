"""The catalog: items, terms and lists as tables; building, checking and opening them; overlay files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import char_set, face_id, parsed_id

TABLES = ["items", "terms", "neighbours", "postings", "phrases", "canonical", "boosts", "aliases"]
ITEM = [
    ("face_id", "BIGINT"), ("text", "STRING"), ("r", "ARRAY<FLOAT>"), ("multi", "FLOAT"), ("cute", "FLOAT"), ("intensity", "FLOAT"), ("suggestive", "FLOAT"), ("lenny", "FLOAT"),
    ("face", "FLOAT"), ("quality", "FLOAT"), ("crude", "FLOAT"), ("len", "INT"), ("chars", "ARRAY<STRING>"), ("words", "ARRAY<STRUCT<word STRING, tier TINYINT>>"),
]
EMOTION_COUNT = 19


class CatalogError(ValueError):
    pass


@dataclass
class Catalog:
    tables: dict[str, DataFrame]
    manifest: dict[str, str]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def build_items(export: DataFrame) -> DataFrame:
    """export(text, r, multi, ...) -> items with id, length and character set, best tier first per word."""
    return export.select(
        face_id(F.col("text")).alias("face_id"), "text", "r", "multi", "cute", "intensity", "suggestive", "lenny", "face", "quality", "crude",
        F.char_length("text").alias("len"), char_set(F.col("text")).alias("chars"), "words",
    )


def check_items(items: DataFrame) -> None:
    """Raises for ids that repeat, wrong lengths and numbers that are none."""
    numbers = ["multi", "cute", "intensity", "suggestive", "lenny", "face", "quality", "crude"]
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    wrong = F.exists("r", bad) | (F.size("r") != EMOTION_COUNT)
    for n in numbers:
        wrong = wrong | bad(F.col(n))
    if items.where(wrong).limit(1).count():
        raise CatalogError("an item has a wrong number")
    if items.groupBy("face_id").count().where("count > 1").limit(1).count():
        raise CatalogError("an id repeats")


def build_canonical(picks: DataFrame, items: DataFrame, most: int = 3) -> DataFrame:
    """picks(term, text, rank, hand, seq) -> term, face_id, place: by hand first, then rank and order; each
    item once; texts that are not in the catalog are left out."""
    known = picks.join(items.select("text", "face_id"), "text").withColumn("term", F.lower("term"))
    once = known.groupBy("term", "face_id").agg(F.min(F.struct((~F.col("hand")).alias("h"), "rank", "seq")).alias("at"))
    order = Window.partitionBy("term").orderBy("at", "face_id")
    return once.withColumn("place", (F.row_number().over(order) - 1).cast("int")).where(F.col("place") < most).select("term", "face_id", "place")


def build_neighbours(lists: DataFrame, items: DataFrame) -> DataFrame:
    """lists(list, term_idx, rank, row) with row numbers in export order -> face ids; unknown rows are left
    out and the later ranks stay."""
    return lists.join(items.select("row", "face_id"), "row").select("list", "term_idx", "rank", "face_id")


def subset(catalog: Catalog, keep: DataFrame, neighbours: int) -> Catalog:
    """Only the items of keep(face_id), and lists of that length."""
    tables = dict(catalog.tables)
    for name in ("items", "neighbours", "postings", "canonical", "boosts"):
        if name in tables:
            tables[name] = tables[name].join(keep.select("face_id").distinct(), "face_id", "left_semi")
    if "neighbours" in tables:
        tables["neighbours"] = tables["neighbours"].where(F.col("rank") < neighbours)
    return Catalog(tables, dict(catalog.manifest))


def checksum_row(df: DataFrame) -> DataFrame:
    """rows and checksum, one row: the sum of all rows' hashes, so that equal rows do not cancel out."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def checksum(df: DataFrame) -> str:
    """The same for the same rows in any order."""
    row = checksum_row(df).head()
    return f"{row['rows']}:{row['checksum']}"


def _paths(spark: SparkSession, *names: str):
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), paths


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a folder aside and then put it in the place of the old one, so that a reader finds the old or the new."""
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(aside)
    fs, (target, new, gone) = _paths(spark, path, aside, old)
    had = fs.exists(target)
    if had and not fs.rename(target, gone):
        raise CatalogError(f"cannot move {path}")
    if not fs.rename(new, target):
        if had:
            fs.rename(gone, target)
        raise CatalogError(f"cannot replace {path}")
    if had:
        fs.delete(gone, True)


def save(catalog: Catalog, path: str) -> None:
    """Checked, written aside with a manifest that holds each table's checksum, and put in place."""
    spark = next(iter(catalog.tables.values())).sparkSession
    if "items" in catalog.tables:
        check_items(catalog["items"])

    def write(folder: str) -> None:
        manifest = dict(catalog.manifest)
        for name, df in catalog.tables.items():
            df.write.parquet(f"{folder}/{name}")
            manifest[f"checksum.{name}"] = checksum(spark.read.parquet(f"{folder}/{name}"))
        spark.createDataFrame(sorted(manifest.items()), "key string, value string").coalesce(1).write.parquet(f"{folder}/manifest")

    replaced(spark, path, write)


def open_catalog(spark: SparkSession, path: str, version: str | None = None, verify: bool = False) -> Catalog:
    """Tables named in the manifest; refuses another data version, and on request tables that changed."""
    manifest = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/manifest").collect()}
    found = manifest.get("data_version", "")
    # Versions X.Y with the same X can be read by one engine; other names only as they are.
    major = lambda v: v.split(".")[0] if re.fullmatch(r"\d+\.\d+", v) else v
    if version is not None and found != "dev" and major(found) != major(version):
        raise CatalogError(f"data version {found}, not {version}")
    tables = {k.removeprefix("checksum."): spark.read.parquet(f"{path}/{k.removeprefix('checksum.')}") for k in manifest if k.startswith("checksum.")}
    if verify:
        for name, df in tables.items():
            if checksum(df) != manifest[f"checksum.{name}"]:
                raise CatalogError(f"table {name} has changed")
    return Catalog(tables, manifest)


def id_status(ids: DataFrame, items: DataFrame, aliases: DataFrame, retired: DataFrame) -> DataFrame:
    """ids(id) -> id, status, now: live, moved to another id, retired, or unknown."""
    out = ids.join(items.select(F.col("face_id").alias("id"), F.lit(True).alias("live")), "id", "left")
    out = out.join(aliases.select(F.col("old").alias("id"), "new"), "id", "left").join(retired.select(F.col("face_id").alias("id"), "reason"), "id", "left")
    status = F.when(F.col("live"), "live").when(F.col("new").isNotNull(), "moved").when(F.col("reason").isNotNull(), "retired").otherwise("unknown")
    return out.select("id", status.alias("status"), F.coalesce("new", F.when(F.col("live"), F.col("id"))).alias("now"))


BOOST = "term STRING, id STRING, text STRING, boost DOUBLE, why STRING, _corrupt STRING"


def read_boosts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line) of a boost overlay -> (term, face_id, boost within -3 and 3; the last line of a pair wins), (line
    number and warning of lines left out)."""
    numbered = lines.withColumn("n", F.monotonically_increasing_id()).where(F.trim("line") != "")
    row = numbered.select("n", F.from_json("line", BOOST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j")).select("n", "j.*")
    row = row.withColumn("face_id", F.coalesce(parsed_id(F.col("id")), F.when(F.col("text").isNotNull(), face_id(F.col("text")))))
    warning = F.when(F.col("_corrupt").isNotNull(), "not JSON").when(F.col("term").isNull(), "no term").when(F.col("face_id").isNull(), "no item").when(F.col("boost").isNull() | F.isnan("boost"), "no boost")
    row = row.withColumn("warning", warning)
    good = row.where("warning IS NULL").groupBy(F.lower(F.trim("term")).alias("term"), "face_id").agg(F.max_by("boost", "n").alias("boost"))
    return good.withColumn("boost", F.greatest(F.least("boost", F.lit(3.0)), F.lit(-3.0)).cast("float")), row.where("warning IS NOT NULL").select("n", "warning")


def read_blocklist(lines: DataFrame) -> DataFrame:
    """lines(line): an id or an exact text each, comments after `# ` -> face_id, each once."""
    clean = lines.select(F.trim(F.regexp_replace("line", r"(^|\s)#( .*)?$", "")).alias("t")).where((F.length("t") > 0) & (F.length("t") <= 300))
    return clean.select(F.coalesce(parsed_id(F.col("t")), face_id(F.col("t"))).alias("face_id")).distinct()
