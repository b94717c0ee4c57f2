"""Picks and reports: checks, keys, local effects, what is still to be sent, and the collector's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import face_id, norm_term, report_key, shown_id, slot_of
from .state import decayed, estimated

# Reasons of a report on an item, on a query, on either; and bounds.
FACE_REASONS = ["great_fit", "other_word", "no_fit", "offensive"]
QUERY_REASONS = ["read_well", "read_wrong", "missing"]
EITHER = ["note", "clear"]
SHOWN_MOST, NOTE_MOST = 20, 500
DEMOTE = -3.0


def keyed(reports: DataFrame) -> DataFrame:
    """reports(query, face_id, reason, clears, ...) with the key that later reports replace them by."""
    target = F.when(F.col("face_id").isNull(), F.lit("query")).otherwise(F.concat(F.lit("k"), F.lpad(F.lower(F.hex("face_id")), 12, "0")))
    return reports.withColumn("key", report_key(norm_term(F.col("query")), target, slot_of(F.col("reason"), F.col("clears"))))


def error(note_most: int = NOTE_MOST) -> Column:
    """What is wrong with a report(reason, face_id, note, shown), null if nothing is."""
    c = F.col
    empty = F.trim(F.coalesce(c("note"), F.lit(""))) == ""
    return (
        F.when(~F.coalesce(c("reason").isin(FACE_REASONS + QUERY_REASONS + EITHER), F.lit(False)), "unknown reason")
        .when(c("reason").isin(FACE_REASONS) & c("face_id").isNull(), "reason needs a face")
        .when(c("reason").isin(QUERY_REASONS) & c("face_id").isNotNull(), "reason needs a query")
        .when((c("reason") == "note") & empty, "note required")
        .when(F.char_length("note") > note_most, "note too long")
        .when(F.size("shown") > SHOWN_MOST, "too many shown")
    )


def checked(reports: DataFrame, note_most: int = NOTE_MOST) -> tuple[DataFrame, DataFrame]:
    """Good ones, and (index, error) of the others; a key that is not the report's own is an error too."""
    own = keyed(reports.withColumnRenamed("key", "given")) if "key" in reports.columns else keyed(reports).withColumn("given", F.col("key"))
    own = own.withColumn("error", F.coalesce(error(note_most), F.when(F.col("given") != F.col("key"), "key does not match")))
    return own.where("error IS NULL").drop("error", "given"), own.where("error IS NOT NULL").select("index", "error")


def effects(reports: DataFrame) -> DataFrame:
    """What reports do on this machine at once: effect (block, pick, demote), face_id, term, boost. Clearing undoes it
    (undo)."""
    c = F.col
    what = F.when(c("reason") == "clear", c("clears")).otherwise(c("reason"))
    effect = F.when(what == "offensive", "block").when(what == "great_fit", "pick").when((what == "no_fit") & c("term_key").isNotNull(), "demote")
    return reports.where("face_id IS NOT NULL").select(effect.alias("effect"), "face_id", c("term_key").alias("term"), F.when(effect == "demote", DEMOTE).alias("boost"), (c("reason") == "clear").alias("undo")).where("effect IS NOT NULL")


def blocked_after(events: DataFrame) -> DataFrame:
    """events(face_id, seq, undo): items whose last block was not undone."""
    return events.groupBy("face_id").agg(F.max_by("undo", "seq").alias("undo")).where("NOT undo").select("face_id")


def pending(queue: DataFrame, sent: DataFrame, now: Column, settle_s: float = 120.0, most_age_s: float | None = None, since: Column | None = None) -> DataFrame:
    """queue(report_id, key, reason, ts, seq), sent(report_id, key, clear, sent_at) -> what is to be sent now: the last report
    of each key, not sent yet, settled, not too old and not from before the consent. A clearing report goes out only if
    what it clears is there: the key's last sent report is no clearing one."""
    last = queue.groupBy("key").agg(F.max_by(F.struct(*queue.columns), "seq").alias("row")).select("row.*")
    last = last.join(sent.select("report_id"), "report_id", "left_anti")
    live = sent.groupBy("key").agg(F.max_by("clear", "sent_at").alias("cleared")).where("NOT cleared").select("key")
    out = last.where("reason <> 'clear'").unionByName(last.where("reason = 'clear'").join(live, "key", "left_semi"))
    age = F.unix_micros(now) / 1e6 - F.unix_micros("ts") / 1e6
    out = out.where(age >= settle_s)
    if most_age_s is not None:
        out = out.where(age <= most_age_s)
    return out if since is None else out.where(F.col("ts") >= since)


def import_picks(log: DataFrame, now: Column, half_life_s: float) -> DataFrame:
    """A pick log(kind, q, text, ts in seconds) -> face_id, term, weight: every pick once for the item and once for the
    query's words, halved each half life. Rows of other kinds are left out."""
    picks = log.where("kind IS NULL OR kind = 'pick'").select(face_id(F.col("text")).alias("face_id"), norm_term(F.regexp_replace("q", r"\s+", " ")).alias("term"), F.timestamp_seconds("ts").alias("at"))
    both = picks.unionByName(picks.withColumn("term", F.lit(None).cast("string")))
    return decayed(both, ["face_id", "term"], F.col("at"), now, half_life_s)


# The collector


def accepted(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not stored yet, the first of each key."""
    return batch.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def dumped(stored: DataFrame, since: Column, ts: str, key: str) -> DataFrame:
    return stored.where(F.col(ts) >= since).orderBy(ts, key)


def last_periods(uploads: DataFrame, period: Column, value: Column, n: int) -> DataFrame:
    """period, n: sums of the last n periods that have uploads, newest first."""
    return uploads.groupBy(period.alias("period")).agg(value.cast("long").alias("n")).orderBy(F.col("period").desc()).limit(n)


def week_name(day: Column) -> Column:
    """Year and number of the week, weeks from Monday; days before the first Monday are week 00."""
    to_monday = F.pmod(F.dayofweek(day) + 5, F.lit(7))  # days since Monday
    week = F.floor((F.dayofyear(day) - 1 - to_monday + 7) / 7)
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def rollups(uploads: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
    """uploads(day, first_week, first_month), counts(face, bucket) -> installs by day, week and month, most picked items."""
    day = F.col("day")
    return {
        "days": last_periods(uploads, day.cast("string"), F.count("*"), 14),
        "weeks": last_periods(uploads, week_name(day), F.sum(F.col("first_week").cast("int")), 8),
        "months": last_periods(uploads, F.date_format(day, "yyyy-MM"), F.sum(F.col("first_month").cast("int")), 6),
        "picked": counts.groupBy("face").agg(F.sum(estimated(F.col("bucket"))).alias("n")).orderBy(F.col("n").desc(), "face").limit(20),
    }


def with_firsts(pings: DataFrame) -> DataFrame:
    """pings(install, day) -> the first of a day, with whether it is the install's first of the week and of the month."""
    once = pings.select("install", "day").distinct()
    first = lambda unit: F.row_number().over(Window.partitionBy("install", F.date_trunc(unit, "day")).orderBy("day")) == 1
    return once.withColumns({"first_week": first("week"), "first_month": first("month")})


def shown(ids: Column) -> Column:
    return F.transform(F.slice(ids, 1, SHOWN_MOST), lambda x: shown_id(x))
