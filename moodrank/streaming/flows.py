"""Stateful behaviour on streams, with the batch operators' results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def superseded(batch: DataFrame, _: int = 0) -> DataFrame:
    """In one micro-batch, the last request of each channel that none after it cancels; requests without a
    channel all stand. batch(seq, chan, op, cancels)"""
    last = batch.where("chan IS NOT NULL").groupBy("chan").agg(F.max("seq").alias("last"))
    cancelled = batch.where("cancels IS NOT NULL").groupBy(F.col("cancels").alias("id")).agg(F.max("seq").alias("cancel_at"))
    out = batch.join(last, "chan", "left").join(cancelled, F.col("seq") == F.col("id"), "left")
    keep = (F.col("chan").isNull() | (F.col("seq") == F.col("last"))) & (F.col("cancel_at").isNull() | (F.col("cancel_at") < F.col("seq")))
    return out.where(keep).select(*batch.columns)


def once(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key's first event within the time that events may be late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def settled(events: DataFrame, ts: str, delay_s: float = 120.0, since_s: float | None = None) -> DataFrame:
    """Each event itself, once it is older than the newest event seen by the delay (120 seconds: a person may still
    change their mind); events before `since_s` never. A row waits in state until the watermark has passed it."""
    rows = events if since_s is None else events.where(F.col(ts) >= F.timestamp_seconds(F.lit(since_s)))
    late = rows.withWatermark(ts, f"{int(delay_s)} seconds")
    # One group a row and instant: append mode sends a window when the watermark has passed its end.
    whole = late.groupBy(F.window(ts, "1 second").alias("_w"), F.struct(*events.columns).alias("_row")).agg(F.count("*").alias("_n"))
    return whole.select(F.col("_row.*"), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k")).drop("_k")


RECENT = 32
"""Searches that are remembered, so that a pick or report can name one."""


def recent(session: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's last searches by number; an event that is about one gets its query, null if it is forgotten.
    Rows (session, seq, op, query, about)."""
    kept: list = list(zip(*state.get)) if state.exists else []
    out = []
    for seq, op, query, about in sorted((r for pdf in batches for r in pdf[["seq", "op", "query", "about"]].itertuples(index=False, name=None)), key=lambda r: r[0]):
        if op == "search":
            kept = [*kept, (int(seq), query)][-RECENT:]
        elif about is not None and about == about:
            out.append((session[0], int(seq), op, dict(kept).get(int(about))))
    state.update(([k[0] for k in kept], [k[1] for k in kept]))
    yield pd.DataFrame(out, columns=["session", "seq", "op", "query"])


def about_recent(requests: DataFrame) -> DataFrame:
    """requests(session, seq, op, query, about) -> session, seq, op, query of what refers to a recent search."""
    rows = requests.select(F.col("session").cast("string"), F.col("seq").cast("long"), "op", "query", F.col("about").cast("double"))
    return rows.groupBy("session").applyInPandasWithState(recent, "session string, seq long, op string, query string", "seqs array<long>, queries array<string>", "append", GroupStateTimeout.NoTimeout)


def idle(seconds: float) -> Callable:
    """Tells that a session is over when nothing came from it for so long."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "requests": [int(n)]})
            return
        n = sum(len(pdf) for pdf in batches)
        state.update(((state.get[0] if state.exists else 0) + n,))
        state.setTimeoutDuration(int(seconds * 1000))

    return run


def idle_sessions(requests: DataFrame, seconds: float) -> DataFrame:
    rows = requests.select(F.col("session").cast("string").alias("session"))
    return rows.groupBy("session").applyInPandasWithState(idle(seconds), "session string, requests long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Watched:
    """A folder's tables, read anew when its files changed, looked at once in `every_s` at most."""

    def __init__(self, signature: Callable[[], object], load: Callable[[], object], every_s: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.signature, self.load, self.every_s, self.clock = signature, load, every_s, clock
        self.seen, self.value, self.looked = signature(), load(), clock()

    def get(self) -> object:
        if self.clock() - self.looked >= self.every_s:
            self.looked = self.clock()
            now = self.signature()
            if now != self.seen:
                self.seen, self.value = now, self.load()
        return self.value


def sender(events: DataFrame, post: Callable[[list[str]], bool], checkpoint: str, batch: int = 50, every: str | None = "60 seconds"):
    """Posts rows as JSON lines, `batch` at once; a refused batch fails the micro-batch, which comes again after a restart.
    Rows go out partition by partition through the driver, a batch at a time."""

    def run(rows: DataFrame, _: int) -> None:
        lines: list[str] = []
        for row in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator():
            lines.append(row["j"])
            if len(lines) == batch:
                if not post(lines):
                    raise ConnectionError("refused")
                lines = []
        if lines and not post(lines):
            raise ConnectionError("refused")

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rate_limited(events: DataFrame, ts: str, client: str, most: int) -> DataFrame:
    """Clients and hours over the limit."""
    counted = events.withWatermark(ts, "1 hour").groupBy(F.window(ts, "1 hour"), client).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(F.col("window.start").alias("hour"), client, "n")


def decay(half_life_s: float, forget: float = 1e-3) -> Callable:
    """State of a key's weight: it halves each half life and is forgotten below `forget`; an event that is older than
    the last counts whole and does not turn the clock back."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, at = state.get if state.exists else (0.0, float("-inf"))
        for t in sorted(t for pdf in batches for t in pdf["ts_s"].tolist()):
            if t > at:
                weight *= 0.5 ** ((t - at) / half_life_s) if weight else 1.0
                weight, at = weight if weight >= forget else 0.0, float(t)
            weight += 1.0
        state.update((float(weight), float(at)))
        yield pd.DataFrame({"key": [key[0]], "weight": [weight], "updated_s": [at]})

    return run


def decayed_usage(events: DataFrame, key: str, half_life_s: float) -> DataFrame:
    """events(key, ts_s) -> key, weight, updated_s after each micro-batch (update mode)."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col("ts_s").cast("double").alias("ts_s"))
    return rows.groupBy("key").applyInPandasWithState(decay(half_life_s), "key long, weight double, updated_s double", "weight double, at double", "update", GroupStateTimeout.NoTimeout)


def tally(days: int) -> Callable:
    """A period opens with a key's first event and closes with the first event after that many days."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (0.0, 0)
        out = []
        for pdf in batches:
            for t in pdf["ts_s"].sort_values():
                if n and t - opened >= days * 86400:
                    out.append((key[0], opened, int(n)))
                    n = 0
                if not n:
                    opened = float(t)
                n += 1
        state.update((float(opened), int(n)))
        yield pd.DataFrame(out, columns=["key", "opened_s", "n"])

    return run


def tallied(events: DataFrame, key: str, days: int = 7) -> DataFrame:
    rows = events.select(F.col(key).cast("long").alias("key"), F.col("ts_s").cast("double").alias("ts_s"))
    return rows.groupBy("key").applyInPandasWithState(tally(days), "key long, opened_s double, n long", "opened double, n long", "append", GroupStateTimeout.NoTimeout)
