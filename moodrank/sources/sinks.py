"""Sinks: lines appended under a lock, a database that takes each key once, and verified files."""

from __future__ import annotations

import fcntl
import hashlib
import os
import sqlite3
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(path: str, rows: DataFrame) -> int:
    """Rows as JSON lines at the end of a file, each in one write under an advisory lock: for small local state."""
    n = 0
    with open(path, "ab") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        for row in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator():
            f.write((row["j"] + "\n").encode())
            n += 1
        f.flush()
        os.fsync(f.fileno())
    return n


def insert_or_ignore(path: str, table: str, key: str, rows: DataFrame) -> int:
    """Rows into a SQLite table, those whose key is there already left out; how many went in. For a foreachBatch, which may
    come again: the same rows twice change nothing."""
    columns = rows.columns
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({", ".join(chr(34) + c + chr(34) for c in columns)}, PRIMARY KEY ("{key}"))')
        before = db.total_changes
        db.executemany(f'INSERT OR IGNORE INTO "{table}" VALUES ({", ".join("?" * len(columns))})', (tuple(r) for r in rows.toLocalIterator()))
        return db.total_changes - before


def dump(path: str, table: str, since, ts: str, key: str) -> Iterable[tuple]:
    with sqlite3.connect(path) as db:
        yield from db.execute(f'SELECT * FROM "{table}" WHERE "{ts}" >= ? ORDER BY "{ts}", "{key}"', (since,))


def verified(folder: str, sums: str) -> list[str]:
    """Names in a file of SHA-256 sums whose file is missing or different."""
    wrong = []
    with open(sums, encoding="utf-8") as f:
        for line in f:
            digest, _, name = line.strip().partition("  ")
            if not name:
                continue
            path = os.path.join(folder, name.lstrip("*"))
            if not os.path.isfile(path) or _digest(path) != digest:
                wrong.append(name)
    return wrong


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()
