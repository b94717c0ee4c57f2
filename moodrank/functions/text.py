"""Text functions as columns, and the two that need Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{IsAlphabetic}\p{N}'$]+"
SYMBOL = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}\-']|[[^\x00-\x7F]&&[^\p{IsAlphabetic}]]"
QUERY_CHARS = 256


def tokens(text: Column) -> Column:
    """Lower-case runs of letters with their vowel signs, digits, apostrophe and dollar."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def cut(text: Column) -> Column:
    return F.substring(text, 1, QUERY_CHARS)


def norm_term(text: Column) -> Column:
    return F.lower(F.trim(text))


def collapsed(text: Column) -> Column:
    """One space for each run of white space, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def char_set(text: Column) -> Column:
    """Sorted distinct characters without white space."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)\S"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of characters; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def face_hex(text: Column) -> Column:
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12)


def face_id(text: Column) -> Column:
    """48 bits of the digest of the exact text."""
    return F.conv(face_hex(text), 16, 10).cast("long")


def shown_id(text: Column) -> Column:
    return F.concat(F.lit("k"), face_hex(text))


def parsed_id(shown: Column) -> Column:
    """k and 12 lower-case hex digits, or the digits alone; else null."""
    return F.when(shown.rlike("^k?[0-9a-f]{12}$"), F.conv(F.right(shown, F.lit(12)), 16, 10).cast("long"))


SLOTS = {"read_well": "verdict", "read_wrong": "verdict", "missing": "missing", "great_fit": "fit", "other_word": "fit", "no_fit": "fit", "offensive": "offensive", "note": "note"}
"""Fixed values: reasons of one slot replace each other."""


def slot_of(reason: Column, clears: Column) -> Column:
    """A clearing report takes the slot of what it clears; without that, none."""
    slots = F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv])
    return F.coalesce(F.try_element_at(slots, F.when(reason == "clear", clears).otherwise(reason)), F.lit(""))


def report_key(query: Column, target: Column, slot: Column) -> Column:
    zero = F.lit("\0")
    return F.substring(F.sha1(F.encode(F.concat(query, zero, target, zero, slot), "UTF-8")), 1, 16)


def is_glyphy(text: Column) -> Column:
    """Symbols stand in it, end marks aside; end marks alone are symbols, and so is what is neither ASCII nor a letter."""
    bare = F.regexp_replace(text, r"[!?.,;:]+$", "")
    return F.when(bare == "", text).otherwise(bare).rlike(SYMBOL)


def squeezed_to_two(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1$1")


def squeezed_to_one(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def osa(a: str, b: str, cap: int) -> int:
    """Edits between a and b where a swap of neighbours is one and no part is edited twice; cap + 1
    if there are more than cap."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        if min(new) > cap:
            return cap + 1
        before, row = row, new
    return min(row[-1], cap + 1)


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, int(c)) for x, y, c in zip(a, b, cap)], dtype="int32")


def splitmix64(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(T.FloatType())
def jitter(seed: pd.Series, face: pd.Series) -> pd.Series:
    """A number in [0, 1) from seed and id, for variety."""
    mixed = splitmix64(seed.to_numpy().astype(np.int64).view(np.uint64) ^ face.to_numpy().astype(np.int64).view(np.uint64))
    return pd.Series(((mixed >> np.uint64(40)).astype(np.float64) / 2.0**24).astype(np.float32))
