"""Options, policies and settings in layers: plain Python for one request, columns for a batch."""

from __future__ import annotations

import math
import threading
import tomllib
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = ["default", "system", "system_profile", "user", "user_profile", "request", "env", "cli", "policy"]
STYLES = ["allow", "hide"]


@dataclass(frozen=True)
class Options:
    limit: int = 30
    offset: int = 0
    long_at: int = 14
    min_quality: float | None = None
    max_len: int | None = None
    variety: float = 0.0
    faces_only: bool = False
    thinning: str = "normal"
    safety: str = "normal"
    usage: str = "normal"
    emotions_min: dict = field(default_factory=dict)
    emotions_max: dict = field(default_factory=dict)
    target: dict = field(default_factory=dict)
    styles: dict = field(default_factory=dict)
    exclude: tuple = ()
    pinned: bool = True
    figures: str = "auto"
    intensity: str = "auto"
    glyph: bool = True
    complete: bool = True
    seed: int = 0
    explain: str = "off"


BOUNDS = {"limit": (1, 500), "long_at": (1, None), "min_quality": (1, 8), "variety": (0, 1), "offset": (0, None)}
CHOICES = {"thinning": ("off", "normal", "strong"), "safety": ("off", "normal", "strict"), "usage": ("off", "low", "normal", "strong"), "figures": ("auto", "any", "single", "pair"), "intensity": ("auto", "low", "high"), "explain": ("off", "reading", "full")}


def validated(options: Options) -> tuple[Options, list[str]]:
    """Options within bounds, and a warning for each one that was not. Nothing is refused."""
    warnings, change = [], {}
    for name, (low, high) in BOUNDS.items():
        value = getattr(options, name)
        if value is None:
            continue
        fixed = low if isinstance(value, float) and math.isnan(value) else value
        fixed = max(fixed, low)
        fixed = fixed if high is None else min(fixed, high)
        if fixed != value:
            change[name] = fixed
            warnings.append(f"{name}: {value} is out of range")
    for name, known in CHOICES.items():
        if getattr(options, name) not in known:
            change[name] = getattr(Options(), name)
            warnings.append(f"{name}: unknown value {getattr(options, name)}")
    styles = {k: v for k, v in options.styles.items() if k in ("lenny", "crude", "long") and v in ("auto", *STYLES)}
    if styles != options.styles:
        change["styles"] = styles
        warnings.append("styles: unknown name or value")
    for name in ("emotions_min", "emotions_max", "target"):
        given = getattr(options, name)
        fixed = {k: min(max(0.0 if math.isnan(v) else v, 0.0), 1.0) for k, v in given.items()}
        if fixed != given:
            change[name] = fixed
            warnings.append(f"{name}: out of range")
    return replace(options, **change), warnings


def resolved(layers: dict[str, dict]) -> tuple[dict, dict[str, str]]:
    """Later layers win, key by key; the layer that each value came from."""
    values, origin = {}, {}
    for layer in sorted(layers, key=LAYERS.index):
        for key, value in layers[layer].items():
            values[key], origin[key] = value, layer
    return values, origin


def load_toml(text: str, profile: str | None = None) -> tuple[dict, list[str]]:
    """Dotted keys of a settings file, a profile's over the others; an unreadable one gives a warning."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return {}, [f"unreadable: {e}"]

    def walk(node: dict, prefix: str = "") -> dict:
        out = {}
        for k, v in node.items():
            out |= walk(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
        return out

    profiles = data.pop("profile", {})
    return walk(data) | walk(profiles.get(profile, {})), []


def load_policy(text: str | None) -> dict:
    """Ceilings and locks; a policy that cannot be read closes everything it could open."""
    closed = {"ceilings": {"innuendo": 0}, "locks": {"safety": "strict", "feedback.send": False}}
    if text is None:
        return {"ceilings": {}, "locks": {}}
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return closed
    locks, ceilings = dict(data.get("locks", {})), dict(data.get("ceilings", {}))
    if "feedback.send" in locks:  # can only be locked shut
        locks["feedback.send"] = False
    # A value that is none becomes the strictest.
    for rules in (locks, ceilings):
        if rules.get("safety", "strict") not in SAFETY:
            rules["safety"] = "strict"
    for name in ("styles.lenny", "styles.crude", "styles.long"):
        if locks.get(name, "hide") not in ("auto", *STYLES):
            locks[name] = "hide"
    if "innuendo" in ceilings and (isinstance(ceilings["innuendo"], bool) or not isinstance(ceilings["innuendo"], (int, float))):
        ceilings["innuendo"] = 0
    return {"ceilings": ceilings, "locks": locks}


CLAMP_ORDER = ["safety", "styles.lenny", "styles.crude", "styles.long", "popularity.enabled", "usage", "feedback.send"]
"""Names that a policy changes are told in this order, others after them by name."""
SAFETY = ["off", "normal", "strict"]


def clamped(values: dict, policy: dict) -> tuple[dict, list[str]]:
    """Ceilings, then locks; where popularity is locked off, usage counts for nothing. And the names that changed. The
    ceiling of a safety is the least strict one."""
    out = dict(values)
    for name, most in policy["ceilings"].items():
        if name == "safety":
            if most in SAFETY and SAFETY.index(out.get(name, "normal")) < SAFETY.index(most):
                out[name] = most
        elif name in out and out[name] > most:
            out[name] = most
    out |= policy["locks"]
    if out.get("popularity.enabled") is False and "usage" in out:
        out["usage"] = "off"
    changed = [k for k in out if out[k] != values.get(k)]
    return out, sorted(changed, key=lambda k: (CLAMP_ORDER.index(k) if k in CLAMP_ORDER else len(CLAMP_ORDER), k))


def derived(values: dict) -> dict:
    """What follows from other settings: a shown reading needs explaining, and usage needs popularity."""
    out = dict(values)
    if out.get("ui.show_reading") and out.get("explain", "off") == "off":
        out["explain"] = "reading"
    if out.get("popularity.enabled") is False:
        out["usage"] = "off"
    return out


def from_env(env: dict[str, str], prefix: str = "MOODRANK_") -> dict:
    """MOODRANK_SEARCH__LIMIT=5 -> search.limit 5; values are read as TOML, else as text."""
    out = {}
    for name, raw in env.items():
        if name.startswith(prefix):
            key = name.removeprefix(prefix).lower().replace("__", ".")
            try:
                out[key] = tomllib.loads(f"v = {raw}")["v"]
            except tomllib.TOMLDecodeError:
                out[key] = raw
    return out


@dataclass(frozen=True)
class Setting:
    name: str
    default: object
    spellings: tuple[str, ...] = ()


class Registry:
    """All settings with their other spellings."""

    def __init__(self, settings: list[Setting]):
        self.settings = {s.name: s for s in settings}
        self.names = {n: s.name for s in settings for n in (s.name, *s.spellings)}

    def canonical(self, values: dict) -> tuple[dict, list[str]]:
        """Values under their settings' own names, and a warning for each unknown name."""
        return {self.names[k]: v for k, v in values.items() if k in self.names}, [f"unknown setting {k}" for k in values if k not in self.names]

    def defaults(self) -> dict:
        return {n: s.default for n, s in self.settings.items()}


@dataclass
class Consent:
    """Whether usage may be shared: the person's answer, else the default, else not yet asked; since when."""

    answer: bool | None = None
    default: bool | None = None
    since_ms: int | None = None

    @property
    def state(self) -> str:
        return "answered" if self.answer is not None else "default" if self.default is not None else "unasked"

    @property
    def allowed(self) -> bool:
        return bool(self.answer if self.answer is not None else self.default)

    def set(self, answer: bool, now_ms: int) -> Consent:
        """A yes counts from now on, unless it was one already."""
        return Consent(answer, self.default, self.since_ms if answer and self.allowed and self.since_ms is not None else now_ms if answer else None)


class Live:
    """What searches read while it may be replaced: a whole snapshot at a time."""

    def __init__(self, **parts):
        self._lock, self._now = threading.Lock(), dict(parts)

    def snapshot(self) -> dict:
        with self._lock:
            return self._now

    def swap(self, **parts) -> dict:
        """Replaces some parts in one step; who took the snapshot before goes on with it."""
        with self._lock:
            self._now = self._now | parts
            return self._now


def merged(base: dict, over: dict) -> dict:
    """Dictionaries inside each other, the later value wins; null takes a key away."""
    out = dict(base)
    for k, v in over.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def clamped_rows(rows: DataFrame, ceilings: dict[str, float], locks: dict[str, tuple[str, str]]) -> DataFrame:
    """The same for a table of options; locks: column -> (boolean column that locks it, value)."""
    changed: Column = F.lit(False)
    new: dict[str, Column] = {}
    for name, most in ceilings.items():
        new[name] = F.least(F.col(name), F.lit(most))
        changed = changed | (F.col(name) > most)
    for name, (where, value) in locks.items():
        new[name] = F.when(F.col(where), F.lit(value)).otherwise(F.col(name))
        changed = changed | (F.col(where) & (F.col(name) != value))
    return rows.withColumns(new | {"clamped": changed})


def describe(spark) -> DataFrame:
    rows = [(f.name, str(f.default), str(BOUNDS.get(f.name) or CHOICES.get(f.name) or "")) for f in fields(Options)]
    return spark.createDataFrame(rows, "name string, default string, allowed string")
