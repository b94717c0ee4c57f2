"""Chat formatting: a state machine over roles, a template, and a loss mask.

Only DataFrame functions run. A conversation's turns are sorted into one array, a
fold over their roles through the template's transition table tells whether their
order is allowed, and each turn becomes three segments: header, text and end mark.
Only the text of a role in ``loss`` is under the mask. Segments are written one
after the other.

Inside a text or role a backslash and the first character of each mark are written as
two-character codes that start with a backslash and hold none of those characters, so the
marks can only stand where the template put them, and reading back is exact. A role that is spelled
like one of the template's names without being it (`Assistant`) is written with a code before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "### "
    middle: str = ": "
    close: str = " </turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    foreign: str = "\\r"
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "asked"),
        ("start", "user", "user"),
        ("asked", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    """(state, role, next state); any other step leads to `bad`, for good."""
    ends: tuple[str, ...] = ("assistant", "user")


TEMPLATE = Template()


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column, t: Template = TEMPLATE, role: bool = False) -> Column:
    return _swap(c, [*t.escapes, *(t.role_escapes if role else ())])


def unescape(c: Column, t: Template = TEMPLATE) -> Column:
    """Codes go back in reverse order, the backslash last: no code's text can
    come of another's before that."""
    back = [(code, raw) for raw, code in [*t.escapes, *t.role_escapes]]
    return _swap(c, [(t.foreign, ""), *back[1:], back[0]])


def format_chats(turns: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, formatted, segments, valid.

    Turns go by turn (null first), ties by role and text; repeated rows are turns of
    their own. Null text or role is empty; a null conv_id is a conversation. Every
    conversation is formatted, `valid` tells whether the roles' order is allowed. A role
    without a name in the template keeps its own, escaped. Turns of one conversation meet
    in one row, as its text does."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    move = F.create_map(*[F.lit(x) for s, r, n in t.moves for x in (f"{s}>{r}", n)])
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(move, F.concat(s, F.lit(">"), x["role"])), F.lit("bad")))
    names = F.create_map(*[F.lit(x) for pair in t.names.items() for x in pair])
    segment = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))

    def segments(x: Column) -> Column:
        foreign = F.when(x["role"].isin(*t.names.values()), F.lit(t.foreign)).otherwise(F.lit(""))
        name = F.coalesce(F.try_element_at(names, x["role"]), F.concat(foreign, escape(x["role"], t, role=True)))
        return F.array(
            segment(F.concat(F.lit(t.open), name, F.lit(t.middle)), F.lit(False)),
            segment(escape(x["text"], t), x["role"].isin(*t.loss)),
            segment(F.lit(t.close), F.lit(False)),
        )

    out = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.isin(*t.ends).alias("valid"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_back(chats: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """What format_chats wrote, from `formatted` alone -> conv_id, turns (role, text), loss_text, formatted, valid."""
    parts = F.filter(F.split("formatted", t.close.replace("\\", "\\\\")), lambda s: s != "")
    roles = F.create_map(*[F.lit(x) for role, name in t.names.items() for x in (name, role)])

    def turn(s: Column) -> Column:
        at = F.instr(s, t.middle)
        name = F.substring(s, F.lit(len(t.open) + 1), at - len(t.open) - 1)
        return F.struct(
            F.coalesce(F.try_element_at(roles, name), unescape(name, t)).alias("role"),
            unescape(F.substring(s, at + len(t.middle), F.length(s)), t).alias("text"),
        )

    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"].isin(*t.loss)), lambda x: x["text"]), "")
    return chats.select("conv_id", F.transform(parts, turn).alias("turns"), "formatted", "valid").select("conv_id", "turns", loss.alias("loss_text"), "formatted", "valid")


def digest(chats: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """The contract's columns, all read back from the formatted output."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_back(chats, t).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


EXTRA_TEXT = "\\### Assistant: </turn> ok"


def with_extra(turns: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose texts hold the template's own marks."""
    two = turns.sparkSession.range(2)
    extra = two.select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(4 + length(role) + 2 + length(text) + 9
      + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 WHEN role IN ('System', 'User', 'Assistant') THEN 2
          ELSE length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) END
      + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
  regexp_full_match(roles, 's?u(au)*a?') AS valid
FROM a
"""
