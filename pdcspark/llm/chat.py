"""Chat formatting: a finite-state machine over roles, and a declarative template.

The state of a conversation is the role of its last turn (``start`` before the
first), so the machine steps with a window over each conversation's turns and
``TRANSITIONS`` is its table.  The template wraps every turn in marks and says
which roles are trained on.  Marks inside texts are escaped reversibly: a
backslash is doubled, and one is put behind the first character of every
control string, so no control string is left in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSITIONS = {
    "start": ("system", "user"),
    "system": ("user",),
    "user": ("assistant",),
    "assistant": ("user", "tool"),
    "tool": ("assistant",),
}
ACCEPTED = ("assistant",)

#: Marks of a turn by role, and whether its text counts in the loss.  A role that
#: isn't listed is written out between the marks of ``other``.
TEMPLATE = {
    "roles": {
        "system": {"open": "<<SYS>>", "close": "<</SYS>>", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "<s>", "close": "</s>", "loss": True},
    },
    "other": {"open": "<<ROLE>>", "then": "<<TEXT>>", "close": "<</ROLE>>", "loss": False},
}

SEGMENT = "array<struct<text:string,loss:boolean>>"


def control_strings(template: dict = TEMPLATE) -> list[str]:
    marks = [r[k] for r in template["roles"].values() for k in ("open", "close")]
    return marks + [template["other"][k] for k in ("open", "then", "close")]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in control_strings(template):
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns(rows: DataFrame, template: dict = TEMPLATE, transitions: dict = TRANSITIONS) -> DataFrame:
    """One row per turn: (conv_id, turn, role, position, in_order, segments).

    ``segments`` are the opening mark, the escaped text and the closing mark,
    each with its loss flag.  ``in_order`` says whether the machine has a step
    from the previous turn's role to this one.  Null roles and texts count as
    empty, null turns come first and null conv_ids are one conversation; equal
    turns are ordered by role and text.  Other columns are not read.
    """
    turn = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    in_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.lag("role", 1, "start").over(in_turn)
    steps = F.lit(False)
    for before, after in transitions.items():
        steps = steps | ((state == before) & F.col("role").isin(*after))
    role, other = F.col("role"), template["other"]
    opening, closing, loss = F, F, F
    for name, marks in template["roles"].items():
        opening = opening.when(role == name, F.lit(marks["open"]))
        closing = closing.when(role == name, F.lit(marks["close"]))
        loss = loss.when(role == name, F.lit(marks["loss"]))
    opening = opening.otherwise(F.concat(F.lit(other["open"]), escape(role, template), F.lit(other["then"])))
    segments = F.array(
        F.struct(opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text"), template).alias("text"), loss.otherwise(F.lit(other["loss"])).alias("loss")),
        F.struct(closing.otherwise(F.lit(other["close"])).alias("text"), F.lit(False).alias("loss")),
    )
    return turn.select("conv_id", "turn", "role", F.row_number().over(in_turn).alias("position"), steps.alias("in_order"), segments.cast(SEGMENT).alias("segments"))


def conversations(rows: DataFrame, template: dict = TEMPLATE, transitions: dict = TRANSITIONS, accepted: tuple = ACCEPTED) -> DataFrame:
    """One row per conversation: (conv_id, n_turns, valid, first_error, segments).

    ``valid``: every step is in order and the last role is accepted;
    ``first_error`` is the position of the first turn out of order, or null.
    Conversations that are not valid are formatted like the others, for the
    caller to drop.  ``segments`` joined together are the formatted text.  An
    empty table gives no rows.
    """
    each = turns(rows, template, transitions)
    whole = each.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.min(F.when(~F.col("in_order"), F.col("position"))).alias("first_error"),
        F.max_by("role", "position").alias("last"),
        F.sort_array(F.collect_list(F.struct("position", "segments"))).alias("turns"),
    )
    valid = F.col("first_error").isNull() & F.col("last").isin(*accepted)
    return whole.select("conv_id", "n_turns", valid.alias("valid"), "first_error", F.flatten("turns.segments").alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: dict = TEMPLATE) -> Column:
    """A formatted text -> array of (role, text), unescaped."""
    def quoted(marks):
        return "|".join("".join("\\" + c if c in "[]" else c for c in m) for m in marks)

    roles, other = template["roles"], template["other"]
    pieces = F.split(text, quoted([r["close"] for r in roles.values()] + [other["close"]]), -1)

    def turn(piece: Column) -> Column:
        role, said = F, F
        for name, marks in roles.items():
            opens = F.startswith(piece, F.lit(marks["open"]))
            role, said = role.when(opens, F.lit(name)), said.when(opens, F.substr(piece, F.lit(len(marks["open"]) + 1)))
        role = role.otherwise(F.substr(F.substring_index(piece, other["then"], 1), F.lit(len(other["open"]) + 1)))
        said = said.otherwise(F.substring_index(piece, other["then"], -1))
        return F.struct(unescape(role).alias("role"), unescape(said).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def digests(formatted_conversations: DataFrame) -> DataFrame:
    """What the formatted output says when read again: the digest columns of the query."""
    read = formatted_conversations.select("conv_id", "valid", "first_error", formatted(F.col("segments")).alias("formatted"), "segments")
    read = read.select("*", read_back(F.col("formatted")).alias("said"))
    in_loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = read.select("*", F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("spoken"), in_loss.alias("in_loss"))
    return read.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2("spoken", 256).alias("turns_sha256"),
        F.length("in_loss").cast("long").alias("loss_chars"),
        F.sha2("in_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_error").cast("long").alias("first_error"),
    )
