"""Chat formatting: turns of a conversation become one training text with loss flags.

A declarative template names the roles, the marks around a turn, the roles under the loss, and
the states of a finite-state machine over roles. Control characters inside texts and role
names are written as escapes, so a mark never occurs in a text and the output can be read back.

Null texts and roles are empty, a null turn number sorts first, rows with equal turns are
ordered by role and text, rows with a null conv_id form one conversation, an empty table gives
no rows, other columns are not read. A conversation is one output row by definition, so its
turns meet in one task."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """`steps` maps a state to {role: next state}; a conversation is valid if every turn has a
    step and the last state is in `final`."""

    open: str = "<s>["
    close_role: str = "] "
    close: str = "</s>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    steps: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)
    # Characters that begin a mark, and the escape character itself, which must come first.
    escapes: tuple[tuple[str, str], ...] = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("]", "%5D"))


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    for plain, code in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    for plain, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _turns(rows: DataFrame) -> DataFrame:
    empty = F.lit("")
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), empty).alias("role"),
        F.coalesce(F.col("text"), empty).alias("text"),
    )
    return rows.select(F.col("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns")
    )


def _last_state(roles: Column, template: Template) -> Column:
    """The machine as a fold; a turn without a step leads to the state '' and stays there."""

    def step(state: Column, role: Column) -> Column:
        found = F.lit("")
        for name, row in template.steps.items():
            for to_role, to in row.items():
                found = F.when((state == name) & (role == to_role), F.lit(to)).otherwise(found)
        return found

    return F.aggregate(roles, F.lit(template.start), step)


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid from (conv_id, turn, role,
    text). The segments joined are the formatted text; each is wholly in or out of the loss."""

    def segments(turn: Column) -> Column:
        head = F.concat(F.lit(template.open), escape(turn["role"], template), F.lit(template.close_role))
        body = F.struct(
            escape(turn["text"], template).alias("text"),
            turn["role"].isin(*template.loss_roles).alias("loss"),
        )
        mark = F.lit(False).alias("loss")
        return F.array(
            F.struct(head.alias("text"), mark), body, F.struct(F.lit(template.close).alias("text"), mark)
        )

    turns = _turns(rows)
    cut = turns.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        _last_state(F.transform("turns", lambda t: t["role"]), template).isin(*template.final).alias("valid"),
    )
    return cut.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "valid",
    )


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> back out of a formatted text: marks cannot occur in texts."""
    pieces = F.split(formatted, "\\Q" + template.close + "\\E")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.close_role, 1)
        text = F.substr(piece, F.char_length(role) + len(template.close_role) + 1)
        return F.struct(
            unescape(F.substr(role, F.lit(len(template.open) + 1)), template).alias("role"),
            unescape(text, template).alias("text"),
        )

    return F.transform(whole, turn)


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Counts and hashes of what can be read back from `format_chats`."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted"), template))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(masked, lambda s: unescape(s["text"], template)), "")
    return read.withColumn("_loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
