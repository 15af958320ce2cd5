"""Chat formatting with DataFrame functions only.

A declarative template says how a turn is framed and which roles bear loss; a finite-state machine
over roles validates the order of turns. The output of a conversation is a list of text segments
with a loss flag each, their concatenation, and what the machine found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``escape`` starts an escape: it is doubled in texts, and put inside any ``<|`` so that no
    text can hold a control string. Roles are escaped likewise, their line ends as escape + n."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state to the roles that may follow it; the state after a turn is that turn's role
    order: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escaped(text: Column, t: Template = CHATML) -> Column:
    e = t.escape
    return F.replace(F.replace(text, F.lit(e), F.lit(e + e)), F.lit("<|"), F.lit("<" + e + "|"))


def unescaped(text: Column, t: Template = CHATML) -> Column:
    """Undoes ``escaped``: an escape between < and | was put in, all others are doubled."""
    e = t.escape
    return F.replace(F.replace(text, F.lit("<" + e + "|"), F.lit("<|")), F.lit(e + e), F.lit(e))


def escaped_role(role: Column, t: Template = CHATML) -> Column:
    return F.replace(escaped(role, t), F.lit("\n"), F.lit(t.escape + "n"))


def unescaped_role(role: Column, t: Template = CHATML) -> Column:
    """As ``unescaped``; doubled escapes are set aside first so that their halves don't count."""
    e = t.escape
    parts = F.transform(F.split(F.replace(role, F.lit("<" + e + "|"), F.lit("<|")), F.lit("\\Q" + e + e + "\\E"), -1), lambda p: F.replace(p, F.lit(e + "n"), F.lit("\n")))
    return F.array_join(parts, e)


def check_order(roles: Column, t: Template = CHATML) -> Column:
    """Struct (valid, bad_at): bad_at is the first turn, from 0, that the machine refuses, or the
    number of turns if it stops in a state that is not final."""
    step = lambda s, r: F.coalesce(F.array_contains(F.coalesce(moves[s], F.array()), r), F.lit(False))
    moves = F.create_map(*(x for k, v in t.order.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(-1).alias("bad"))
    end = F.aggregate(
        roles,
        start,
        lambda a, r: F.struct(F.coalesce(r, F.lit("")).alias("state"), (a["n"] + 1).alias("n"), F.when((a["bad"] < 0) & ~step(a["state"], r), a["n"]).otherwise(a["bad"]).alias("bad")),
        lambda a: F.when(a["bad"] >= 0, a["bad"]).when(~a["state"].isin(*t.final), a["n"]),
    )
    return F.struct(end.isNull().alias("valid"), end.alias("bad_at"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHATML) -> DataFrame:
    """``(conv_id, n_turns, valid, bad_at, segments, formatted)``, one row per conversation.

    Rows go by turn; ties by role, then text; null turns first. A null text is empty, a null role
    is the empty role, which the machine refuses. Conversations that it refuses are formatted
    all the same. Repeated rows are turns of their own. Rows with a null conv_id make one
    conversation. Other columns are not looked at; an empty table gives no rows.

    Rows meet as they are, so a text is moved once; a task sorts the turns of its conversations and
    escapes and frames them. A conversation's output is one string, so it has to fit a task."""
    t = template
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    framed = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("x"),
    )
    grouped = framed.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    segment = lambda kind, s, loss: F.struct(F.lit(kind).alias("kind"), s.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "xs",
            lambda x: F.array(
                segment("head", F.concat(F.lit(t.start), escaped_role(x["role"], t), F.lit(t.after_role)), no),
                segment("text", escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
                segment("tail", F.lit(t.end + t.after_turn), no),
            ),
        )
    )
    order = check_order(F.transform("xs", lambda x: x["role"]), t)
    out = grouped.select("conv_id", F.size("xs").cast("long").alias("n_turns"), order.alias("o"), segments.alias("segments"))
    return out.select("conv_id", "n_turns", "o.valid", "o.bad_at", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """``chats`` with ``turns``, an array of (role, text) parsed from ``formatted``, and
    ``loss_text``, the unescaped text under the loss mask, from the segments."""
    t = template
    parts = F.split("formatted", F.lit("\\Q" + t.end + t.after_turn + "\\E"), -1)
    bodies = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def parse(p: Column) -> Column:
        cut = F.locate(t.after_role, p)
        role = F.substr(p, F.lit(len(t.start) + 1), cut - len(t.start) - 1)
        body = F.substr(p, cut + len(t.after_role))
        return F.struct(unescaped_role(role, t).alias("role"), unescaped(body, t).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    return chats.withColumn("turns", F.transform(bodies, parse)).withColumn("loss_text", loss)
