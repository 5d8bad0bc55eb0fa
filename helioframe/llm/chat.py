"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL functions only.

A template says how a turn opens and closes, which roles carry loss, and which role may follow which.  Texts and roles
are escaped so that no control string survives inside them: the escape character and every control string become the escape
character and one letter, which ``unescape`` reverses exactly.

Turns are ordered and measured by one window per conversation and put together by one aggregation on the same
partitioning.  ``spans`` are byte ranges of the formatted text under the loss mask.

Defined cases: null text or role counts as empty; turns are ordered by turn (null first), then role, then text; repeated
turns stay; rows without a conversation id are conversations of one turn each; a conversation that breaks the turn order
is formatted all the same, with ``valid`` false and the first offending turn in ``breaks_at``; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    #: What may not occur inside texts, and the letter that stands for it behind the escape character.
    control: tuple[tuple[str, str], ...] = (("###", "h"), ("</turn>", "t"))
    loss: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column, t: Template = TEMPLATE, more: tuple = ()) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "e"))
    for what, letter in (*t.control, *more):
        out = F.replace(out, F.lit(what), F.lit(t.escape + letter))
    return out


def unescape(text: Column, t: Template = TEMPLATE, more: tuple = ()) -> Column:
    for what, letter in (*t.control, *more):
        text = F.replace(text, F.lit(t.escape + letter), F.lit(what))
    return F.replace(text, F.lit(t.escape + "e"), F.lit(t.escape))


#: Roles also lose the colon that ends them.
ROLE = ((":", "c"),)


def walk(roles: Column, t: Template = TEMPLATE) -> Column:
    """(state, at, breaks_at): the machine's last state, the turns read, the first turn that it does not allow."""
    moves = [F.lit(x) for state, to in t.moves.items() for role, after in to.items() for x in (f"{state}>{role}", after)]
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("breaks_at"))

    def move(s: Column, r: Column) -> Column:
        step = F.try_element_at(F.create_map(*moves), F.concat(s["state"], F.lit(">"), r))
        return F.struct(F.coalesce(step, r).alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["breaks_at"], F.when(step.isNull(), s["at"])).alias("breaks_at"))

    return F.aggregate(roles, start, move)


def formatted(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", t: Template = TEMPLATE) -> DataFrame:
    """(conv_id, segments, formatted, spans, valid, breaks_at), one row per conversation.

    ``segments`` are (text, loss) in order and join to ``formatted``; ``spans`` are (start, length) in bytes."""
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    head = F.concat(F.lit(t.open), escape(F.col("role"), t, ROLE), F.lit(t.after_role))
    rows = rows.select("conv_id", lone.alias("lone"), "turn", "role", "text", head.alias("head"), escape(F.col("text"), t).alias("body"))
    turns = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")
    size = F.octet_length("head") + F.octet_length("body") + len(t.close.encode())
    before = F.coalesce(F.sum(size).over(turns.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(
        "conv_id", "lone", F.row_number().over(turns).alias("pos"), "role", "head", "body", F.col("role").isin(*t.loss).alias("loss"),
        (before + F.octet_length("head")).cast("long").alias("start"), F.octet_length("body").cast("long").alias("length"))
    turn_list = F.array_sort(F.collect_list(F.struct("pos", "role", "head", "body", "loss", "start", "length")))
    grouped = placed.groupBy("conv_id", "lone").agg(turn_list.alias("turns"))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["loss"]), segment(F.lit(t.close), F.lit(False)))))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    made = grouped.select("conv_id", segments.alias("segments"), spans.alias("spans"), walk(F.transform("turns", lambda x: x["role"]), t).alias("end"))
    valid = F.col("end.breaks_at").isNull() & F.col("end.state").isin(*t.final)
    text_out = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.select("conv_id", "segments", text_out.alias("formatted"), "spans", valid.alias("valid"), F.col("end.breaks_at").alias("breaks_at"))


def read_back(out: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, turns, loss_text, valid, breaks_at, loss_flags): (role, text) of every turn and the text under the loss
    mask, from ``formatted`` and ``spans`` alone; the machine's verdict, and the loss flag of every segment as 0 or 1 in order."""
    parts = F.slice(F.split("formatted", F.lit("\\Q" + t.close + "\\E"), -1), 1, F.size(F.split("formatted", F.lit("\\Q" + t.close + "\\E"), -1)) - 1)
    def parsed(part: Column) -> Column:
        at = F.position(F.lit(t.after_role), part)
        role = F.substring(part, F.lit(len(t.open) + 1), at - len(t.open) - 1)
        body = F.substring(part, at + len(t.after_role), F.length(part))
        return F.struct(unescape(role, t, ROLE).alias("role"), unescape(body, t).alias("text"))

    raw = F.col("formatted").cast("binary")
    under = F.transform("spans", lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"), t))
    flags = F.array_join(F.transform("segments", lambda s: s["loss"].cast("int").cast("string")), "")
    return out.select("conv_id", "formatted", F.transform(parts, parsed).alias("turns"), F.array_join(under, "").alias("loss_text"), "valid", "breaks_at", flags.alias("loss_flags"))
