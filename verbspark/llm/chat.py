"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything here is DataFrame functions.  The template says how each role's
turn is written and which parts of it carry loss, and from which states a role
may come.  Control strings inside a text or role are escaped so that they can
be told from the template's own and read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Declares the format of a conversation.

    A turn is written open + role + after_role + text + close.  loss_roles are
    those whose text carries loss.  transitions names, for each role, the roles
    (or "start") that may stand before it; a conversation is complete if its
    last role is in final.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    control: str = "<|"
    escaped: str = "<\\|"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": (START,), "user": (START, "system", "assistant"), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    """Doubles backslashes, then breaks every control string with a single one."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(template.control), F.lit(template.escaped))


def unescape(text: Column, template: Template = CHATML) -> Column:
    return F.replace(F.replace(text, F.lit(template.escaped), F.lit(template.control)), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column, template: Template) -> Column:
    """As escape(), and line breaks, which end a role, become a backslash and n."""
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column, template: Template) -> Column:
    """Pairs of backslashes are set aside first, so that what is left of them is unambiguous."""
    inner = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit(template.escaped), F.lit(template.control))
    return F.array_join(F.transform(F.split(role, r"\\\\"), inner), "\\")


def format_conversations(turns: DataFrame, template: Template = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats each conversation, its rows ordered by turn.

    Returns id_col; n_turns; formatted, the whole text; segments, an array of
    (text, loss) whose texts make up formatted; error, the number of the first
    turn (from 0) whose role may not stand there, n_turns if the last turn may
    not be the last, null if the order is valid.  Invalid conversations are
    formatted too.

    A null text or role is empty.  Rows with equal or null turns are ordered by
    role and text, nulls first, and repeated rows are repeated turns.  Rows
    with a null id are one conversation.  No rows give no rows.  Other columns
    are not read.
    """
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("row"),
    )
    held = rows.groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    roles = F.transform("rows", lambda r: r["role"])
    allowed = F.create_map(*(x for role, before in template.transitions.items() for x in (F.lit(role), F.array(*map(F.lit, before)))))
    state = F.struct(F.lit(START).alias("before"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("error"))

    def step(s: Column, role: Column) -> Column:
        good = F.coalesce(F.array_contains(F.try_element_at(allowed, role), s["before"]), F.lit(False))
        return F.struct(role.alias("before"), (s["place"] + 1).alias("place"), F.coalesce(s["error"], F.when(~good, s["place"])).alias("error"))

    def end(s: Column) -> Column:
        return F.coalesce(s["error"], F.when(~s["before"].isin(*template.final), s["place"]))

    def parts(r: Column) -> Column:
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.open), _escape_role(r["role"], template), F.lit(template.after_role))
        return F.array(segment(head, F.lit(False)), segment(escape(r["text"], template), r["role"].isin(*template.loss_roles)), segment(F.lit(template.close), F.lit(False)))

    out = held.select("id", F.size("rows").cast("long").alias("n_turns"), F.flatten(F.transform("rows", parts)).alias("segments"), F.aggregate(roles, state, step, end).alias("error"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select(F.col("id").alias(id_col), "n_turns", formatted.alias("formatted"), "segments", "error")


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    pieces = F.split(formatted, _literal(template.open))
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.after_role, 1)
        begin = F.length(role) + len(template.after_role) + 1
        text = F.substring(piece, begin, F.length(piece) - begin + 1 - len(template.close))
        return F.struct(_unescape_role(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, as it was before escaping."""
    marked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(marked, lambda s: unescape(s["text"], template)), "")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
