"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template.

Everything is a column expression. A conversation's turns are escaped row by row, gathered once, in order, and become
segments; the machine is folded over its roles. The formatted text is the segments' texts joined, and can be read back.

Escaping: in a mark, a backslash is put after the first character wherever the mark, or the mark with backslashes at that place,
stands in a text; taking one away gives the text back. Marks hold no backslash and do not overlap themselves, so
no escaped text holds a mark, and the first mark after a text is the one that ends it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``open role between text close end``: the head up to the text, the text, and the tail. ``loss`` names
    for each of them the roles for which the model learns to write it."""

    open: str = "<turn:"
    between: str = ">\n"
    close: str = "</turn>"
    end: str = "\n"
    loss: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"text": ("assistant",)})

    def __post_init__(self):
        for mark in (self.open, self.between, self.close):
            if len(mark) < 2 or "\\" in mark or any(mark[:k] == mark[-k:] for k in range(1, len(mark))):
                raise ValueError(f"{mark!r} must have two characters or more, no backslash, and not end as it begins")

    @property
    def marks(self) -> tuple[str, ...]:
        return self.open, self.close

    @property
    def role_marks(self) -> tuple[str, ...]:
        return self.open, self.close, self.between


@dataclass(frozen=True)
class Machine:
    """From state ``start``, each role moves on by ``moves`` (state, role, next state); a role without a move breaks the
    order. A conversation is valid if none does and it ends in one of ``final``."""

    start: str = "start"
    moves: Sequence[tuple[str, str, str]] = (("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"), ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    final: Sequence[str] = ("answered",)

    def __post_init__(self):
        if "" in {self.start, *(x for state, _, then in self.moves for x in (state, then))}:
            raise ValueError("a state must have a name")


def _literal(mark: str) -> str:
    return "".join(c if c.isalnum() or c == "\n" else f"\\{c}" for c in mark)


def escaped(text: Column, marks: Sequence[str]) -> Column:
    for mark in marks:
        text = F.regexp_replace(text, rf"{_literal(mark[0])}(\\*){_literal(mark[1:])}", mark[0].replace("$", r"\$") + r"\\$1" + mark[1:].replace("$", r"\$"))
    return text


def unescaped(text: Column, marks: Sequence[str]) -> Column:
    for mark in reversed(marks):
        text = F.regexp_replace(text, rf"{_literal(mark[0])}\\(\\*){_literal(mark[1:])}", mark[0].replace("$", r"\$") + "$1" + mark[1:].replace("$", r"\$"))
    return text


def order_of(roles: Column, machine: Machine) -> Column:
    """state: where the machine ends, empty where a role broke the order; broken_at: the place, from 0, of the first role
    that did, -1 if none."""
    moves = F.create_map(*[F.lit(x) for state, role, then in machine.moves for x in (f"{state}\n{role}", then)])
    zero = F.struct(F.lit(machine.start).alias("state"), F.lit(-1).alias("broken_at"), F.lit(0).alias("n"))

    def move(s: Column, role: Column) -> Column:
        then = F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), role)), F.lit(""))
        broken = F.when((s["broken_at"] < 0) & (then == ""), s["n"]).otherwise(s["broken_at"])
        return F.struct(then.alias("state"), broken.alias("broken_at"), (s["n"] + 1).alias("n"))

    return F.aggregate(roles, zero, move)


def format_chats(rows: DataFrame, template: Template | None = None, machine: Machine | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its id, ``segments`` (text, loss: the formatted text in order, none empty), ``state``, ``broken_at``, ``valid``.

    Rows come by turn, null turns first; rows of one turn by role, then by text as it is escaped; repeated rows stay. A null
    text or role is an empty one; rows of a null id are one conversation. Order that breaks the machine's rules is
    formatted all the same and flagged. Other columns are ignored, whatever their names. An empty table gives no rows. A
    conversation becomes one row, so it has to fit in one (2 GB).
    """
    template, machine = template or Template(), machine or Machine()
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), escaped(text, template.marks).alias("text"))
    gathered = rows.select(F.col(conv_col).alias(conv_col), turn.alias("_turn")).groupBy(conv_col).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escaped(t["role"], template.role_marks), F.lit(template.between))
        made = (("head", head), ("text", t["text"]), ("tail", F.lit(template.close + template.end)))
        return F.array(*[F.struct(part.alias("text"), t["role"].isin(*template.loss.get(name, ())).alias("loss") if template.loss.get(name) else F.lit(False).alias("loss")) for name, part in made])

    ended = order_of(F.col("_turns.role"), machine)
    made = gathered.select(conv_col, F.filter(F.flatten(F.transform("_turns", segments)), lambda s: s["text"] != "").alias("segments"), ended.alias("_end"))
    state, broken = F.nullif(F.col("_end.state"), F.lit("")), F.when(F.col("_end.broken_at") >= 0, F.col("_end.broken_at"))
    return made.select(conv_col, "segments", state.alias("state"), broken.alias("broken_at"), F.col("_end.state").isin(*machine.final).alias("valid"))


def formatted(segments: Column) -> Column:
    """The formatted text of segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def turns_of(text: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted text."""
    template = template or Template()
    pieces = F.split(text, _literal(template.close + template.end))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, F.lit(template.between))
        role = F.substr(piece, F.lit(len(template.open) + 1), at - len(template.open) - 1)
        return F.struct(unescaped(role, template.role_marks).alias("role"), unescaped(F.substr(piece, at + len(template.between)), template.marks).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def learned(segments: Column, template: Template | None = None) -> Column:
    """The text under the loss, unescaped."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template.marks)), "")


def chat_digests(rows: DataFrame, template: Template | None = None, machine: Machine | None = None) -> DataFrame:
    """One row a conversation, read back from what ``format_chats`` gives: conv_id, n_turns, turns_sha256 (of role, new
    line, text, new line a turn), loss_chars, loss_sha256, formatted_chars, valid, broken_at."""
    made = format_chats(rows, template, machine).withColumn("_text", formatted(F.col("segments")))
    read = made.withColumns({"_turns": turns_of(F.col("_text"), template), "_loss": learned(F.col("segments"), template)})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("_text").cast("long").alias("formatted_chars"),
        "valid",
        "broken_at",
    )
