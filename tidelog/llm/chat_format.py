"""Operator 12. Chat formatting, in DataFrame expressions alone.

A ``ChatTemplate`` declares the marks around a turn, the roles with their labels and loss flags, and a finite-state machine:
which role may follow in which state, and in which states a conversation may end. ``format_conversations`` runs the machine
over each conversation's roles and emits the segments of its text - opening mark, text, closing mark - each with a loss flag.
``read_turns`` reads the turns back from the formatted text, ``read_loss`` the text under the loss mask from the segments.

Escapes. In texts and odd roles, the escape character and each control string become the escape character and a code letter.
An escape character in formatted text so always begins a code: a control string is there only as a mark, and unescaping is a
replacement of each code, the escape character's own last. A control string may not end as it begins, so that no text makes up
one together with the mark behind it.

Rows go through one exchange, by conversation: a conversation's formatted text is one value, and so are what read it back.

Defined cases. Turns go by turn, then role, then text, nulls first; rows that repeat are turns of their own. A null text is
empty. A role that the template doesn't name, or null, keeps its name, in a label of its own, has no loss, and the machine
rejects it. What the machine rejects is formatted too, with ``valid`` false and ``bad_turn`` the place (from 0) of the first turn
it doesn't take, or the number of turns where the conversation may not end there; ``invalid="drop"`` leaves such conversations
out. Rows of a null conversation id are one conversation. An empty table gives an empty table. A text is taken whole. Other
columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """How a role's turns are marked, and whether their texts count for the loss."""

    label: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``head``, the role's label, ``tail``, the text, ``close``."""

    roles: Mapping[str, Role] = field(default_factory=lambda: {"system": Role("System"), "user": Role("User"), "assistant": Role("Assistant", loss=True)})
    head: str = "### "
    tail: str = ": "
    close: str = "</turn>\n"
    control: tuple[str, ...] = ("### ", ": ", "</turn>")
    escape: str = "\\"
    start: str = "start"
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    ends: tuple[str, ...] = ("asked", "answered")

    #: Begins the label of a role that isn't named; no named one may begin so.
    other = "?"

    def __post_init__(self) -> None:
        if len(self.escape) != 1 or not self.control or len(self.control) > 20:
            raise ValueError("an escape is one character, and there are one to twenty control strings")
        for c in self.control:
            if not c or c[0].isalpha() or self.escape in c or any(c[:k] == c[-k:] for k in range(1, len(c))):
                raise ValueError(f"control string {c!r} is empty, begins with a letter, has the escape, or ends as it begins")
            if any(c in d or any(d[:k] == c[-k:] for k in range(1, min(len(c), len(d)))) for d in self.control if d != c):
                raise ValueError(f"control string {c!r} is in another one, or runs into its beginning")
        if self.head not in self.control or self.tail not in self.control or not any(self.close.startswith(c) for c in self.control):
            raise ValueError("head, tail and the beginning of close are control strings")
        labels = [r.label for r in self.roles.values()]
        if len(set(labels)) < len(labels) or any(x.startswith(self.other) or self.escape in x or any(c in x for c in self.control) for x in labels):
            raise ValueError("labels are distinct, without control strings or escape, and don't begin as those of other roles")

    @property
    def codes(self) -> list[tuple[str, str]]:
        """(control string, its code), the escape character first."""
        return [(self.escape, f"{self.escape}e"), *((c, f"{self.escape}{chr(ord('A') + k)}") for k, c in enumerate(self.control))]

    @property
    def no_role(self) -> str:
        """The code of a null role."""
        return f"{self.escape}n"

    def escaped(self, text: Column) -> Column:
        for plain, code in self.codes:
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    def unescaped(self, text: Column) -> Column:
        for plain, code in reversed(self.codes):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text

    def label_of(self, role: Column) -> Column:
        out = F.when(role.isNull(), F.lit(self.other + self.no_role))
        for name, r in self.roles.items():
            out = out.when(role == name, F.lit(r.label))
        return out.otherwise(F.concat(F.lit(self.other), self.escaped(role)))

    def role_of(self, label: Column) -> Column:
        out = F.when(label == self.other + self.no_role, F.lit(None).cast("string"))
        for name, r in self.roles.items():
            out = out.when(label == r.label, F.lit(name))
        return out.otherwise(self.unescaped(F.substring(label, len(self.other) + 1, 2**31 - 1)))

    def has_loss(self, role: Column) -> Column:
        return F.coalesce(role.isin(*[n for n, r in self.roles.items() if r.loss]), F.lit(False))

    def walked(self, roles: Column) -> Column:
        """The machine's last state, and the place of the first role that it doesn't take (null: none)."""
        start = F.struct(F.lit(self.start).alias("state"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("bad"))

        def step(at: Column, role: Column) -> Column:
            to = None
            for state, taken in self.moves.items():
                for name, following in taken.items():
                    here = (at["state"] == state) & (role == name)
                    to = F.when(here, F.lit(following)) if to is None else to.when(here, F.lit(following))
            to = F.lit(None).cast("string") if to is None else to
            stuck = at["bad"].isNotNull() | to.isNull()
            return F.struct(F.when(stuck, at["state"]).otherwise(to).alias("state"), (at["place"] + 1).alias("place"), F.coalesce(at["bad"], F.when(to.isNull(), at["place"])).alias("bad"))

        return F.aggregate(roles, start, step)


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), invalid: str = "keep", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its id, ``n_turns``, ``valid``, ``bad_turn``, ``segments`` (text, loss) and ``formatted``.

    ``formatted`` is the segments' texts, one after the other. ``invalid``: keep or drop.
    """
    if invalid not in ("keep", "drop"):
        raise ValueError("invalid: keep or drop")
    told = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    talks = turns.select(F.col(conv_id), told.alias("told")).groupBy(conv_id).agg(F.sort_array(F.collect_list("told")).alias("turns"))
    mark = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                mark(F.concat(F.lit(template.head), template.label_of(t["role"]), F.lit(template.tail))),
                F.struct(template.escaped(t["text"]).alias("text"), template.has_loss(t["role"]).alias("loss")),
                mark(F.lit(template.close)),
            ),
        )
    )
    walked = talks.select(conv_id, F.size("turns").cast("long").alias("n_turns"), template.walked(F.transform("turns", lambda t: t["role"])).alias("walk"), parts.alias("segments"))
    bad = F.coalesce("walk.bad", F.when(~F.col("walk.state").isin(*template.ends), F.col("walk.place")))
    out = walked.select(conv_id, "n_turns", bad.isNull().alias("valid"), bad.alias("bad_turn"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    return out.where("valid") if invalid == "drop" else out


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    pieces = F.split(formatted, _literal(template.close), -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing comes behind the last close
    # the label has no tail in it, so the first one ends it
    label = lambda p: F.substring(F.substring_index(p, template.tail, 1), len(template.head) + 1, 2**31 - 1)
    body = lambda p: F.substr(p, F.length(F.substring_index(p, template.tail, 1)) + F.lit(len(template.tail) + 1))
    return F.transform(turns, lambda p: F.struct(template.role_of(label(p)).alias("role"), template.unescaped(body(p)).alias("text")))


def read_loss(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")


def _literal(text: str) -> str:
    """A regular expression for exactly ``text``."""
    return "\\Q" + text + "\\E"


def digests(talks: DataFrame, template: ChatTemplate = ChatTemplate(), conv_id: str = "conv_id") -> DataFrame:
    """What is read back from ``format_conversations``' output, as digests."""
    turns = F.transform(read_turns(F.col("formatted"), template), lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    read = talks.select(conv_id, turns.alias("turns"), read_loss(F.col("segments"), template).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        conv_id,
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join("turns", "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "bad_turn",
    )
