"""Diagnostic rules: which messages a record gets, by level, module, function and message.

A registry is a configuration of at most some hundred rules, so matching is an array expression per record: no join, no
shuffle. ``match_table`` is the same match against rules that come as a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import rate
from tidelog.operators.blocks import written
from tidelog.schema import PRIORITY, RULE_MESSAGE

#: Category, display name, tag of the prefixes, ANSI colour.
CATEGORIES = {
    "error_analysis": ("Error Analysis", "cause", "91"),
    "solution_suggestion": ("Solution", "fix", "96"),
    "best_practice": ("Best Practice", "suggest", "93"),
    "action_required": ("Action Required", "action", "91;1"),
    "documentation_link": ("Documentation", "docs", "35"),
    "bug_report": ("Report Issue", "report", "33"),
    "general_information": ("Information", "note", "37"),
    "warning_explanation": ("Warning Details", "caution", "33"),
    "performance_tip": ("Performance", "perf", "36"),
    "security_notice": ("Security", "security", "95"),
    "custom": ("Note", "custom", "37"),
}
#: Other names of the categories.
ALIASES = {
    "error_analysis": ("cause", "diagnostic", "analysis"),
    "solution_suggestion": ("fix", "solution", "help"),
    "best_practice": ("suggest", "hint", "tip"),
    "action_required": ("action", "todo"),
    "documentation_link": ("docs", "reference", "link"),
    "bug_report": ("report", "issue"),
    "general_information": ("note", "info"),
    "warning_explanation": ("caution", "warning", "warn"),
    "performance_tip": ("perf", "performance"),
    "security_notice": ("security",),
}
CATEGORY_OF = {alias: category for category, names in ALIASES.items() for alias in names} | {c: c for c in CATEGORIES}


def category_table(spark: SparkSession) -> DataFrame:
    """The dimension of categories; eleven rows."""
    rows = [(c, name, f"    -> [{tag}]", f"    |-- [{tag}]", color) for c, (name, tag, color) in CATEGORIES.items()]
    return spark.createDataFrame(rows, "category string, display_name string, prefix string, prefix_ascii string, color string")


@dataclass(frozen=True)
class RuleMessage:
    category: str
    message: str
    title: str | None = None
    url: str | None = None
    custom_color: str | None = None
    custom_prefix: str | None = None
    use_background: bool = False
    background_color: str | None = None

    def column(self) -> Column:
        values = [CATEGORY_OF[self.category], self.title, self.message, self.url, self.custom_color, self.custom_prefix, self.use_background, self.background_color]
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, RULE_MESSAGE.fields, strict=True)])

    def with_title(self, title: str) -> RuleMessage:
        return replace(self, title=title)

    def with_url(self, url: str) -> RuleMessage:
        return replace(self, url=url)

    def with_color(self, color: str) -> RuleMessage:
        return replace(self, custom_color=color)


def message(category: str, text: str, **more: object) -> RuleMessage:
    """A message by a category's name or alias: ``message("fix", "restart")``."""
    return RuleMessage(CATEGORY_OF[category], text, **more)


@dataclass(frozen=True)
class LevelMatch:
    """``kind``: any, exact, min_priority, max_priority, priority_range or custom_name."""

    kind: str = "any"
    low: int | None = None
    high: int | None = None
    name: str | None = None

    @staticmethod
    def exact(level: str) -> LevelMatch:
        return LevelMatch("exact", PRIORITY[level])

    @staticmethod
    def at_least(priority: int) -> LevelMatch:
        return LevelMatch("min_priority", priority)

    @staticmethod
    def at_most(priority: int) -> LevelMatch:
        return LevelMatch("max_priority", high=priority)

    @staticmethod
    def between(low: int, high: int) -> LevelMatch:
        return LevelMatch("priority_range", low, high)

    @staticmethod
    def custom(name: str) -> LevelMatch:
        return LevelMatch("custom_name", name=name)

    def predicate(self, priority: Column, custom_name: Column) -> Column:
        if self.kind == "exact":
            return priority == self.low
        if self.kind == "min_priority":
            return priority >= self.low
        if self.kind == "max_priority":
            return priority <= self.high
        if self.kind == "priority_range":
            return priority.between(self.low, self.high)
        if self.kind == "custom_name":
            return F.coalesce(custom_name == self.name, F.lit(False))
        return F.lit(True)


@dataclass(frozen=True)
class Rule:
    id: int
    messages: tuple[RuleMessage, ...] = ()
    level: LevelMatch = LevelMatch()
    module: str | None = None
    function: str | None = None
    message_contains: str | None = None
    enabled: bool = True
    once: bool = False
    name: str | None = None

    def predicate(self, columns: Sequence[str]) -> Column:
        """Without ``once``. A null field fails a condition that is set; a condition not set passes."""
        if not self.enabled:
            return F.lit(False)
        has = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
        out = self.level.predicate(F.col("priority"), has("custom_level_name"))
        if self.module is not None:
            out = out & F.coalesce(has("module") == self.module, F.lit(False))
        if self.function is not None:
            out = out & F.coalesce(has("function") == self.function, F.lit(False))
        if self.message_contains is not None:
            out = out & F.contains(F.col("message"), F.lit(self.message_contains))
        return out


class RuleIdExists(ValueError):
    """A rule of that id is there."""


class TooManyRules(ValueError):
    """The registry is full."""


@dataclass
class Rules:
    """An ordered registry."""

    rules: list[Rule] = field(default_factory=list)
    most: int = 1000
    enabled: bool = True

    def add(self, rule: Rule) -> None:
        if self.has(rule.id):
            raise RuleIdExists(str(rule.id))
        if len(self.rules) >= self.most:
            raise TooManyRules(str(self.most))
        self.rules.append(rule)

    def add_or_update(self, rule: Rule) -> None:
        for k, r in enumerate(self.rules):
            if r.id == rule.id:
                self.rules[k] = rule
                return
        self.add(rule)

    def remove(self, rule_id: int) -> bool:
        before = len(self.rules)
        self.rules = [r for r in self.rules if r.id != rule_id]
        return len(self.rules) < before

    def get(self, rule_id: int) -> Rule | None:
        return next((r for r in self.rules if r.id == rule_id), None)

    def has(self, rule_id: int) -> bool:
        return self.get(rule_id) is not None

    def enable(self, rule_id: int, enabled: bool = True) -> bool:
        for k, r in enumerate(self.rules):
            if r.id == rule_id:
                self.rules[k] = replace(r, enabled=enabled)
                return True
        return False

    def clear(self) -> None:
        self.rules.clear()

    def __len__(self) -> int:
        return len(self.rules)

    def _tested(self, df: DataFrame, time: str, id_column: str) -> DataFrame:
        """Add a boolean ``_rule_<place>`` for each rule; each test is written once in the plan.

        A rule of ``once`` fires on its first record by (time, id): its place is found by an aggregate over the data,
        one row for all such rules, which goes back into the expression. That runs what is upstream once more; write or
        persist it first if it is costly. On a stream a state remembers which rules have fired.
        """
        if not self.enabled:
            return df.withColumns({f"_rule_{k}": F.lit(False) for k in range(len(self.rules))}) if self.rules else df
        if df.isStreaming:
            tested = df.withColumns({f"_rule_{k}": F.coalesce(r.predicate(df.columns), F.lit(False)) for k, r in enumerate(self.rules)}) if self.rules else df
            once = [f"_rule_{k}" for k, r in enumerate(self.rules) if r.once]
            if not once:
                return tested
            from tidelog.streaming.stateful import first_only

            return first_only(tested, once, time, id_column)
        first = self._first_records(df, time, id_column)
        tests = {}
        for k, r in enumerate(self.rules):
            test = r.predicate(df.columns)
            if r.once:
                at = first.get(r.id)
                test = F.lit(False) if at is None else test & (F.col(time) == at[0]) & (F.col(id_column) == at[1])
            tests[f"_rule_{k}"] = F.coalesce(test, F.lit(False))
        return df.withColumns(tests) if tests else df

    def _ids(self) -> Column:
        """The ids of the rules that hold, in order; expressions that Spark compiles, no lambda."""
        none = -(2**31)
        hits = [F.when(F.col(f"_rule_{k}"), F.lit(r.id)).otherwise(F.lit(none)) for k, r in enumerate(self.rules)]
        return F.array_remove(F.array(*hits), none) if hits else F.array().cast("array<int>")

    def matched(self, df: DataFrame, time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
        """Add ``rule_ids``, the ids of the rules that match each record, in insertion order."""
        return self._tested(df, time, id_column).select(*df.columns, self._ids().alias("rule_ids"))

    def _first_records(self, df: DataFrame, time: str, id_column: str) -> dict[int, tuple]:
        once = [r for r in self.rules if r.once]
        if not once:
            return {}
        firsts = df.agg(*[F.min(F.when(r.predicate(df.columns), F.struct(time, id_column))).alias(f"r{r.id}") for r in once]).first()
        return {r.id: tuple(firsts[f"r{r.id}"]) for r in once if firsts[f"r{r.id}"] is not None}

    def evaluate(self, df: DataFrame, time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
        """Add ``rule_ids`` and ``rule_messages``: the messages of all matching rules, in order; null if none match."""
        kind = f"array<{RULE_MESSAGE.simpleString()}>"
        empty = F.array().cast(kind)
        own = [F.when(F.col(f"_rule_{k}"), F.array(*[m.column() for m in r.messages]).cast(kind)).otherwise(empty) for k, r in enumerate(self.rules) if r.messages]
        some = F.lit(False)
        for k in range(len(self.rules)):
            some = some | F.col(f"_rule_{k}")
        found = F.when(some, F.flatten(F.array(*own)) if own else empty)
        return self._tested(df, time, id_column).select(*df.columns, self._ids().alias("rule_ids"), found.alias("rule_messages"))

    def stats(self, df: DataFrame, time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
        """One row; ``skipped``: the records that a registry which is switched off hasn't looked at."""
        out = self.evaluate(df, time, id_column)
        n = F.count(F.lit(1))
        none = F.lit(0).cast("long")
        evaluated, skipped = (n, none) if self.enabled else (none, n)
        matched = F.coalesce(F.sum(F.size("rule_ids")), F.lit(0))
        emitted = F.coalesce(F.sum(F.coalesce(F.size("rule_messages"), F.lit(0))), F.lit(0))
        out = out.withColumn("rule_messages", F.coalesce("rule_messages", F.array().cast(f"array<{RULE_MESSAGE.simpleString()}>")))
        return out.agg(evaluated.alias("evaluated"), matched.alias("matched"), emitted.alias("messages_emitted"), skipped.alias("skipped"), rate(matched, evaluated).alias("match_rate"))


#: Characters of the shortest pieces by which a rule's text is looked up; longer texts are, by pieces 2, 4 or 8 times as long.
PIECE = 3
LONGER = (1, 2, 4, 8)
#: Rules of a kind, and characters of their texts, that are broadcast at most. More are shuffled, as records are.
FEW_RULES, FEW_CHARACTERS = 20_000, 2_000_000
#: How many numbers stand for the first characters of pieces.
OPENINGS = 1 << 16


def pieces(text: Column, size: int = PIECE) -> Column:
    """The distinct runs of ``size`` characters of a text; linear in its length."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))  # looks ahead from each character
    return F.array_distinct(F.coalesce(runs, F.array().cast("array<string>")))


def _opening(piece: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(piece, F.lit(PIECE))), F.lit(OPENINGS))


def _opened(cut: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cut`` without pieces that begin like none of ``wanted``, by a broadcast of at most ``OPENINGS`` numbers."""
    openings = wanted.select(_opening(F.col("piece")).alias("_opening")).distinct()
    return cut.withColumn("_opening", _opening(F.col("piece"))).join(F.broadcast(openings), "_opening", "left_semi").drop("_opening")


def _met(rows: DataFrame, rules: DataFrame, on: Column | str, few: bool) -> DataFrame:
    """Records never are what is broadcast: their compressed size says little about what they take on the driver."""
    return rows.join(F.broadcast(rules), on) if few else rows.hint("merge").join(rules.hint("merge"), on)


def _met_by_text(rows: DataFrame, mine: DataFrame, sizes: Sequence[int], few: bool) -> DataFrame:
    """Records with the rules ``mine`` (``r_piece``: one of ``sizes``) that are looked up by a piece which they have."""
    cut = rows.where("message IS NOT NULL").withColumn("piece", F.explode(F.concat(*[pieces(F.col("message"), s) for s in sizes])))
    own = F.array().cast("array<string>")
    for s in sizes:
        own = F.when(F.col("r_piece") == s, pieces(F.col("text"), s)).otherwise(own)
    texts = mine.select(F.col("r_message_contains").alias("text"), "r_piece").distinct()
    asked = texts.select("text", F.explode(own).alias("piece"))
    there = cut.select("piece")
    there = there.join(F.broadcast(asked.select("piece").distinct()), "piece", "left_semi") if few else _opened(there, asked)
    often = there.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # of few rules the counts are of their pieces alone; of many, they are as many as the records' pieces
    counted = asked.join(F.broadcast(often), "piece", "left") if few else asked.hint("merge").join(often.hint("merge"), "piece", "left")
    best = counted.groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best"))
    best = best.where("best.n > 0").select("text", "best.piece")  # a rule whose rarest piece no record has matches none
    if not few:
        best = written(best, "pieces")
        cut = _opened(cut, best)
    return _met(cut, _met(mine, best, F.col("r_message_contains") == F.col("text"), few).drop("text"), "piece", few)


def match_table(records: DataFrame, rules: DataFrame, id_column: str = "event_id", size: int = PIECE) -> DataFrame:
    """(id, rule_id) pairs for rules in a table (id, enabled, level_min, level_max, module, function, message_contains).

    However many rules there are, records meet theirs by equality, and what else a rule asks for is tested after. A rule with a text of at
    least ``size`` characters is looked up by that piece of its text which the fewest records have; a message has a piece of itself
    for each place. A piece has ``size`` characters, or 2, 4 or 8 times as many, the most that the text has, so that it stays rare however
    many records and rules there are. Other rules go by module, by function, or by each of the priorities that there are. Null fields of
    a rule ask for nothing; a null field of a record fails what is asked.

    Few rules of a kind are broadcast, and records stay where they are; for many, both are shuffled.
    """
    r = rules.where("enabled").select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    function = F.col("function") if "function" in records.columns else F.lit(None).cast("string")
    rows = records.select(F.col(id_column), F.col("priority"), F.col("module"), function.alias("function"), F.col("message"))
    held = (
        (F.col("r_level_min").isNull() | (F.col("priority") >= F.col("r_level_min")))
        & (F.col("r_level_max").isNull() | (F.col("priority") <= F.col("r_level_max")))
        & (F.col("r_module").isNull() | F.coalesce(F.col("module") == F.col("r_module"), F.lit(False)))
        & (F.col("r_function").isNull() | F.coalesce(F.col("function") == F.col("r_function"), F.lit(False)))
        & (F.col("r_message_contains").isNull() | F.contains("message", "r_message_contains"))
    )
    length = F.length("r_message_contains")
    kind = F.when(length >= size, "text").when(F.col("r_module").isNotNull(), "module").when(F.col("r_function").isNotNull(), "function").otherwise("level")
    piece = F.lit(None).cast("int")
    for k in LONGER:
        piece = F.when(length >= k * size, k * size).otherwise(piece)
    r = r.withColumns({"r_kind": kind, "r_piece": piece})
    counts = r.groupBy("r_kind", F.when(F.col("r_kind") == "text", F.col("r_piece")).alias("piece")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(length, F.lit(0))).alias("characters")).collect()  # at most seven rows
    kinds = {(c["r_kind"], c["piece"]): c["n"] <= FEW_RULES and c["characters"] <= FEW_CHARACTERS for c in counts}
    found = []
    for few in (True, False):
        sizes = sorted(s for (k, s), v in kinds.items() if k == "text" and v == few)
        if sizes:
            found.append(_met_by_text(rows, r.where((F.col("r_kind") == "text") & F.col("r_piece").isin(sizes)), sizes, few))
    found += [_met(rows, r.where(F.col("r_kind") == k), F.col(k) == F.col(f"r_{k}"), kinds[k, None]) for k in ("module", "function") if (k, None) in kinds]
    if ("level", None) in kinds:
        there = sorted(p["priority"] for p in rows.select("priority").where("priority IS NOT NULL").distinct().collect())  # levels: a few numbers
        all_of = F.array(*[F.lit(p) for p in there]).cast("array<int>")
        own = F.filter(all_of, lambda p: F.coalesce(p >= F.col("r_level_min"), F.lit(True)) & F.coalesce(p <= F.col("r_level_max"), F.lit(True)))
        free = F.col("r_level_min").isNull() & F.col("r_level_max").isNull()
        by_level = r.where("r_kind = 'level'").withColumn("r_priority", F.explode(F.concat(F.transform(own, lambda p: p.cast("string")), F.when(free, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>")))))
        found.append(_met(rows, by_level, F.coalesce(F.col("priority").cast("string"), F.lit("none")) == F.col("r_priority"), kinds["level", None]))
    if not found:
        return rows.select(id_column, F.lit(None).cast(rules.schema["id"].dataType).alias("rule_id")).limit(0)
    out = None
    for pairs in found:
        kept = pairs.where(held).select(id_column, F.col("r_id").alias("rule_id"))
        out = kept if out is None else out.union(kept)
    return out


def _prefix(m: Column, ascii_only: bool) -> Column:
    mark = "|--" if ascii_only else "->"
    out = None
    for c, (_, tag, _) in CATEGORIES.items():
        text = F.lit(f"    {mark} [{tag}]")
        out = F.when(m["category"] == c, text) if out is None else out.when(m["category"] == c, text)
    return F.coalesce(m["custom_prefix"], out)


def render_text(messages: Column, ascii_only: bool = False) -> Column:
    """A line for each message: prefix, title, text and link. Empty for null."""
    title = lambda m: F.when(m["title"].isNotNull(), F.concat(m["title"], F.lit(": "))).otherwise(F.lit(""))
    link = lambda m: F.when(m["url"].isNotNull(), F.concat(F.lit(" ("), m["url"], F.lit(")"))).otherwise(F.lit(""))
    lines = F.transform(messages, lambda m: F.concat(F.lit("\n"), _prefix(m, ascii_only), F.lit(" "), title(m), m["message"], link(m)))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def render_json(messages: Column) -> Column:
    """[{category, title, message, url}], without what is null."""
    return F.to_json(F.transform(messages, lambda m: F.struct(m["category"].alias("category"), m["title"].alias("title"), m["message"].alias("message"), m["url"].alias("url"))))


def once_by_key(df: DataFrame, rule: Rule, key_by: Sequence[str], time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
    """The first matching record of each key."""
    hits = df.where(rule.predicate(df.columns))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key_by).orderBy(time, id_column))).where("_n = 1").drop("_n")
