"""Filters as predicates. A filter is a conjunction: the first rule that fails rejects; without rules all is accepted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.levels import nearest_priority
from tidelog.functions.scalars import rate
from tidelog.schema import PRIORITY


@dataclass(frozen=True)
class FilterRule:
    """``kind``: level_min, level_max, level_exact, module_prefix, module_match, message_contains, message_regex, custom."""

    kind: str
    value: object
    allow: bool = True

    def predicate(self, strict: bool = False) -> Column:
        """``strict``: denials by module have no effect and regular expressions and custom rules are passed over, as in
        the record-at-a-time library; otherwise they do what they say. A null message or module holds no text."""
        priority, module, message = F.col("priority"), F.col("module"), F.col("message")
        if self.kind == "level_min":
            return priority >= self.value
        if self.kind == "level_max":
            return priority <= self.value
        if self.kind == "level_exact":
            return priority == self.value
        if self.kind in ("message_regex", "custom") and strict:
            return F.lit(True)
        if self.kind == "module_prefix":
            held = F.coalesce(F.startswith(module, F.lit(self.value)), F.lit(False))
        elif self.kind == "module_match":
            held = F.coalesce(module == self.value, F.lit(False))
        elif self.kind == "message_contains":
            held = F.coalesce(F.contains(message, F.lit(self.value)), F.lit(False))
        elif self.kind == "message_regex":
            held = F.coalesce(F.rlike(message, F.lit(self.value)), F.lit(False))
        elif self.kind == "custom":
            held = F.coalesce(self.value, F.lit(False))
        else:
            raise ValueError(f"unknown filter rule {self.kind!r}")
        if self.allow:
            return held
        return F.lit(True) if strict and self.kind.startswith("module") else ~held


@dataclass(frozen=True)
class Filter:
    rules: tuple[FilterRule, ...] = ()
    enabled: bool = True
    strict: bool = False

    def add(self, kind: str, value: object, allow: bool = True) -> Filter:
        return replace(self, rules=(*self.rules, FilterRule(kind, value, allow)))

    def min_level(self, level: str) -> Filter:
        return self.add("level_min", PRIORITY[level])

    def max_level(self, level: str) -> Filter:
        return self.add("level_max", PRIORITY[level])

    def min_priority(self, priority: int) -> Filter:
        """An unknown priority counts as INFO."""
        return self.add("level_min", nearest_priority(priority, "INFO"))

    def priority_range(self, low: int, high: int) -> Filter:
        """An unknown low counts as INFO, an unknown high as CRITICAL."""
        return self.min_priority(low).add("level_max", nearest_priority(high, "CRITICAL"))

    def module_prefix(self, text: str, allow: bool = True) -> Filter:
        return self.add("module_prefix", text, allow)

    def message(self, text: str, allow: bool = True) -> Filter:
        return self.add("message_contains", text, allow)

    def clear(self) -> Filter:
        return replace(self, rules=())

    def disable(self) -> Filter:
        return replace(self, enabled=False)

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.enabled:
            for rule in self.rules:
                out = out & rule.predicate(self.strict)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())

    def flag(self, df: DataFrame, name: str = "allowed") -> DataFrame:
        """Keep all rows and say which pass."""
        return df.withColumn(name, self.predicate())

    def stats(self, df: DataFrame) -> DataFrame:
        allowed = F.count_if(self.predicate())
        total = F.count(F.lit(1))
        return df.agg(total.alias("total"), allowed.alias("allowed"), (total - allowed).alias("filtered"), rate(allowed, total).alias("allow_rate"), rate(total - allowed, total).alias("filter_rate"))

    @staticmethod
    def errors_only() -> Filter:
        return Filter().min_level("ERROR")

    @staticmethod
    def production() -> Filter:
        return Filter().min_level("INFO")

    @staticmethod
    def module_only(text: str) -> Filter:
        return Filter().module_prefix(text)

    @staticmethod
    def from_config(level: str) -> Filter:
        return Filter().min_level(level)


def level_gate(df: DataFrame, minimum: str, modules: Mapping[str, str] | None = None, enabled: bool = True) -> DataFrame:
    """The first filter: at least ``minimum``, or the level set for exactly this module, which may be lower or higher.

    The module table is a configuration, a literal map in the plan: no join and no shuffle.
    """
    if not enabled:
        return df.where(F.lit(False))
    least: Column = F.lit(PRIORITY[minimum])
    if modules:
        table = F.create_map(*[F.lit(x) for name, level in modules.items() for x in (name, PRIORITY[level])])
        least = F.coalesce(F.when(F.col("module").isNotNull(), F.try_element_at(table, F.col("module"))), least)
    return df.where(F.col("priority") >= least)


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class SinkFilter:
    """What one sink takes: an inclusive level band, and prefix and substring lists. Empty lists don't constrain."""

    level: str | None = None
    max_level: str | None = None
    include_modules: tuple[str, ...] = ()
    exclude_modules: tuple[str, ...] = ()
    include_messages: tuple[str, ...] = ()
    exclude_messages: tuple[str, ...] = ()
    extra: tuple[Column, ...] = field(default=())

    def predicate(self) -> Column:
        module, message = F.col("module"), F.col("message")
        out = F.lit(True)
        if self.level:
            out = out & (F.col("priority") >= PRIORITY[self.level])
        if self.max_level:
            out = out & (F.col("priority") <= PRIORITY[self.max_level])
        if self.include_modules:
            out = out & _any([F.startswith(module, F.lit(p)) for p in self.include_modules])
        if self.exclude_modules:
            out = out & ~_any([F.startswith(module, F.lit(p)) for p in self.exclude_modules])
        if self.include_messages:
            out = out & _any([F.contains(message, F.lit(p)) for p in self.include_messages])
        if self.exclude_messages:
            out = out & ~_any([F.contains(message, F.lit(p)) for p in self.exclude_messages])
        for c in self.extra:
            out = out & c
        return out
