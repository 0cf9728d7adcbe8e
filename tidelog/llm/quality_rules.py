"""Operator 2. Quality rules: decision lists, learned by sequential covering, applied as Spark expressions.

``learn`` works on a bounded sample of labelled statistics on the driver. It grows a rule for rejection one threshold
condition at a time (by FOIL's information gain, on two thirds of the rows that are left), prunes it (last conditions go
as long as the rule gets better on the other third), and keeps it if it is precise there and on all rows left; the rows
that it covers go, and the next rule is learned. What no rule covers is kept. ``verdict`` turns the list into one
``CASE WHEN`` over the statistics, so Spark applies it next to the scan and it can be read.

Defined cases. A null or empty text has no words and fails the base rule. Labels that are null or belong to no document
are not used; with labels of one class only, or none, there are no rules and the base rule alone decides. Repeated rows
are judged row by row; very long texts are read whole. Ties between conditions go to the earlier statistic and the lower threshold. NaN never occurs:
ratios have a denominator of at least 1. Other columns of the input are kept, unless they have the name of a statistic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import bounded_sample, map_texts
from tidelog.llm.text_stats import SCHEMA, text_statistics

#: Labels that rules are learned from, at most, those of the least hashes of doc_id. As a doc_id may have several rows, twice
#: as many documents may come of them, no more.
SAMPLE_ROWS = 20_000

#: Thresholds that are tried for each statistic when a rule grows.
CUTS = 48

#: A rule has to reject rightly this share of what it covers, and to cover so many rows.
PRECISION, SUPPORT = 0.95, 8

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def measures() -> dict[str, Column]:
    """What conditions are about: name and Spark expression over the statistics of a text."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbol_share": _ratio("n_symbols", "word_chars"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "distinct_share": _ratio("n_distinct_words", "n_words"),
        "upper_share": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "digit_share": _ratio("n_digits", "word_chars"),
        "bang_share": _ratio("n_bangs", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # else at most
    cut: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.cut if self.above else values <= self.cut


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        held &= c.holds(x[c.measure])
    return held


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of the best gain until no good row is covered or nothing is gained."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while True:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n0 or not p0:
            return tuple(rule)
        best, gain = None, 1e-9
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], np.cumsum(b[order])
            ends = np.flatnonzero(v[1:] != v[:-1])  # a cut may lie after these places
            if not len(ends):
                continue
            if len(ends) > CUTS:
                ends = ends[np.unique(np.linspace(0, len(ends) - 1, CUTS).astype(int))]
            p_low = b[ends].astype(float)
            n_low = ends + 1 - p_low
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                if g[k := int(np.argmax(g))] > gain:
                    best, gain = Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)), float(g[k])
        if best is None:
            return tuple(rule)
        rule.append(best)
        inside &= best.holds(x[best.measure])


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest head of the rule that does best, by (right - wrong) / covered, on rows that didn't grow it."""

    def worth(r: Rule) -> float:
        held = _covers(r, x)
        return (2 * int((held & bad).sum()) - int(held.sum())) / max(1, int(held.sum()))

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16) -> list[Rule]:
    """Ordered rules that reject; ``x``: values by measure, ``bad``: rows to reject."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    for turn in range(most_rules):
        if (left & bad).sum() < SUPPORT:
            break
        rows = np.flatnonzero(left)
        third = (rows * 2654435761 % 2**32 // 7 + turn) % 3 == 0  # another third each time, the same at each run
        part = {True: {n: v[rows[third]] for n, v in x.items()}, False: {n: v[rows[~third]] for n, v in x.items()}}
        rule = _prune(_grow(part[False], bad[rows[~third]]), part[True], bad[rows[third]])
        if not rule:
            break
        for check in (rows, rows[third]):
            held = _covers(rule, {n: v[check] for n, v in x.items()})
            right = int((held & bad[check]).sum())
            if right < PRECISION * held.sum() or (check is rows and right < SUPPORT):
                break
        else:
            rules.append(rule)
            left &= ~_covers(rule, x)
            continue
        break
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false at the first rule that holds, else true."""
    by_name = measures()
    out = None
    for rule in rules:
        held = None
        for c in rule:
            one = by_name[c.measure] > F.lit(c.cut) if c.above else by_name[c.measure] <= F.lit(c.cut)
            held = one if held is None else held & one
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def statistics(docs: DataFrame, keep: list, text: str = "text") -> DataFrame:
    return map_texts(docs, text, keep, SCHEMA, text_statistics)


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled documents that pass the base rule; labels: key, quality (1: good)."""
    sample = bounded_sample(labels.select(F.col(key).alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL"), sample_rows)
    marked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by sample_rows
    by_name = measures()
    rows = statistics(marked, ["doc_id", "quality"]).where(~base_failed()).select("doc_id", "quality", *[by_name[n].alias(f"m_{n}") for n in by_name])
    frame = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *[f"m_{n}" for n in by_name]).limit(2 * sample_rows).toPandas()  # a doc_id may have several rows
    bad = frame["quality"].to_numpy() == 0
    return learn({n: frame[f"m_{n}"].to_numpy(dtype=float) for n in by_name}, bad)


def judge(docs: DataFrame, rules: list[Rule], keep: list, text: str = "text") -> DataFrame:
    """The columns ``keep``, the statistics, base_failed and kept."""
    return statistics(docs, keep, text).withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})


def describe(rules: list[Rule]) -> str:
    """The list, readable."""
    return "\n".join("reject if " + " and ".join(f"{c.measure} {'>' if c.above else '<='} {c.cut:g}" for c in r) for r in rules) or "keep all"
