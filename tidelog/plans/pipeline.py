"""The fixed order of a log pipeline, over a batch or a stream.

gate -> sampler -> redaction -> filter -> rules -> context -> observation. All but stateful samplers and ``once`` rules
are expressions of one projection: Spark runs them next to the scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.functions.redaction import Pattern, redact_context, redact_message
from tidelog.operators.enrich import literal_map, merge_context
from tidelog.operators.filters import Filter, level_gate
from tidelog.operators.rules import Rules
from tidelog.operators.sampling import Sampler


@dataclass
class LogPipeline:
    level: str = "INFO"
    module_levels: Mapping[str, str] = field(default_factory=dict)
    sampler: Sampler = Sampler()
    patterns: tuple[Pattern, ...] = ()
    fields: Mapping[str, str] = field(default_factory=dict)
    filter: Filter = Filter()
    rules: Rules | None = None
    context: Mapping[str, object] = field(default_factory=dict)
    enabled: bool = True
    time: str = "ts_ms"
    id_column: str = "event_id"

    def apply(self, df: DataFrame, observation: Observation | None = None) -> DataFrame:
        """The records that survive, enriched; the input's columns and, with rules, rule_ids and rule_messages."""
        out = level_gate(df, self.level, self.module_levels, self.enabled)
        if self.sampler.strategy != "none":
            out = self.sampler.apply(out, self.time, self.id_column)
        if self.patterns:
            out = out.withColumn("message", redact_message(F.col("message"), self.patterns))
        out = self.filter.apply(out)
        if self.rules is not None:
            out = self.rules.evaluate(out, self.time, self.id_column)
        if "context" in out.columns:
            context = merge_context(literal_map(self.context), F.col("context")) if self.context else F.col("context")
            out = out.withColumn("context", redact_context(context, self.fields) if self.fields else context)
        if observation is not None:
            out = out.observe(observation, F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("message")).alias("bytes"))
        return out
