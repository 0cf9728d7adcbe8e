"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def main() -> None:
    from tidelog.functions import formatting, redaction
    from tidelog.operators import metrics, retention, rules, sampling
    from tidelog.operators.filters import Filter, level_gate
    from tidelog.plans.pipeline import LogPipeline
    from tidelog.sources import adapters

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = adapters.lineitem(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"))
    book = rules.Rules()
    for k in range(10):
        book.add(rules.Rule(k, (rules.message("note", f"quantity {k}"),), rules.LevelMatch.at_least(20 + k), message_contains=f"quantity={k}"))
    flow = LogPipeline("INFO", sampler=sampling.Sampler("probability", (("p", 0.9),)), patterns=(("contains", "order", "o"), ("regex", r"quantity=\d", "q=#")), filter=Filter().message("q=#9", allow=False), rules=book)
    queries = {
        "gate_filter": lambda: Filter().message("quantity=1", allow=False).apply(level_gate(lines, "WARNING")),
        "redact": lambda: lines.withColumn("message", redaction.redact_message(F.col("message"), flow.patterns)),
        "rules_x10": lambda: book.evaluate(lines),
        "format_json": lambda: lines.select(formatting.json_line(lines.columns).alias("line")),
        "metrics_by_level": lambda: metrics.level_counts(lines),
        "rate_limit_fold": lambda: sampling.flag_rate_limit(lines.select("event_id", "ts_ms", "supplier"), 2, 86_400_000, "ts_ms", "event_id", ["supplier"]),
        "rotation_fold": lambda: retention.size_index(lines.select("event_id", "ts_ms", "size", "supplier"), "size", 500, ["ts_ms", "event_id"], ["supplier"]),
        "full_pipeline": lambda: flow.apply(lines).select(formatting.json_line([*lines.columns, "rule_messages"]).alias("line")),
    }
    records = lines.count()
    took, rates = {}, {}
    for name, make in queries.items():
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 4)
        rates[name] = round(records / took[name])
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "records": records, "records_per_second": rates, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
