"""Scalar functions: sizes, durations, calendar, rates, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIZE = r"^(\d+)\s*([A-Za-z]*)"
_SIZE_UNITS = {"K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "T": 1 << 40, "TB": 1 << 40}
_DURATION_UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def _scaled(text: Column, units: dict[str, int], upper: bool) -> Column:
    number = F.regexp_extract(text, _SIZE, 1)
    unit = F.regexp_extract(text, _SIZE, 2)
    unit = F.upper(unit) if upper else unit
    factor = None
    for name, n in units.items():
        factor = F.when(unit == name, F.lit(n)) if factor is None else factor.when(unit == name, F.lit(n))
    return F.when(number != "", number.cast("long") * factor.otherwise(F.lit(1)).cast("long"))


def parse_size(text: Column) -> Column:
    """Bytes of texts like ``10 MB``; units in any case; unknown units are bytes; null without digits."""
    return _scaled(text, _SIZE_UNITS, True)


def parse_duration(text: Column) -> Column:
    """Milliseconds of texts like ``5m``; unknown units are milliseconds; null without digits."""
    return _scaled(text, _DURATION_UNITS, False)


def _steps(value: Column, steps: list[tuple[float, float, str]], small: Column) -> Column:
    out = None
    for low, divisor, unit in steps:
        shown = F.format_string(f"%.2f{unit}", value.cast("double") / F.lit(float(divisor)))
        out = F.when(value >= low, shown) if out is None else out.when(value >= low, shown)
    return out.otherwise(small)


def format_size(n: Column) -> Column:
    return _steps(n, [(1 << 40, 1 << 40, " TB"), (1 << 30, 1 << 30, " GB"), (1 << 20, 1 << 20, " MB"), (1 << 10, 1 << 10, " KB")], F.concat(n.cast("string"), F.lit(" B")))


def format_duration(ms: Column) -> Column:
    return _steps(ms, [(86_400_000, 86_400_000, "d"), (3_600_000, 3_600_000, "h"), (60_000, 60_000, "m"), (1_000, 1_000, "s")], F.concat(ms.cast("string"), F.lit("ms")))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_epoch_ms(ms: Column) -> Column:
    """The UTC wall clock (TIMESTAMP_NTZ) of milliseconds since 1970; negative ones count as 0."""
    return F.timestamp_add("MILLISECOND", F.greatest(ms, F.lit(0)), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def same_day(a: Column, b: Column) -> Column:
    """Whether two epoch seconds are of one UTC day."""
    return F.floor(a / 86_400) == F.floor(b / 86_400)


def same_hour(a: Column, b: Column) -> Column:
    return F.floor(a / 3_600) == F.floor(b / 3_600)


def start_of_day(seconds: Column) -> Column:
    return (F.floor(seconds / 86_400) * 86_400).cast("long")


def start_of_hour(seconds: Column) -> Column:
    return (F.floor(seconds / 3_600) * 3_600).cast("long")


def elapsed(start: Column, end: Column) -> Column:
    """Never negative."""
    return F.greatest(end - start, F.lit(0))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def to_unsigned(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def pad_digits(x: Column, width: int) -> Column:
    """Zero-padded; longer numbers stay whole."""
    text = x.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 (or null)."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    return rate(part, whole) * 100


def throughput(count: Column, elapsed_ns: Column) -> Column:
    """Per second."""
    return rate(count, elapsed_ns.cast("double") / F.lit(1e9))


def throughput_ms(count: Column, elapsed_ms: Column) -> Column:
    return rate(count, elapsed_ms.cast("double") / F.lit(1e3))


def compression_ratio(before: Column, after: Column) -> Column:
    return rate(before, after)


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise((1 - rate(after, before)) * 100)


def retry_delay(interval: Column, multiplier: Column, attempt: Column) -> Column:
    return interval * F.pow(multiplier, attempt)


def escape_json(text: Column) -> Column:
    """The inside of a JSON string."""
    quoted = F.to_json(F.array(text))
    return quoted.substr(F.lit(3), F.length(quoted) - 4)
