"""Redaction of values and messages as string expressions. Masks count characters, not bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = "[REDACTED]"
START_CHARS = END_CHARS = 4
REVEAL = 3
MASK = "*"

#: Field to redaction type, by preset.
PRESETS: dict[str, dict[str, str]] = {
    "common": {"password": "full", "secret": "full", "api_key": "partial_end", "token": "partial_end", "credit_card": "mask_middle", "ssn": "mask_middle", "email": "partial_start"},
    "pci_dss": {"pan": "mask_middle", "cvv": "full", "pin": "full", "card_number": "mask_middle", "expiry": "full"},
    "hipaa": {"patient_id": "hash", "ssn": "full", "dob": "full", "address": "partial_end", "phone": "partial_start", "email": "partial_start", "medical_record": "hash"},
    "gdpr": {"name": "partial_end", "email": "partial_start", "phone": "partial_start", "address": "full", "ip": "partial_end", "ip_address": "partial_end", "user_id": "hash"},
    "api_secrets": {"api_key": "mask_middle", "secret_key": "full", "access_token": "mask_middle", "refresh_token": "full", "bearer_token": "mask_middle", "authorization": "partial_end"},
    "financial": {"account_number": "mask_middle", "routing_number": "full", "balance": "full", "amount": "full", "iban": "mask_middle", "swift": "partial_end"},
}


def full(value: Column, replacement: str = REPLACEMENT) -> Column:
    return F.when(value.isNotNull(), F.lit(replacement))


def partial_start(value: Column, end_chars: int = END_CHARS, mask: str = MASK) -> Column:
    """Show the last characters only."""
    n = F.length(value)
    return F.when(n <= end_chars, F.lit(mask * end_chars)).otherwise(F.concat(F.repeat(F.lit(mask), (n - end_chars).cast("int")), F.right(value, F.lit(end_chars))))


def partial_end(value: Column, start_chars: int = START_CHARS, mask: str = MASK) -> Column:
    """Show the first characters only."""
    n = F.length(value)
    return F.when(n <= start_chars, F.lit(mask * start_chars)).otherwise(F.concat(F.left(value, F.lit(start_chars)), F.repeat(F.lit(mask), (n - start_chars).cast("int"))))


def mask_middle(value: Column, reveal: int = REVEAL, mask: str = MASK) -> Column:
    n = F.length(value)
    shown = F.concat(F.left(value, F.lit(reveal)), F.repeat(F.lit(mask), (n - 2 * reveal).cast("int")), F.right(value, F.lit(reveal)))
    return F.when(n <= 2 * reveal, F.lit(mask * 3)).otherwise(shown)


def hashed(value: Column) -> Column:
    return F.concat(F.lit("[HASH:"), F.substring(F.sha2(value, 256), 1, 16), F.lit("]"))


TYPES = {"full": full, "partial_start": partial_start, "partial_end": partial_end, "mask_middle": mask_middle, "hash": hashed}


def redact_field(field: str, value: Column, fields: Mapping[str, str], ignore_case: bool = True) -> Column:
    """Redact a value by its field's name: exact, else without regard to case; fields not listed stay as they are."""
    kind = fields.get(field) or ({k.lower(): v for k, v in fields.items()}.get(field.lower()) if ignore_case else None)
    return TYPES[kind](value) if kind else value


def redact_named(name: Column, value: Column, fields: Mapping[str, str], ignore_case: bool = True) -> Column:
    """``redact_field`` for a column of field names."""
    key = F.lower(name) if ignore_case else name
    by_kind: dict[str, list[str]] = {}
    for f, kind in fields.items():
        by_kind.setdefault(kind, []).append(f.lower() if ignore_case else f)
    out = None
    for kind, names in by_kind.items():
        out = F.when(key.isin(names), TYPES[kind](value)) if out is None else out.when(key.isin(names), TYPES[kind](value))
    return value if out is None else out.otherwise(value)


def redact_context(context: Column, fields: Mapping[str, str], ignore_case: bool = True) -> Column:
    return F.transform_values(context, lambda k, v: redact_named(k, v, fields, ignore_case))


def contains(message: Column, pattern: str, replacement: str) -> Column:
    """Every occurrence of the text; the pattern must not be empty."""
    _not_empty(pattern)
    return F.replace(message, F.lit(pattern), F.lit(replacement))


def prefix(message: Column, pattern: str, replacement: str) -> Column:
    _not_empty(pattern)
    return F.when(F.startswith(message, F.lit(pattern)), F.concat(F.lit(replacement), F.substr(message, F.lit(len(pattern) + 1)))).otherwise(message)


def suffix(message: Column, pattern: str, replacement: str) -> Column:
    _not_empty(pattern)
    cut = F.substr(message, F.lit(1), (F.length(message) - len(pattern)).cast("int"))
    return F.when(F.endswith(message, F.lit(pattern)), F.concat(cut, F.lit(replacement))).otherwise(message)


def exact(message: Column, pattern: str, replacement: str) -> Column:
    return F.when(message == pattern, F.lit(replacement)).otherwise(message)


def _not_empty(pattern: str) -> None:
    if not pattern:
        raise ValueError("an empty pattern matches nothing")


def translate(pattern: str) -> str:
    """A regular expression (Java, RE2) for the small pattern dialect: ``\\d \\w \\s`` and negations, ``.``, ``*`` any run
    (lazy, greedy if last), ``+`` one or more of anything (lazy; exactly one if last), all else literal."""
    _not_empty(pattern)
    out, k = ["(?s)"], 0
    while k < len(pattern):
        c = pattern[k]
        last = k == len(pattern) - 1
        if c == "\\" and not last:
            k += 1
            out.append("\\" + pattern[k] if pattern[k] in "dwsDWS" else re.escape(pattern[k]))
        elif c == ".":
            out.append(".")
        elif c == "*":
            out.append(".*" if last else ".*?")
        elif c == "+":
            out.append("." if last else ".+?")
        else:
            out.append(re.escape(c))
        k += 1
    made = "".join(out)
    if re.match(made, ""):
        raise ValueError(f"pattern {pattern!r} can match nothing")
    return made


def regex(message: Column, pattern: str, replacement: str) -> Column:
    """Leftmost matches that don't overlap, in the dialect of ``translate``."""
    return F.regexp_replace(message, translate(pattern), re.sub(r"([\\$])", r"\\\1", replacement))


KINDS = {"contains": contains, "prefix": prefix, "suffix": suffix, "exact": exact, "regex": regex}

Pattern = tuple[str, str, str]  # kind, pattern, replacement


def redact_message(message: Column, patterns: Iterable[Pattern]) -> Column:
    """Patterns one after the other, each on what the last one left."""
    for kind, pattern, replacement in patterns:
        message = KINDS[kind](message, pattern, replacement)
    return message


def audit(message: Column, patterns: Iterable[Pattern]) -> Column:
    """Which patterns (by place, from 0) changed a message, each judged on what the last one left; none for a null message."""
    hits = []
    for k, (kind, pattern, replacement) in enumerate(patterns):
        after = KINDS[kind](message, pattern, replacement)
        hits.append(F.when(after != message, F.lit(k)))
        message = after
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def fields_redacted(context: Column, fields: Mapping[str, str], ignore_case: bool = True) -> Column:
    """How many fields of a context are redacted by name."""
    names = [f.lower() if ignore_case else f for f in fields]
    listed = F.filter(F.map_keys(context), lambda k: (F.lower(k) if ignore_case else k).isin(names))
    return F.greatest(F.coalesce(F.size(listed), F.lit(0)), F.lit(0))
