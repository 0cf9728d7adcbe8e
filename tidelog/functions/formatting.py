"""Text, JSON and syslog lines as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.levels import display_color, display_name

ESC = "\x1b"
DEFAULT_TIME = "YYYY-MM-DD HH:mm:ss.SSS"

#: Date pattern tokens, longest first, and the formats of Spark.
TOKENS = [("YYYY", "yyyy"), ("SSS", "SSS"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("hh", "hh"), ("mm", "mm"), ("ss", "ss"), ("M", "M"), ("D", "d"), ("H", "H"), ("s", "s")]

#: Facility numbers of syslog.
FACILITIES = {
    "kern": 0, "user": 1, "mail": 2, "daemon": 3, "auth": 4, "syslog": 5, "lpr": 6, "news": 7, "uucp": 8, "cron": 9, "authpriv": 10, "ftp": 11,
    "local0": 16, "local1": 17, "local2": 18, "local3": 19, "local4": 20, "local5": 21, "local6": 22, "local7": 23,
}
#: Severity of each level in syslog, and in the operating system's own log.
SEVERITY = {"TRACE": 7, "DEBUG": 7, "INFO": 6, "SUCCESS": 6, "NOTICE": 5, "WARNING": 4, "ERROR": 3, "FAIL": 3, "CRITICAL": 2, "FATAL": 0}
EVENT_TYPE = {"ERROR": "ERR", "FAIL": "ERR", "CRITICAL": "ERR", "FATAL": "ERR", "WARNING": "WARNING"}


def java_pattern(pattern: str) -> str:
    """A ``date_format`` pattern; characters that are no token stand for themselves."""
    out, literal, k = [], "", 0

    def close() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    while k < len(pattern):
        for token, java in TOKENS:
            if pattern.startswith(token, k):
                close()
                out.append(java)
                k += len(token)
                break
        else:
            literal += pattern[k]
            k += 1
    close()
    return "".join(out)


def date_pattern(ts: Column, pattern: str) -> Column:
    """A time in a pattern of YYYY YY MM M DD D HH H hh mm ss s SSS and literal characters."""
    return F.date_format(ts, java_pattern(pattern))


def time_text(ts: Column, ts_ms: Column, fmt: str = DEFAULT_TIME) -> Column:
    """``unix`` (s), ``unix_ms``, ``ISO8601``, ``RFC3339`` or a date pattern. UTC."""
    if fmt == "unix":
        return F.floor(ts_ms / 1000).cast("string")
    if fmt == "unix_ms":
        return ts_ms.cast("string")
    if fmt == "ISO8601":
        return F.concat(date_pattern(ts, "YYYY-MM-DD"), F.lit("T"), date_pattern(ts, "HH:mm:ss.SSS"), F.lit("Z"))
    if fmt == "RFC3339":
        return F.concat(date_pattern(ts, "YYYY-MM-DD"), F.lit("T"), date_pattern(ts, "HH:mm:ss"), F.lit("+00:00"))
    return date_pattern(ts, fmt)


def _column(name: str, columns: list[str]) -> Column:
    return F.col(name) if name in columns else F.lit(None).cast("string")


def _time(columns: list[str], fmt: str) -> Column:
    """The record's time; null for rows without one."""
    return time_text(F.col("ts"), F.col("ts_ms"), fmt) if "ts" in columns and "ts_ms" in columns else F.lit(None).cast("string")


def level_name(columns: list[str]) -> Column:
    return display_name(_column("custom_level_name", columns), F.col("level"))


def template(fmt: str, columns: list[str], time_format: str = DEFAULT_TIME) -> Column:
    """``{time} {level} {message} {module} {function} {file} {line} {thread}``; unknown tags stay, nulls are empty, an
    unclosed brace is a literal."""
    tags = {
        "time": lambda: _time(columns, time_format),
        "level": lambda: level_name(columns),
        "message": lambda: F.col("message"),
        "module": lambda: _column("module", columns),
        "function": lambda: _column("function", columns),
        "file": lambda: _column("filename", columns),
        "line": lambda: _column("line", columns).cast("string"),
        "thread": lambda: _column("thread_id", columns).cast("string"),
    }
    parts: list[Column] = []
    rest = fmt
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        tag, closed, left = after.partition("}")
        if not closed:
            parts.append(F.lit("{" + after))
            break
        parts.append(F.coalesce(tags[tag](), F.lit("")) if tag in tags else F.lit("{" + tag + "}"))
        rest = left
    return F.concat(*parts) if parts else F.lit("")


def default_line(columns: list[str], time_format: str = DEFAULT_TIME, show: tuple[str, ...] = ("time", "module")) -> Column:
    """``[time] [LEVEL] [module] [function] [TID:n] file:line:0: message``; ``show``: time, module, function, thread, file, line."""
    boxed = lambda on, value, lead="": F.when(F.lit(on) & value.isNotNull(), F.concat(F.lit("[" + lead), value, F.lit("] "))).otherwise(F.lit(""))
    file, line = _column("filename", columns), _column("line", columns).cast("string")
    place = F.when(F.lit("line" in show) & line.isNotNull(), F.concat(F.lit(":"), line, F.lit(":0:"))).otherwise(F.lit(":0:0:"))
    stack = F.lit("")
    if "stack_trace" in columns:
        stack = F.when(F.col("stack_trace").isNotNull(), F.concat(F.lit("\nStack Trace:\n"), F.array_join(F.transform("stack_trace", lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), ""))).otherwise(F.lit(""))
    return F.concat(
        boxed("time" in show, _time(columns, time_format)),
        boxed(True, level_name(columns)),
        boxed("module" in show, _column("module", columns)),
        boxed("function" in show, _column("function", columns)),
        boxed("thread" in show, _column("thread_id", columns).cast("string"), "TID:"),
        F.when(F.lit("file" in show) & file.isNotNull(), F.concat(file, place, F.lit(" "))).otherwise(F.lit("")),
        F.coalesce("message", F.lit("")),
        stack,
    )


def colored(line: Column, color: Column) -> Column:
    """A whole line in an ANSI colour."""
    return F.concat(F.lit(ESC + "["), color, F.lit("m"), line, F.lit(ESC + "[0m"))


def line_color(columns: list[str], theme: dict[str, str] | None = None) -> Column:
    """A custom colour, else the theme's, else the level's."""
    standard = display_color(_column("custom_level_color", columns), F.col("level"))
    if not theme:
        return standard
    own = F.create_map(*[F.lit(x) for pair in theme.items() for x in pair])
    return F.coalesce(_column("custom_level_color", columns), F.try_element_at(own, F.col("level")), standard)


def json_line(columns: list[str], time_format: str = DEFAULT_TIME, hostname: str | None = None, pid: int | None = None, pretty: bool = False) -> Column:
    """timestamp, level, message, module, function, filename, line, hostname, pid, stack_trace, context, rules; without nulls.

    ``unix`` is seconds here as in text lines; trace ids, durations and errors are not part of the line.
    """
    when = F.floor(F.col("ts_ms") / 1000).cast("long") if time_format == "unix" and "ts_ms" in columns else _time(columns, time_format)
    fields = [when.alias("timestamp"), level_name(columns).alias("level"), F.col("message")]
    fields += [F.col(n) for n in ("module", "function", "filename", "line") if n in columns]
    fields += [F.lit(hostname).alias("hostname")] if hostname else []
    fields += [F.lit(pid).alias("pid")] if pid is not None else []
    fields += [F.col(n) for n in ("stack_trace", "context") if n in columns]
    if "rule_messages" in columns:
        fields.append(F.transform("rule_messages", lambda m: F.struct(m["category"].alias("category"), m["title"].alias("title"), m["message"].alias("message"), m["url"].alias("url"))).alias("rules"))
    return F.to_json(F.struct(*fields), {"pretty": "true"}) if pretty else F.to_json(F.struct(*fields))


def severity(level: Column) -> Column:
    out = None
    for name, n in SEVERITY.items():
        out = F.when(level == name, F.lit(n)) if out is None else out.when(level == name, F.lit(n))
    return out


def event_type(level: Column) -> Column:
    """The coarser mapping of the operating system's log: ERR, WARNING or INFO."""
    out = None
    for name, kind in EVENT_TYPE.items():
        out = F.when(level == name, F.lit(kind)) if out is None else out.when(level == name, F.lit(kind))
    return out.otherwise(F.lit("INFO"))


def syslog_line(facility: str, hostname: str, app: str) -> Column:
    """``<facility * 8 + severity>1 seconds host app - - - message``, at the record's own time."""
    pri = (severity(F.col("level")) + F.lit(FACILITIES[facility] * 8)).cast("string")
    return F.concat(F.lit("<"), pri, F.lit(">1 "), F.floor(F.col("ts_ms") / 1000).cast("string"), F.lit(f" {hostname} {app} - - - "), F.coalesce("message", F.lit("")))
