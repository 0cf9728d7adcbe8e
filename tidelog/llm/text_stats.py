"""Statistics of whole texts that the quality operators share.

Words are runs of characters other than ``\\x20\\x09-\\x0D``; lines are parted at ``\\n``. A null text has none of either.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tidelog.llm._common import claim

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

NAMES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_lower",
    "n_digits",
    "n_bangs",
    "n_stops",
    "n_wide",
]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)

_BYTE = np.arange(256)
_STARTS = (_BYTE < 128) | (_BYTE >= 192)  # bytes that begin a code point
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
#: Rows: which bytes count towards word_chars, n_symbols, n_upper, n_lower, n_digits, n_bangs, n_stops and n_wide.
_COUNTED = np.array(
    [
        _STARTS & ~_SPACE,
        np.isin(_BYTE, list(SYMBOLS.encode())),
        (_BYTE >= 65) & (_BYTE <= 90),
        (_BYTE >= 97) & (_BYTE <= 122),
        (_BYTE >= 48) & (_BYTE <= 57),
        _BYTE == 33,
        np.isin(_BYTE, list(b".,;:?")),
        _BYTE >= 192,
    ]
).astype(np.int64)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more, every occurrence counted, the first too."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # else the products stay below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = again.copy()
    covered[1:] |= again[:-1]
    covered[2:] |= again[:-2]
    return int(covered.sum())


#: Nothing is remembered here; to claim it ends what other operators remember in this worker.
_nothing: dict = {}


def text_statistics(texts: Sequence[str | None]) -> dict[str, np.ndarray]:
    """The statistics in ``NAMES`` of each text, as int64 arrays."""
    claim(_nothing)
    out = np.zeros((len(texts), len(NAMES)), dtype=np.int64)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        known: dict[bytes, int] = {}
        number = known.setdefault
        ids = np.fromiter((number(w, len(known)) for w in words), dtype=np.int64, count=len(words))
        lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
        chars = _COUNTED @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        row[:] = (len(words), *chars[:2], len(lines) - len(set(lines)), repeated_words(ids, len(known)), len(lines), len(known), *chars[2:])
    return {n: out[:, i] for i, n in enumerate(NAMES)}
