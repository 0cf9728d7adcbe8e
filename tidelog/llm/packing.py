"""Operator 8. Best-fit packing of tokenized documents by a plan over the histogram of piece lengths.

A document becomes its ids and one end id. Documents longer than a sequence are cut into pieces of a whole sequence each;
what is left over comes first, as the document's first piece. Three passes follow:

1. Spark counts pieces by length: at most ``size`` numbers, whatever the corpus.
2. ``plan`` packs counts, longest length first, each into the fullest sequence that has room (best fit decreasing). It
   moves whole ranges of equal sequences at a time. Its rows say: of the pieces of this length, ranks lo to hi take the
   sequences from here on, so many in each, from this offset.
3. Each piece gets its gapless rank within its length and joins the plan's row for that rank.

Defined cases. A null or empty text is a document of the end id alone. A document of exactly a whole number of sequences
has no shorter first piece. Repeated rows (also of one doc_id) are packed as rows of their own. Equal lengths take slots
in the order of the written piece table. Special tokens' strings inside texts count as the tokenizer has them by default. Very long texts are encoded whole, and cut.
Other columns, whatever their names, are left out. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import claim, gapless_rank, map_texts, materialize
from tidelog.llm.byte_bpe import SPACES, UNIT, forget_and_list, forget_long

#: Units that no match crosses where one of them follows another; so many are encoded as one text.
SPACED = re.compile(f" [^{SPACES}]+")
RUN_UNITS = 2_000

PLAN_SCHEMA = "length long, lo long, hi long, first_sequence long, in_each long, offset long"


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over ``counts`` (length to number of pieces).

    Rows (length, lo, hi, first_sequence, in_each, offset): the pieces of ranks lo <= r < hi go to sequence
    ``first_sequence + (r - lo) // in_each`` at ``offset + (r - lo) % in_each * length``.

    Sequences with equal room are held as ranges of numbers. A step either uses up a length or fills up a range, and only
    the former splits one, so there are at most ``size`` splits and the rows are bounded by ``size``, not by the corpus.
    """
    rooms: list[int] = []  # sorted; the keys of ``ranges``
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room to (first sequence, how many)
    rows, used = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not ranges[room]:
                bisect.insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):  # open sequences, each filled as far as it goes before the next
                each = size // length
                whole, rest = divmod(left, each)
                if whole:
                    rows.append((length, rank, rank + whole * each, used, each, 0))
                    leave(size - each * length, used, whole)
                if rest:
                    rows.append((length, rank + whole * each, rank + left, used + whole, each, 0))
                    leave(size - rest * length, used + whole, 1)
                used += whole + bool(rest)
                break
            room = rooms[at]
            first, n = ranges[room].pop()
            if not ranges[room]:
                rooms.pop(at)
            each = room // length  # best fit stays with a sequence: after a piece it is the fullest that has room
            whole, rest = divmod(min(left, n * each), each)
            if whole:
                rows.append((length, rank, rank + whole * each, first, each, size - room))
                leave(room - each * length, first, whole)
            if rest:
                rows.append((length, rank + whole * each, rank + whole * each + rest, first + whole, each, size - room))
                leave(room - rest * length, first + whole, 1)
            leave(room, first + whole + bool(rest), n - whole - bool(rest))
            rank += whole * each + rest
            left -= whole * each + rest
    return rows


class UnitTokenizer:
    """Ids of texts by the tokenizers library, asked once for each distinct unit of text that a worker meets."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {s: np.array([i], dtype="<u4").tobytes() for s, i in special.items()}
        self.part = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.kept: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str]:
        if self.part is None or not self.part.search(text):
            return UNIT.findall(text)
        units: list[str] = []
        for part in self.part.split(text):
            units += [part] if part in self.special else UNIT.findall(part)
        return units

    def _ids_of_each(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _ids_of_run(self, units: list[str]) -> list[bytes]:
        """The ids of units like ``SPACED``: encoded as one text, and parted again by the bytes that tokens stand for."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, dtype="<u4")
        token_ends, unit_ends = np.cumsum(self.token_bytes[ids]), np.cumsum([len(u.encode()) for u in units])
        at = np.searchsorted(token_ends, unit_ends)
        if not np.array_equal(token_ends[np.minimum(at, len(ids) - 1)], unit_ends):  # not so with a byte-level vocabulary
            return self._ids_of_each(units)
        raw, borders = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
        return [raw[a:b] for a, b in zip(borders, borders[1:], strict=False)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        units = [self._units(t) if t else [] for t in texts]
        new = forget_and_list(self.kept, units)
        run = [u for u in new if SPACED.fullmatch(u)]
        for low in range(0, len(run), RUN_UNITS):
            part = run[low : low + RUN_UNITS]
            self.kept.update(zip(part, self._ids_of_run(part), strict=True))
        single = [u for u in new if u not in self.kept]
        for low in range(0, len(single), 5_000):
            part = single[low : low + 5_000]
            self.kept.update(zip(part, self._ids_of_each(part), strict=True))
        out = [b"".join(map(self.kept.__getitem__, us)) for us in units]
        forget_long(self.kept, new)
        return out


_tokenizers: dict[str, UnitTokenizer] = {}


def unit_tokenizer(path: str) -> UnitTokenizer:
    """This worker's tokenizer for a file; it goes, with all it remembers, when another operator claims the memory."""
    claim(_tokenizers)
    if path not in _tokenizers:
        _tokenizers[path] = UnitTokenizer(path)
    return _tokenizers[path]


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 (and ids, if asked for), from one pass over the texts."""
    end = int(end_id).to_bytes(4, "little")
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def pieces(texts: list[str | None]) -> dict[str, object]:
        made = []
        for ids in unit_tokenizer(tokenizer_path).encode(texts):
            ids += end
            n = len(ids) // 4
            borders = [0, *range(n % size or size, n + 1, size)]
            made.append(
                [
                    {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(part := ids[4 * a : 4 * b])} | ({"ids": part} if with_ids else {})
                    for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False))
                ]
            )
        return {"pieces": made}

    cut_up = map_texts(docs, text, [key], f"pieces array<struct<{fields.replace(' ', ':')}>>".replace(",:", ","), pieces)
    return cut_up.select(key, F.inline("pieces"))


def pack(pieces: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Give each row of ``pieces`` (with a ``length`` from 1 to ``size``) its sequence_id and offset."""
    spark = pieces.sparkSession
    written = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    slots = spark.createDataFrame(plan(counts, size), PLAN_SCHEMA)
    ranked = gapless_rank(written, ["length"], "_rank").alias("p")
    within = (F.col("p.length") == F.col("s.length")) & (F.col("p._rank") >= F.col("s.lo")) & (F.col("p._rank") < F.col("s.hi"))
    placed = ranked.join(F.broadcast(slots).alias("s"), within)  # the plan is bounded by ``size``
    nth = F.col("p._rank") - F.col("s.lo")
    return placed.select(
        *[f"p.{c}" for c in pieces.columns],
        (F.col("s.first_sequence") + F.floor(nth / F.col("s.in_each"))).cast("long").alias("sequence_id"),
        (F.col("s.offset") + nth % F.col("s.in_each") * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Cut and pack all of ``docs``. Columns: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(cut(docs, tokenizer_path, end_id, size, text, key, with_ids), size, key)
