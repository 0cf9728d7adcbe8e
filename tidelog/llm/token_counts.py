"""Operator 4. Token counts without token ids: each distinct pre-token is counted once, documents sum over theirs.

The vocabulary is a BPE one of the sentencepiece library. Spaces become ``▁`` and one more stands before the text. No
piece has a ``▁`` after another character and none holds a line feed next to another character (``check_borders`` makes
sure of both when a model is loaded), so merges never cross from another character to a ``▁``, nor a line feed: a text's
tokens are those of its pre-tokens (a run of spaces with the characters after it; a line feed), one after the other.

1. Each task counts the pre-tokens of its texts; a shuffle sums these up to the corpus' distinct pre-tokens.
2. Each distinct pre-token is given to the library once. The table (pre-token, frequency, pieces) is written.
3. The ``head`` most frequent short pre-tokens - a fixed number, of bounded size - go to all tasks. A second pass sums
   them up per document by lookup and keeps the document's other pre-tokens, each with its frequency in the document.
   These rarer ones join the table by pre-token: none of them is frequent, so the join has no hot key.

Defined cases. A null or empty text has no tokens. Repeated rows and doc_ids are counted row by row. ``▁`` in a text is a
space to the library. Very long texts are counted whole. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import map_texts, materialize

PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")

#: Pre-tokens that go to all tasks: so many, of at most so many characters each; a few MB whatever the corpus.
HEAD, HEAD_CHARS = 150_000, 32

#: Distinct pre-tokens that a task gathers, and characters that it reads, before it sends the counts on.
MOST_GATHERED, MOST_READ = 300_000, 64_000_000


def pre_tokens(text: str | None) -> list[str]:
    """The pre-tokens of a text, spaces for ``▁``."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


class PieceCounter:
    """Pieces of a pre-token, by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check_borders()
        self.after_line = len(self.model.encode("\n"))

    def check_borders(self) -> None:
        m = self.model
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) and len(piece) > 1 and ("▁" in piece.lstrip("▁") or "\n" in piece):
                raise ValueError(f"piece {piece!r} crosses pre-tokens")
        if len(m.encode("a")) != 1 or m.encode("  a", out_type=str)[-1][-1] != "a" or len(m.encode("\n")) < 2:
            raise ValueError("a model with a dummy prefix and byte fallback is needed")

    def count(self, tokens: list[str]) -> list[int]:
        """The library puts a space before what it encodes. So a leading space is left to it; where there is none, a
        line feed goes first, and its pieces are taken off."""
        asked = [t[1:] if t[0] == " " else "\n" + t for t in tokens]
        counts = map(len, self.model.encode(asked, num_threads=1))
        return [1 if t in (" ", "\n") and self.after_line == 2 else n - (0 if t[0] == " " else self.after_line) for t, n in zip(tokens, counts, strict=True)]


_counters: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def distinct_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, freq) over the whole corpus; counted within tasks before the shuffle."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        read = 0

        def out() -> Iterator[pa.RecordBatch]:
            tokens = list(held)
            for low in range(0, len(tokens), 50_000):
                part = tokens[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[t] for t in part], pa.int64())], ["token", "freq"])
            held.clear()

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                for t in batch.column(0).slice(low, 512).to_pylist():
                    held.update(pre_tokens(t))
                    read += len(t or "")
                    if len(held) > MOST_GATHERED or read > MOST_READ:
                        yield from out()
                        read = 0
        yield from out()

    return docs.select(text).mapInArrow(gather, "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))


def count_pieces(tokens: DataFrame, model_path: str) -> DataFrame:
    """Add ``pieces`` to (token, freq): one call of the library for each distinct pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = piece_counter(model_path).count(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], ["token", "freq", "pieces"])

    return tokens.mapInArrow(count, "token string, freq long, pieces int")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, head: int = HEAD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    table = materialize(count_pieces(distinct_pre_tokens(docs, text), model_path), "pre-tokens")
    short = table.where(F.length("token") <= HEAD_CHARS).orderBy(F.desc("freq"), "token").limit(head)
    known = spark.sparkContext.broadcast({r.token: r.pieces for r in short.select("token", "pieces").toLocalIterator()})

    def split(texts: list[str | None]) -> dict[str, object]:
        n_bytes, sums, rest = [], [], []
        get = known.value.get
        for t in texts:
            found = Counter(pre_tokens(t))
            total, others = 0, []
            for token, n in found.items():
                pieces = get(token)
                if pieces is None:
                    others.append((token, n))
                else:
                    total += pieces * n
            n_bytes.append(len(t.encode()) if t else 0)
            sums.append(total)
            rest.append(others)
        return {"n_bytes": n_bytes, "head_tokens": sums, "rest": [[{"token": a, "n": b} for a, b in r] for r in rest]}

    per_doc = map_texts(docs, text, [key], "n_bytes long, head_tokens long, rest array<struct<token:string,n:long>>", split)
    placed = materialize(per_doc, "document-pre-tokens")
    placed = placed.withColumn("_row", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    rare = placed.select("_row", F.inline("rest"))
    summed = rare.join(table.select("token", "pieces"), "token").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rare_tokens"))
    n_tokens = F.col("head_tokens") + F.coalesce(F.col("rare_tokens"), F.lit(0))
    return placed.drop("rest").join(summed, "_row", "left").select(key, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
