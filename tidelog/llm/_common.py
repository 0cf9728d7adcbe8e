"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that part words: space, \t, \n, \v, \f and \r. ``bytes.split()`` parts at exactly these.
WORD_SPACES = " \t\n\x0b\x0c\r"

#: Texts are handed to Python helpers in slices of about this many characters, so that a batch of long texts
#: never becomes Python objects all at once.
SLICE_CHARS = 1_000_000

#: Rows of a written table that are ranked together; see ``gapless_rank``.
BLOCK_ROWS_LOG2 = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, through Spark's reader so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be a folder of one machine,
    so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidelog-')}")
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that ``materialize`` writes inside: ``with scratch(spark): op(..).write.parquet(out)``.

    What an operator returns reads such tables, so it must have been written by then. Without this they stay.
    """
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs no upstream work, and rows keep their file and place.
    """
    path = f"{shared_dir(df.sparkSession)}/tidelog-{label}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gapless_rank(written: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Number the rows of each ``keys`` group from 0 without gaps, in column ``out`` (long).

    ``written`` must come straight from ``materialize``: a row's file and place there identify it, so that the order
    is stable when tasks run again. Rows are ranked inside blocks of at most 2**14 places of one file, and a prefix sum
    over the blocks' counts gives each block its start: a group of any size is never in one task.
    """
    placed = written.withColumns(
        {
            "_place": F.col("_metadata.row_index"),
            "_block": F.xxhash64(F.col("_metadata.file_path"), F.shiftright(F.col("_metadata.row_index"), BLOCK_ROWS_LOG2)),
        }
    )
    group = [*keys, "_block"]
    counts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(*group, (F.sum("_n").over(running) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_place")).cast("long") - 1
    return placed.withColumn("_inside", inside).join(starts, group).withColumn(out, F.col("_start") + F.col("_inside")).drop("_place", "_block", "_inside", "_start")


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of ``texts`` of about ``limit`` characters each, one text at least."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        if held and held + len(t or "") > limit:
            yield i, j
            i, held = j, 0
        held += len(t or "")
    if len(texts) > i:
        yield i, len(texts)


def map_texts(df: DataFrame, text_col: str, keep: Sequence[Column | str], schema: str, fn: Callable[[list[str | None]], dict[str, object]]) -> DataFrame:
    """Add what ``fn`` makes of each text.

    ``fn`` gets a list of texts (None: null) and returns a column (array or list) of the same length for each further
    name in ``schema`` (a DDL string of these). The rows keep the columns ``keep``; the text itself isn't sent back.
    """
    from pyspark.sql.types import StructType

    source = df.select(*keep, F.col(text_col).alias("_text"))
    added = StructType.fromDDL(schema)
    out = StructType([*source.drop("_text").schema.fields, *added.fields])
    kept, names = source.columns[:-1], added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            column = batch.column(len(kept))
            step = 512  # rows that become Python strings at once
            for low in range(0, batch.num_rows, step):
                texts = column.slice(low, step).to_pylist()
                for i, j in slices(texts):
                    made = fn(texts[i:j])
                    arrays = [batch.column(k).slice(low + i, j - i).cast(arrow.field(k).type) for k in range(len(kept))]
                    arrays += [pa.array(made[n], type=arrow.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            del batch, column
            release()

    return source.mapInArrow(run, out)


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give back what a task has freed. A worker serves many tasks, and its allocators would keep the most that any needed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):  # not every C library has it
        _libc.malloc_trim(0)


#: The least and the most bits of a sieve, as powers of two; between them it has 16 to 32 bits for each hash. 2**27 bits are
#: two million rows of two numbers.
SIEVE_BITS_LOG2 = (20, 27)


def sieve(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Add ``_maybe`` to ``rows``: false where the row's ``_hash`` is surely none of ``hashes`` (a column ``_hash`` too).

    A bit set built by Spark (``bit_or`` by word) and joined by broadcast. Its size follows the number of hashes, so that a
    few hundredths of the other rows pass, up to a bound; beyond some ten million hashes more do. Rows that pass need an exact
    join, so results stay the same; the others needn't be shuffled for it.
    """
    low, high = SIEVE_BITS_LOG2
    bits = min(high, max(low, 4 + hashes.count().bit_length()))
    bit = F.pmod(F.col("_hash"), F.lit(1 << bits))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = hashes.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    marked = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))).drop("_word", "_bits")


_claimed: list[dict] = []


def claim(memory: dict) -> None:
    """Say that a worker's task is about to use ``memory``, what an operator remembers between tasks. A worker serves the
    stages of many operators; only the last one's memory stays."""
    if not any(m is memory for m in _claimed):
        for other in _claimed:
            other.clear()
        _claimed[:] = [memory]


def bounded_sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``labels``, those of the smallest hashes of doc_id: the same rows at every run."""
    return labels.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(limit)
