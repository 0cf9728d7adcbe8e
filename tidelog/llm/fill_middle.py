r"""Operator 13. Fill-in-middle transformation, by DuckDB inside Arrow batches.

Each task registers its batches with an in-memory DuckDB and gets Arrow back; a text is cut, joined and hashed in SQL, never row
by row in Python. A text is cut into units at a unit's border by two draws from the hash of its id, so a document is cut alike
in every run and partitioning, and written plainly, or as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).
``restore`` gives the text back from output and form.

Units: ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``, left to right over code points; they join to the whole text. Draws: the first four groups of 8 hex digits
of the sha256 of ``<seed>:<id>``.

A batch goes in in slices of about ``SLICE_BYTES`` of text, one text at least, so that what DuckDB holds is bounded but for a single long text, as
its output is one value. There is no shuffle, and a task that runs again writes the same.

Defined cases. A null text is empty. An empty text, or one that holds a mark, stays plain. A null id is hashed as if empty, and
rows of one id draw alike. One unit: one of the parts has it, the others are empty. An empty table gives an empty table.
Texts are taken whole, whatever their length. Extra columns are left out, whatever their names, but those asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.llm._common import release

#: The units of a text, and the marks before its parts.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of text that DuckDB gets at once.
SLICE_BYTES = 4_000_000

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def statement(changed_percent: int, spm_percent: int, seed: int, kept: int) -> str:
    """The SQL over a batch: columns k0 .. (kept), id and body."""
    keep = "".join(f"k{k}, " for k in range(kept))
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""WITH texts AS (SELECT {keep}coalesce(body, '') AS t, sha256('{seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch),
  cut AS (SELECT *, regexp_extract_all(t, '{UNITS}') AS u FROM texts),
  drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST({draw(0)} % (len(u) + 1) AS BIGINT) AS a, CAST({draw(1)} % (len(u) + 1) AS BIGINT) AS b,
    CASE WHEN t = '' OR {marked} OR {draw(2)} % 100 >= {changed_percent} THEN 'plain' WHEN {draw(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM cut),
  parted AS (SELECT *, array_to_string(list_slice(u, 1, least(a, b)), '') AS pre, array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS mid,
    array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS suf FROM drawn)
SELECT {keep}n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END AS output
FROM parted"""


def by_bytes(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each, one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    out, low = [], 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
        out.append((low, high))
        low = high
    return out


def fill_in_middle(docs: DataFrame, changed_percent: int = 50, spm_percent: int = 80, seed: int = 42, keep: Sequence[str] = ("doc_id",), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's columns ``keep``, and those of ``SCHEMA``: units, form, code points of prefix and middle, and the text as written.

    ``changed_percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first.
    """
    source = docs.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)], F.col(id_column).alias("id"), F.col(text).alias("body"))
    added = StructType.fromDDL(SCHEMA)
    out = StructType([*source.schema.fields[: len(keep)], *added.fields])  # names of kept columns may be any: they come back at last
    sql = statement(int(changed_percent), int(spm_percent), int(seed), len(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})
        try:
            for batch in batches:
                for low, high in by_bytes(batch.column("body"), SLICE_BYTES):
                    db.register("batch", pa.Table.from_batches([batch.slice(low, high - low)]))
                    made = db.sql(sql).to_arrow_table().cast(arrow)
                    db.unregister("batch")
                    yield from made.to_batches()
                    del made
                release()
        finally:
            db.close()
            release()

    return source.mapInArrow(run, out).toDF(*keep, *added.names)


def restore(output: Column, form: Column) -> Column:
    """The text from what was written and its form: each mark is there once, behind a part without marks."""
    head = lambda m: F.substring(F.substring_index(output, m, 1), len(PREFIX) + 1, 2**31 - 1)
    middle = F.substring_index(output, MIDDLE, -1)
    last = lambda m: F.substring_index(F.substring_index(output, MIDDLE, 1), m, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head(SUFFIX), middle, last(SUFFIX))).otherwise(F.concat(last(PREFIX), middle, head(PREFIX)))
