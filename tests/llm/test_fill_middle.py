"""Operator 13 against a plain version in Python, and its equal in SQL."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import fill_middle
from tidelog.llm import queries as Q
from tidelog.llm._common import table
from tidelog.llm.fill_middle import fill_in_middle, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", "a b", " a ", "<P>", "a <S> b", "x<M", "<<P", "> <S", "a\x00b c", "é😀 漢字　x \x1c y", "a" * 50_000, "x y " * 40_000, "it's $1 \\1 'q'", "\x85 \xa0"]


def brute(doc_id, text, changed=50, spm=80, seed=42):
    t = text or ""
    units = UNIT.findall(t)
    assert "".join(units) == t
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= changed:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_fill_middle(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = Q.op13_fill_middle(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        *told, output = brute(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == told
        assert r.output_sha256 == sha(output) and r.restored_sha256 == sha(texts[r.doc_id])
    assert {"plain", "spm", "psm"} == {r.form for r in got}


def test_fill_middle_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf_dir) / 'documents.parquet'}'")
    found = con.execute(Q.OP13_SQL)
    names = [d[0] for d in found.description]
    df = Q.op13_fill_middle(spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("limit", [1, 300, 4_000_000])
def test_fill_middle_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", limit)
    rows = [(100 * k + j, t, "x", 1, "y", 2.0) for k, t in enumerate(ODD) for j in range(4)]
    rows += [(None, "a b c d", "x", 1, "y", 2.0)] * 2 + [(7, "same id", "x", 1, "y", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, output string, k0 double")
    got = fill_in_middle(df, keep=("doc_id", "k0", "form")).toDF("doc_id", "k0", "was", "n", "form", "prefix_chars", "middle_chars", "output")
    got = got.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    wanted = Counter((r[0], "x", 2.0, *brute(r[0], r[1]), r[1] or "") for r in rows)
    assert Counter((r.doc_id, r.was, r.k0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == wanted
    assert fill_in_middle(df.limit(0)).collect() == []


def test_shares_and_seeds(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("name"), F.concat(F.lit("a b c "), F.col("id")).alias("body"))
    got = fill_in_middle(df, 100, 25, 7, ["name"], "name", "body").collect()
    assert all(tuple(r)[1:] == brute(r.name, f"a b c {r.name}", 100, 25, 7) for r in got)
    forms = Counter(r.form for r in got)
    assert forms["plain"] == 0 and 400 < forms["spm"] < 600
    assert Counter(r.form for r in fill_in_middle(df, 0, 25, 7, ["name"], "name", "body").collect()) == {"plain": 2000}
