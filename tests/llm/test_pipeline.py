"""The corpus pipeline: each stage against a brute-force version on its own input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_components, check_packing

import corpus_pipeline
from tidelog.llm._common import table


def test_stages(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    from tidelog.llm.quality_classifier import fit_documents, score_documents
    from tidelog.llm.quality_rules import judge, learn_rules

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "packing"]
    labels = table(spark, sf_dir, "labels")
    docs, kept = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept.append((docs, out := spark.read.parquet(f"{tmp_path}/{name}")))
        docs = out
    ids = [{r.doc_id for r in after.collect()} for _, after in kept]
    first = score_documents(kept[0][0], fit_documents(kept[0][0], labels, F.lit(True)), ["doc_id"]).collect()
    assert ids[0] == {r.doc_id for r in first if r.score >= 0.7}
    second = judge(kept[1][0], learn_rules(kept[1][0], labels), ["doc_id"]).collect()
    assert ids[1] == {r.doc_id for r in second if r.kept}
    third = brute_components([(r.doc_id, r.text) for r in kept[2][0].collect()], 5, 80)
    assert ids[2] == {i for i, _, c in third if i == c}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(ids[0] & good) > 0.95 * len({r.doc_id for r in kept[0][0].collect()} & good)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens, _ = check_packing(out.collect(), {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}, 2048)
    assert set(tokens) == set(texts)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_documents(spark, sf_dir):
    """Nulls, empty and very long texts, ties and repeated rows, each with its result; and an empty table."""
    good = [r for r in table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(3).collect()]
    long = "x " * 9000
    rows = [(None, None, "en", "s", 0), (-1, "", "en", "s", 0), (-2, long, None, None, None), (-2, long, None, None, None), (10**9, long, "en", "s", 1), *[tuple(r) for r in good], tuple(good[0])]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=lambda i: -9 if i is None else i)
    stages = dict(corpus_pipeline.STAGES)
    everything = {r[0] for r in rows}
    classified = stages["quality_classifier"](spark, docs, sf_dir)
    assert classified.columns == docs.columns and set(ids(classified)) <= everything
    ruled = ids(stages["quality_rules"](spark, docs, sf_dir))
    assert not {None, -1, -2, 10**9} & set(ruled) and set(ruled) <= {r.doc_id for r in good}  # without 50 words, or repeated throughout
    assert ids(stages["near_dedup"](spark, docs, sf_dir)) == sorted([None, -1, -2, *[r.doc_id for r in good]], key=lambda i: -9 if i is None else i)
    packed = stages["packing"](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == everything and all(0 < r.length <= 2048 for r in packed)
    assert sorted(r.length for r in packed if r.doc_id in (None, -1)) == [1, 1]  # an empty text is its end id alone
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_on_clashing_columns(spark, sf_dir):
    """Extra columns named as the stages name their own come through as they are."""
    docs = table(spark, sf_dir, "documents")
    extra = {c: F.col("doc_id") * 10 + k for k, c in enumerate(["score", "predicted", "kept", "label", "quality", "node", "token", "length", "in_text"])}
    clash = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, clash, sf_dir)
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id * 10 + k for r in rows for k, c in enumerate(extra)), name
    assert corpus_pipeline.packing(spark, clash, sf_dir).columns == corpus_pipeline.packing(spark, docs, sf_dir).columns
