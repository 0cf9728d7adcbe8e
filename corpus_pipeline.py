"""A corpus pipeline of four stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. A stage works on all that its predecessor kept.

1. quality_classifier (operator 5): documents that it predicts to be of low quality go.
2. quality_rules (operator 2): documents that fail the base rule or a learned rule go.
3. near_dedup (operator 9): of each group of near-duplicates - five-word shingles, a similarity of 0.8 or more - the
   document of the least id stays. Rows of one id and text are one document.
4. packing (operator 8): what is left is cut and packed into sequences of 2048 tokens at most.

Defined cases. A null or empty text is a document without words: the classifier scores it like any other, the base rule
rejects it; near_dedup would keep it and packing would give it its end id. Null ids and null values in other columns go along.
Very long texts are read whole. Of rows that repeat, or tie in all that a stage looks at, the first two stages keep all or
none; near_dedup keeps one. Empty tables give empty tables. Extra columns, whatever their names, come through the first three
stages as they are. Labels that are null or of no document aren't used.

The classifier and the rules are fitted on labels of the documents that the stage is given, a bounded sample; their
decisions cover every document. SQL can't express the stages, so there is no ORACLE_SQL; the tests hold each stage against
a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm._common import shared_dir, table

#: Parameters of the near-duplicate stage.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80

#: The end-of-document id, and the tokens of a sequence.
END_ID, SEQUENCE_TOKENS = 0, 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality_classifier import fit_documents, score_documents

    model = fit_documents(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return score_documents(docs, model, [F.col(c).alias(f"in_{c}") for c in docs.columns]).where("predicted = 1").select([F.col(f"in_{c}").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality_rules import judge, learn_rules

    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules, [F.col(c).alias(f"in_{c}") for c in docs.columns]).where("kept").select([F.col(f"in_{c}").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tidelog.llm.near_dedup import drop_near_duplicates

    return drop_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelog.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
