"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm._common import table

SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality_rules import judge, learn_rules

    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, learn_rules(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tidelog.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidelog.llm.quality_classifier import fit_documents, id_remainder, score_documents

    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = fit_documents(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_documents(docs, model, ["doc_id", held_out.alias("held_out")]).select("doc_id", "held_out", "score", "predicted")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidelog.llm.quality_classifier import id_remainder
    from tidelog.llm.toxicity import fit_documents, score_documents

    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = fit_documents(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_documents(docs, model, ["doc_id", held_out.alias("held_out")]).select("doc_id", "held_out", "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tidelog.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tidelog.llm.byte_bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidelog.llm.chat_format import digests, format_conversations

    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"))
    return digests(format_conversations(turns.union(more)))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidelog.llm.fill_middle import fill_in_middle, restore

    made = fill_in_middle(table(spark, sf_dir, "documents"), changed_percent=50, spm_percent=80, seed=42)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Near-duplicates by all pairs that share a shingle; equal sets are one node.
OP9_SQL = r"""WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM words),
  nodes AS (SELECT min(doc_id) AS id, s FROM sets WHERE len(s) > 0 GROUP BY s),
  shingles AS (SELECT id, len(s) AS n, unnest(s) AS g FROM nodes),
  links AS (SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reached AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, ways.b FROM reached r JOIN ways ON ways.a = r.other),
  least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
  SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least.component_id, sets.doc_id) AS component_id, coalesce(least.component_id, sets.doc_id) = sets.doc_id AS kept
  FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN least ON least.id = nodes.id"""


#: Turns are what the table says; the formatted length counts each turn's marks, and the escapes of a text.
OP12_SQL = r"""WITH talks AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
  sized AS (SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE length(role) + 1 END + 4 + 2 + 8 + length(replace(replace(replace(replace(text, '\', '\e'), '### ', '\A'), ': ', '\B'), '</turn>', '\C')) AS chars,
    coalesce(role, '') || chr(10) || text || chr(10) AS told, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was FROM talks),
  walked AS (SELECT *, coalesce(CASE role WHEN 'system' THEN was IS NULL AND place = 1 WHEN 'user' THEN was IS NULL OR was IN ('system', 'assistant') WHEN 'assistant' THEN was = 'user' END, false) AS taken FROM sized)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(told, '' ORDER BY place)) AS turns_sha256, CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY place)) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(taken) AND arg_max(role, place) <> 'system' AS valid,
    CAST(coalesce(min(CASE WHEN NOT taken THEN place - 1 END), CASE WHEN arg_max(role, place) = 'system' THEN count(*) END) AS INTEGER) AS bad_turn
  FROM walked GROUP BY conv_id"""

#: Parts by their lengths in code points, not by lists of units.
OP13_SQL = r"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
  cut AS (SELECT *, list_transform(regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS u, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM texts),
  drawn AS (SELECT *, len(u) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
  placed AS (SELECT *, coalesce(list_sum(u[1:CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT)]), 0) AS p, coalesce(list_sum(u[1:CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT)]), 0) AS q FROM drawn),
  parted AS (SELECT *, substring(t, 1, CAST(p AS BIGINT)) AS pre, substring(t, CAST(p + 1 AS BIGINT), CAST(q - p AS BIGINT)) AS mid, substring(t, CAST(q + 1 AS BIGINT)) AS suf FROM placed)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM parted"""


def oracle_sql() -> dict[str, str]:
    """The others can't be put into SQL that DuckDB runs over whole tables in fair time; tests hold each against a brute-force version."""
    return {"op9_near_dedup": OP9_SQL, "op12_chat_format": OP12_SQL, "op13_fill_middle": OP13_SQL}
