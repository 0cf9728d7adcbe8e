"""Operator 1. Rendezvous hashing of record keys over weighted shards.

Each shard draws a number from the hash of (key, shard); the key goes to the shard with the smallest
``-ln(u) / weight``. A shard's draw doesn't depend on the other shards, so a further shard takes rows only into itself,
and of those about its share of the whole weight; a shard that leaves gives up only its own rows.

Defined cases. A null key is a key of its own: all its rows share a shard. Equal keys share a shard, whatever their
texts. A null text has 0 bytes and the checksum of no bytes (0). Equal draws (never seen; they need equal 52-bit hashes)
go to the lower shard. Weights must be positive. An empty table gives an empty table; other columns of the input are
left out, and may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import gapless_rank, materialize


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's bid for a key: exponential with the shard's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"shard {shard}"), key), 12)  # 52 bits: exact as a double
    return -F.log((bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int, from 0) of ``key`` among ``len(weights)`` weighted shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    bids = [F.struct(draw(key, s, w).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*bids))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot and, given ``grown_weights``, the shard among those.

    The texts are read once, for their size and checksum; what is written, counted and ranked are rows of a few numbers.
    ``slot`` numbers the rows of each shard from 0 without gaps (see ``gapless_rank``).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    grown = rendezvous(F.col(key), grown_weights) if grown_weights else F.lit(None).cast("int")
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        grown.alias("grown_shard"),
    )
    ranked = gapless_rank(materialize(narrow, "shards"), ["shard"], "slot")
    return ranked.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
