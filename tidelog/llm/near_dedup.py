"""Operator 9. Near-duplicate groups of documents by SetSketch registers, banded, estimated by likelihood, then verified.

A document's set holds its distinct word shingles, as 64-bit hashes. Documents with equal sets are one *node* (its key is
a 128-bit digest of the set), so exact copies cost nothing further. Per node:

1. Registers. Register i keeps the least of the elements' exponential draws, on a scale of powers of ``BASE``, in a byte
   (``registers``): mergeable by maximum, equal in two sets about as often as the sets are similar.
2. Bands. ``rows`` registers make a band; nodes that agree on a band meet in a bucket. ``banding`` takes as many bands as
   leave a pair at the threshold unmet with a chance of ``MISS`` at most.
3. Estimates. A bucket is dealt into blocks, of ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles about, so that no
   task gets a whole large one, and each block is compared in itself.
   A pair goes on if sizes allow the threshold, if the joint likelihood of its registers is greatest at a similarity
   near it or above, and if this is the first band on which the two agree.
4. Verification. The nodes of such pairs are fetched from their texts, as full sets, and each block is verified:
   pairs by falling estimate, those already joined in the block left out. What leaves a block are stars of joined nodes,
   never all pairs.
5. Components of the verified links: groups join their least neighbours, and links within a group go, until none is left;
   written at each step.
6. Buckets of several blocks (``join_blocks``) are compared between blocks too, but only nodes of different groups: first one
   node a group, dealt anew as long as that joins at least half of the groups, then all pairs of blocks that hold
   different groups. A bucket whose nodes have become one group is done.

A bucket of near-copies of each other so costs its nodes times ``BLOCK``. Work grows with the square of a bucket only as far as
its nodes stay in different groups, at some nanoseconds a pair; no candidates are dropped.

Defined cases. Without words (or text) a document's set is empty; it is linked with nothing, not with its like. With
fewer words than a shingle has, the whole sequence is its one shingle. Rows of one doc_id are separate documents; a group's
id is the least doc_id in it (null ids are passed over; a group of nothing else has a null id, and none of its rows is
marked as kept). ``drop_near_duplicates`` keeps a row of each group, also of such a group.
Word hashes have 64 bits and shingles are told apart by their hashes. Very long texts have large sets, held whole; blocks of
them hold fewer. Ties don't matter: links are exact. Other columns of the input, whatever their names, are left out;
``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._common import claim, map_texts, materialize, release, sieve

#: Base of the registers' scale: with it a byte spans sets of 1 to some millions of elements.
BASE = 1.085
LOG_BASE = math.log(BASE)
#: Added to a register's exponent; only draws above e**3.6 (a chance of e**-36 with one element) are cut off.
SHIFT = 3.6 / LOG_BASE

#: Registers at most, chance to miss a pair at the threshold, standard errors below it that an estimate may lie.
MOST_REGISTERS, MISS, ERRORS = 128, 1e-4, 4.2

#: Nodes of a bucket, and shingles of these nodes, in one block. Two blocks at most are compared at once.
BLOCK, BLOCK_SHINGLES = 256, 4_000_000

#: Word hashes that a worker remembers at most.
MOST_WORDS = 300_000
#: Longer words, in bytes, are not remembered.
LONGEST_WORD = 128

_U = np.uint64
_MUL1, _MUL2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _MUL1
    x = (x ^ (x >> _U(27))) * _MUL2
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_WORD:
            if len(self) > MOST_WORDS:
                self.clear()
            self[word] = h
        return h


_word_hashes = _WordHashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes. A-Z are lower-cased; words part at \\x20\\x09-\\x0D."""
    if not text:
        return np.zeros(0, dtype=_U)
    found = text.encode("utf-8", "replace").lower().split()  # of bytes, lower() is about A-Z alone
    if not found:
        return np.zeros(0, dtype=_U)
    claim(_word_hashes)
    h = np.array(list(map(_word_hashes.__getitem__, found)), dtype=_U)
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, _U(width))
    for k in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows a band: the longest bands that miss a pair at the threshold with a chance of MISS at most."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
        if bands * rows <= MOST_REGISTERS:
            return bands, rows
    raise ValueError("the threshold is too low")


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The registers (uint8, one row a set) of non-empty sets."""
    out = np.empty((len(sets), m), dtype=np.uint8)
    seeds = mix(np.arange(1, m + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    low = 0
    while low < len(sets):
        high, held = low, 0
        while high < len(sets) and (high == low or held + len(sets[high]) < 60_000):
            held += len(sets[high])
            high += 1
        elements = np.concatenate(sets[low:high])
        starts = np.cumsum([0, *map(len, sets[low : high - 1])])
        least = np.empty((high - low, m), dtype=_U)
        for i in range(m):
            x = (elements ^ seeds[i]) * _MUL1
            x ^= x >> _U(29)
            x *= _MUL2
            least[:, i] = np.minimum.reduceat(x, starts)
        u = (least >> _U(11)).astype(np.float64) + 0.5
        draws = -np.log1p(-u * 2.0**-53)  # the least of exponential draws is the draw of the least hash
        out[low:high] = np.clip(np.floor(SHIFT - np.log(draws) / LOG_BASE), 0, 255)
        low = high
    return out


_GRID = np.linspace(0.4, 1.0, 61)


def _p(x: np.ndarray) -> np.ndarray:
    """The chance that one set's register exceeds the other's, from its share x of the union that only it has."""
    return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / LOG_BASE


def likeliest(equal: np.ndarray, above: np.ndarray, below: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The similarity at which the counts of equal, higher and lower registers are likeliest, given the sizes."""
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(u, v)
    j = np.minimum(_GRID[None, :], most)
    high, low = _p(u - v * j), _p(v - u * j)
    logs = above[:, None] * np.log(high) + below[:, None] * np.log(low) + equal[:, None] * np.log(np.maximum(1 - high - low, 1e-9))
    return j[np.arange(len(j)), logs.argmax(1)]


def likely_pairs(regs: np.ndarray, sizes: np.ndarray, side: np.ndarray, within: bool, band: int | None, bands: int, threshold: float, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places i, j, estimates) of a block pair that may reach the threshold and first agree on ``band`` (None: on any, or none).

    ``side``: which of the two blocks a node is in; ``within``: they are one and the same. Nodes of one ``label`` are no pairs.
    """
    m = regs.shape[1]
    floor = threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / m)
    a = np.arange(len(regs)) if within else np.flatnonzero(side == 0)
    b = a if within else np.flatnonzero(side == 1)
    ra, rb = regs[a], regs[b]
    if len(a) * len(b) <= 4096:
        equal = (ra[:, None, :] == rb[None, :, :]).sum(2)
    else:
        equal = np.zeros((len(a), len(b)), dtype=np.uint8)
        for r in range(m):
            equal += ra[:, r, None] == rb[None, :, r]
    na, nb = sizes[a].astype(float), sizes[b].astype(float)
    ok = (equal >= (floor - 0.02) * m) & (np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :]) - 1e-9)
    if label is not None:
        ok &= label[a][:, None] != label[b][None, :]
    if within:
        ok &= np.tri(len(a), k=-1, dtype=bool).T
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j, np.zeros(0)
    x, y = ra[i], rb[j]
    if band is not None:
        agree = (x == y).reshape(len(i), -1)[:, : bands * (m // bands)].reshape(len(i), bands, m // bands).all(2)
        first = agree.any(1) & (agree.argmax(1) == band)
        i, j, x, y = i[first], j[first], x[first], y[first]
        if not len(i):
            return i, j, np.zeros(0)
    estimate = likeliest((x == y).sum(1), (x > y).sum(1), (x < y).sum(1), na[i], nb[j])
    near = estimate >= floor
    return a[i[near]], b[j[near]], estimate[near]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _by_group(keys: list[str], columns: list[str], fn: Callable[[dict[str, list]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Run ``fn`` on each run of equal ``keys`` of a sorted partition; it gets lists by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in [*keys, *columns]}
        at: tuple | None = None
        for batch in batches:
            rows = batch.to_pydict()
            ids = list(zip(*(rows[k] for k in keys), strict=True))
            low = 0
            while low < len(ids):
                high = low
                while high < len(ids) and ids[high] == ids[low]:
                    high += 1
                if at is not None and ids[low] != at:
                    if (out := fn(held)) is not None:
                        yield out
                    held = {c: [] for c in held}
                at = ids[low]
                for c in held:
                    held[c] += rows[c][low:high]
                low = high
            del rows, ids
            release()
        if at is not None and (out := fn(held)) is not None:
            yield out

    return run


def sketch(docs: DataFrame, words: int, m: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, text_hash, node (null: empty set), n_shingles and registers, from one pass over the texts."""

    def make(texts: list[str | None]) -> dict[str, object]:
        sets = [shingle_set(t, words) for t in texts]
        full = [s for s in sets if len(s)]
        regs = iter(registers(full, m)) if full else iter(())
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return {"node": nodes, "n_shingles": [len(s) for s in sets], "registers": [next(regs).tobytes() if len(s) else None for s in sets]}

    return map_texts(docs, text, [F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash")], "node binary, n_shingles long, registers binary", make)


def banded(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(node, n_shingles, band, bucket): one row a node and band."""
    return nodes.select("node", "n_shingles", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 1 + b * rows, rows)) for b in range(bands)])).alias("band", "bucket"))


def _weight(n: str, shingles: str) -> Column:
    return F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)


def shared_buckets(members: DataFrame) -> DataFrame:
    """(bucket, blocks): the buckets with two nodes or more, and how many blocks each is dealt into."""
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    return counts.select("bucket", F.ceil(_weight("n", "shingles")).cast("int").alias("blocks"))


def in_shared(members: DataFrame, shared: DataFrame) -> DataFrame:
    """The ``members`` that are in one of the buckets ``shared``, and a few hundredths of the others: most nodes are alone in a bucket,
    and needn't be shuffled to find that out."""
    return sieve(members.withColumn("_hash", F.col("bucket")), shared.select(F.col("bucket").alias("_hash"))).where("_maybe").drop("_hash", "_maybe")


def candidate_blocks(nodes: DataFrame, bands: int, rows: int, threshold: float, shared: DataFrame | None = None) -> DataFrame:
    """The nodes that have a likely partner in their own block of a bucket; see ``active_nodes``. ``shared``: the buckets, if known."""
    members = banded(nodes, bands, rows)
    shared = shared_buckets(members) if shared is None else shared
    met = in_shared(members, shared).join(shared, "bucket").withColumn("i", F.pmod(F.xxhash64("node", "bucket"), "blocks"))
    return active_nodes(met.select("bucket", "i", F.col("i").alias("j"), "band", "node", F.lit(0).alias("side"), F.lit(None).cast("binary").alias("label")), nodes, bands, threshold)


_KEYS = ["bucket", "i", "j"]
_ACTIVE = {"bucket": pa.int64(), "i": pa.int64(), "j": pa.int64(), "band": pa.int32(), "node": pa.binary(), "side": pa.int32(), "label": pa.binary(), "n_shingles": pa.int64(), "registers": pa.binary()}


def _likely(group: dict[str, list], bands: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    regs = np.frombuffer(b"".join(group["registers"]), dtype=np.uint8).reshape(len(group["node"]), -1)
    codes = {x: k for k, x in enumerate(dict.fromkeys(group["label"]))}
    label = None if None in codes else np.array([codes[x] for x in group["label"]])
    return likely_pairs(regs, np.array(group["n_shingles"]), np.array(group["side"]), group["i"][0] == group["j"][0], group["band"][0], bands, threshold, label)


def active_nodes(paired: DataFrame, nodes: DataFrame, bands: int, threshold: float) -> DataFrame:
    """(bucket, i, j, band, node, side, label, n_shingles, registers): the rows of ``paired`` whose node has a likely partner in
    the block pair i, j of the bucket.

    ``paired``: bucket, i, j, band (null: agreement on a band isn't asked for), node, side (0: in block i, else in j), label (nodes
    of one label are no pairs; null: all differ); ``nodes``: node, n_shingles, registers, one row a node.
    """
    ready = paired.join(nodes, "node").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node")

    def active(group: dict[str, list]) -> pa.RecordBatch | None:
        if len(group["node"]) < 2:
            return None
        i, j, _ = _likely(group, bands, threshold)
        if not len(i):
            return None
        at = np.unique(np.concatenate([i, j])).tolist()
        return pa.RecordBatch.from_pydict({c: pa.array([group[c][k] for k in at], t) for c, t in _ACTIVE.items()})

    schema = "bucket long, i long, j long, band int, node binary, side int, label binary, n_shingles long, registers binary"
    return ready.mapInArrow(_by_group(_KEYS, [c for c in _ACTIVE if c not in _KEYS], active), schema)


def verified_links(blocks: DataFrame, sets: DataFrame, bands: int, percent: int) -> DataFrame:
    """(a, b): stars of nodes that are joined by verified links inside a block pair. ``sets``: node, shingles."""
    ready = blocks.join(sets, "node").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node")

    def verify(group: dict[str, list]) -> pa.RecordBatch | None:
        i, j, estimate = _likely(group, bands, percent / 100)
        shingles = [np.frombuffer(s, dtype=_U) for s in group["shingles"]]
        root = list(range(len(shingles)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in np.argsort(-estimate, kind="stable").tolist():
            a, b = find(int(i[k])), find(int(j[k]))
            if a != b and similar(shingles[i[k]], shingles[j[k]], percent):
                root[max(a, b)] = min(a, b)
        links = [(find(x), x) for x in range(len(root)) if find(x) != x]
        if not links:
            return None
        return pa.RecordBatch.from_pydict({"a": pa.array([group["node"][a] for a, _ in links], pa.binary()), "b": pa.array([group["node"][b] for _, b in links], pa.binary())})

    return ready.mapInArrow(_by_group(_KEYS, [*[c for c in _ACTIVE if c not in _KEYS], "shingles"], verify), "a binary, b binary")


def unlike_blocks(members: DataFrame) -> DataFrame:
    """``members`` (bucket, band, node, n_shingles, label) in the block pairs of each bucket that hold different labels; see ``active_nodes``.

    A label that fills half a block has blocks of its own; the others share some. Blocks of one label aren't compared to each other.
    """
    weights = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).select("bucket", "label", _weight("n", "shingles").alias("weight"))
    large = weights.where("weight > 0.5").select("bucket", F.col("label").alias("of"), F.ceil("weight").alias("blocks"))
    small = weights.where("weight <= 0.5").groupBy("bucket").agg(F.ceil(F.sum("weight")).alias("mixed"))
    lists = large.union(small.select("bucket", F.lit(None).cast("binary").alias("of"), F.col("mixed").alias("blocks")))
    blocks = lists.select("bucket", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")).withColumn("block", F.xxhash64("of", "k"))
    one, other = blocks.select("bucket", F.col("of").alias("of_i"), F.col("block").alias("i")), blocks.select("bucket", F.col("of").alias("of_j"), F.col("block").alias("j"))
    pairs = one.join(other, "bucket").where("i <= j AND (of_i IS NULL OR of_j IS NULL OR of_i <> of_j)")
    sides = pairs.select("bucket", F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))).alias("at"), "i", "j")
    sides = sides.select("bucket", "at.block", "at.side", "i", "j").where("side = 0 OR i <> j")
    placed = members.join(large.withColumnRenamed("of", "label"), ["bucket", "label"], "left").join(small, "bucket", "left")
    own = F.when(F.col("blocks").isNotNull(), F.xxhash64("label", F.pmod(F.xxhash64("node", "bucket"), "blocks")))
    mixed = F.xxhash64(F.lit(None).cast("binary"), F.pmod(F.xxhash64("label", "bucket"), "mixed"))
    placed = placed.select("bucket", "band", "node", "label", F.coalesce(own, mixed).alias("block"))
    return placed.join(sides, ["bucket", "block"]).select(*_KEYS, "band", "node", "side", "label")


def join_blocks(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, bands: int, percent: int) -> DataFrame:
    """``labels`` with what links between the blocks of ``members`` (bucket, band, node, n_shingles) join.

    Rounds compare one node of each group of a bucket, dealt anew into blocks, as long as a round leaves at most half of the groups. Then
    all nodes of different groups are compared, so no link between groups is missed. A bucket of one group takes no part.
    """

    def joined(labels: DataFrame, paired: DataFrame) -> DataFrame:
        found = materialize(active_nodes(paired, nodes, bands, percent / 100), "between")
        if found.isEmpty():
            return labels
        stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        return components(stars.union(verified_links(found, sets, bands, percent)))

    def unlike(labels: DataFrame) -> tuple[DataFrame, int]:
        named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        still = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        rows = materialize(named.join(still, "bucket"), "unlike")
        return rows, rows.select("bucket", "label").distinct().count()

    rows, groups = unlike(labels)
    turn = 0
    while groups:
        least = F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node")
        heads = materialize(rows.groupBy("bucket", "label").agg(least, F.max("n_shingles").alias("n_shingles")), "heads")
        dealt = heads.join(shared_buckets(heads), "bucket").withColumn("i", F.pmod(F.xxhash64("node", "bucket", F.lit(turn)), "blocks"))
        labels = joined(labels, dealt.select("bucket", "i", F.col("i").alias("j"), F.lit(None).cast("int").alias("band"), "node", F.lit(0).alias("side"), "label"))
        before = groups
        rows, groups = unlike(labels)
        turn += 1
        if 2 * groups > before:
            break
    return joined(labels, unlike_blocks(rows)) if groups else labels


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each end of ``links`` (a, b): nodes have equal labels if and only if links connect them.

    Each round every group of nodes joins the least group that a link leads to, and then the one that this has joined;
    links are carried over to the groups, and those within a group go. A group stays as it is only if all its neighbours are
    greater, and these join others, so the links run out, mostly within a few rounds. Each round is written, which cuts the
    lineage.
    """
    # both ways by explode: as a union, what is upstream would be computed twice
    both = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("ab")).select("ab.*").distinct()
    links = materialize(both, "links")
    labels = materialize(links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while not links.isEmpty():
        hooks = materialize(links.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("to")), "hooks")
        further = hooks.select(F.col("a").alias("to"), F.col("to").alias("top"))
        joined = materialize(hooks.join(further, "to").select(F.col("a").alias("group"), "top"), "joined")
        moved = labels.join(joined, F.col("label") == F.col("group"), "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = materialize(moved, "labels")
        left = links.join(joined, F.col("a") == F.col("group")).select(F.col("top").alias("a"), "b")
        right = left.join(joined, F.col("b") == F.col("group")).select("a", F.col("top").alias("b"))
        links = materialize(right.where("a <> b").distinct(), "links")
    return labels


def grouped(docs: DataFrame, words: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles and ``first``: (no_id, id, hash) of the group's first document, by id and then
    by text hash, documents without an id last."""
    bands, rows = banding(percent / 100)
    per_doc = materialize(sketch(docs, words, bands * rows, text, key), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    full = per_doc.where("node IS NOT NULL")
    nodes = materialize(full.groupBy("node").agg(F.min(own).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "nodes")
    plain = nodes.select("node", "n_shingles", "registers")
    members = banded(plain, bands, rows)
    shared = materialize(shared_buckets(members), "shared")
    blocks = materialize(candidate_blocks(plain, bands, rows, percent / 100, shared), "blocks")
    several = shared.where("blocks > 1").select("bucket")
    spread = None if several.isEmpty() else materialize(in_shared(members, several).join(several, "bucket"), "spread")
    asked = blocks.select("node") if spread is None else blocks.select("node").union(spread.select("node"))
    wanted = asked.distinct().join(nodes, "node").select("node", F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    wanted = materialize(wanted, "wanted")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).withColumn("_hash", F.xxhash64("id", "hash"))
    texts = sieve(texts, wanted.select(F.xxhash64("first_id", "first_hash").alias("_hash"))).where("_maybe")  # the other texts stay where they are
    chosen = texts.join(wanted, (F.col("hash") == F.col("first_hash")) & F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"])
    sets = materialize(map_texts(chosen, "text", ["node"], "shingles binary", lambda ts: {"shingles": [shingle_set(t, words).tobytes() for t in ts]}), "sets")
    labels = components(verified_links(blocks, sets, bands, percent))
    if spread is not None:
        hot = materialize(spread.select("node").distinct(), "hot")  # few of all nodes; the others' registers and sets stay
        hot_nodes, hot_sets = materialize(plain.join(hot, "node", "left_semi"), "hot-nodes"), materialize(sets.join(hot, "node", "left_semi"), "hot-sets")
        labels = join_blocks(spread, labels, hot_nodes, hot_sets, bands, percent)
    linked = nodes.join(labels, "node").select("node", "label", "first")
    least = linked.groupBy("label").agg(F.min("first").alias("group_first"))
    moved = linked.join(least, "label").select("node", "group_first")
    # written, so that the join below is one of two plain tables, which Spark can split at a node of very many copies
    firsts = materialize(nodes.join(moved, "node", "left").select("node", F.coalesce("group_first", "first").alias("first")), "firsts")
    some = full.select("doc_id", "text_hash", "n_shingles", "node").join(firsts, "node").select("doc_id", "text_hash", "n_shingles", "first")
    none = per_doc.where("node IS NULL").select("doc_id", "text_hash", "n_shingles", own.alias("first"))
    return some.union(none)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_shingles, component_id and kept (whether its id is the group's)."""
    kept = F.coalesce(F.col("doc_id") == F.col("first.id"), F.lit(False))
    return grouped(docs, words, percent, text, key).select(F.col("doc_id").alias(key), "n_shingles", F.col("first.id").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group its first document stays, as one row.

    Rows of one id and text are one document. Only texts that may have to go are shuffled, to find out exactly.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))
    rows = materialize(grouped(docs, words, percent, text, key).select("doc_id", "text_hash", stays.alias("stays")), "decisions")
    keys = rows.groupBy("doc_id", "text_hash").agg(F.min("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1")
    keys = materialize(keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), F.col("stays").alias("_stays")), "keys")
    hashed = docs.withColumns({"_text_hash": F.xxhash64(text), "_hash": F.xxhash64(F.col(key), F.xxhash64(text))})
    marked = sieve(hashed, keys.select(F.xxhash64("_id", "_text").alias("_hash")))
    kept = marked.where("NOT _maybe").select(docs.columns)
    same = (F.col("_text_hash") == F.col("_text")) & F.col(key).eqNullSafe(F.col("_id"))
    nth = F.row_number().over(Window.partitionBy("_text_hash", key).orderBy(*[c for c, kind in docs.dtypes if not kind.startswith("map")]))
    decided = marked.where("_maybe").join(keys, same, "left").withColumn("_nth", nth)
    return kept.union(decided.where("_stays IS NULL OR _stays AND _nth = 1").select(docs.columns))
