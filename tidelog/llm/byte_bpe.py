"""Operator 10. Byte-level BPE, encoding and decoding, with a segment tree over byte positions.

Each match of the splitting pattern is encoded by itself. The leaves of its tree are its byte positions; the leaf of a
live position holds the merge rank of the token that starts there with its live right neighbour (infinity: no merge),
and each inner node the least of its children, as (rank, position) in one integer. The root is so the leftmost pair of
the least rank. A merge sets three leaves - the merged position, its left neighbour, and the position that died - and
renews their ancestors: O(log n) work, so n bytes cost O(n log n) however long a match is.

The trees of many distinct matches are rows of one numpy matrix and merge in lock-step. Long matches, and few of a width,
merge one by one in a tree of 32-bit ranks, some ten microseconds and 25 to 50 bytes of memory for each of their bytes. A
worker keeps the ids of the strings it has met, within a bound.

Defined cases. A null text counts as empty: no ids; both digests are those of no bytes. Strings that look like special
tokens are ordinary text. Very long texts are encoded whole. Repeated rows give repeated results; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from tidelog.llm._common import claim, map_texts

#: White space as the splitting pattern's \s sees it: Unicode's White_Space property.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
MARKS = "!-/:-@\\[-`{-~"

#: A text falls into these units. The splitting pattern never matches across their borders: it crosses from white space
#: to other characters only after one leading space, and a run of Latin letters, ASCII digits or ASCII marks that an
#: ASCII character (or the end) follows is a whole match. Other units hold one match or more.
UNIT = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]++(?![^\\x00-\\x7f])| ?[{MARKS}]++(?![^\\x00-\\x7f])| ?[0-9]++(?![^\\x00-\\x7f])"
    f"| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)

#: Units that are one match for sure.
SIMPLE = re.compile(f" ?[{LETTERS}]+| ?[0-9]+| ?[!-&(-/:-@\\[-`{{-~]+")

#: Units that a worker remembers at most; then it starts anew.
MOST_KEPT = 500_000

#: Units of more characters are not remembered.
LONGEST_KEPT = 128

NONE = np.int64(1) << 62
NO_RANK = 2**32 - 1

#: From this width on, and below so many matches of a width, matches merge one by one.
WIDE, FEW = 4_096, 32


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank files: a line has a token's bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class SegmentTreeBpe:
    """Encode byte strings by merge ranks; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of joining two tokens, NONE where no token is their join."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_many(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit, one after the other) of each of ``pieces``, every one a match of the pattern."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            if width >= WIDE or len(members) < FEW and width > 16:
                for i in members:
                    out[i] = self._merge_one(pieces[i], width)
                continue
            step = max(1, (1 << 18) // width)
            for low in range(0, len(members), step):
                part = members[low : low + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        n, bits = len(pieces), width.bit_length()
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        place = np.arange(width)
        live = place < length[:, None]
        token = np.where(live, self.of_byte[raw], 0)
        after = np.broadcast_to(place + 1, (n, width)).copy()  # the live right neighbour; length: none
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        ranks = self.pair_rank(token[:, :-1], token[:, 1:])
        ranks[place[1:] >= length[:, None]] = NONE
        tree[:, width : 2 * width - 1] = np.where(ranks == NONE, NONE, ranks << bits | place[:-1])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            while node[0] > 1:  # all leaves have the same depth
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            right = after[rows, at]
            there = right < length[rows]
            rank = np.where(there, self.pair_rank(token[rows, at], token[rows, np.where(there, right, 0)]), NONE)
            return np.where(rank == NONE, NONE, rank << bits | at)

        while True:
            rows = np.flatnonzero(tree[:, 1] != NONE)
            if not len(rows):
                break
            least = tree[rows, 1]
            at = least & ((1 << bits) - 1)
            dead = after[rows, at]
            beyond = after[rows, dead]
            token[rows, at] = least >> bits
            live[rows, dead] = False
            after[rows, at] = beyond
            inner = beyond < length[rows]
            before[rows[inner], beyond[inner]] = at[inner]
            put(rows, dead, np.full(len(rows), NONE))
            put(rows, at, leaf(rows, at))
            left = before[rows, at]
            has = left >= 0
            if has.any():
                put(rows[has], left[has], leaf(rows[has], left[has]))
        ids = token[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_one(self, piece: bytes, width: int) -> bytes:
        """As ``_merge``, for one match: nodes hold the least rank alone, and the leftmost place of it is found from the root."""
        n, size, rank_of = len(piece), self.size, self.pairs.get
        bytes_ = self.of_byte[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pair_rank(bytes_[:-1], bytes_[1:])
        nodes = np.full(2 * width, NO_RANK, dtype=np.uint32)
        nodes[width : width + n - 1] = np.where(ranks == NONE, NO_RANK, ranks)
        level = width
        while level > 1:
            nodes[level // 2 : level] = np.minimum(nodes[level : 2 * level : 2], nodes[level + 1 : 2 * level : 2])
            level //= 2
        tree, token = array("I", nodes.tobytes()), array("i", bytes_.astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        while (rank := tree[1]) != NO_RANK:
            node = 1
            while node < width:
                node *= 2
                if tree[node] != rank:
                    node += 1
            at = node - width
            dead = after[at]
            beyond = after[dead]
            left = before[at]
            token[at], token[dead], after[at] = rank, -1, beyond
            tree[width + dead] = NO_RANK
            tree[node] = NO_RANK
            if beyond < n:
                before[beyond] = at
                tree[node] = rank_of(rank * size + token[beyond], NO_RANK)
            low, high = node, width + dead
            if left >= 0:
                low = width + left
                tree[low] = rank_of(token[left] * size + rank, NO_RANK)
            while low != high:  # the three leaves' ancestors, until they have one
                low, node, high = low // 2, node // 2, high // 2
                for own in (low, node, high):
                    a, b = tree[2 * own], tree[2 * own + 1]
                    tree[own] = a if a < b else b
            while low > 1:
                low //= 2
                a, b = tree[2 * low], tree[2 * low + 1]
                least = a if a < b else b
                if tree[low] == least:
                    break
                tree[low] = least
        ids = np.frombuffer(token, dtype=np.int32)
        return ids[ids >= 0].astype("<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def forget_and_list(kept: dict[str, bytes], units: Sequence[Sequence[str]]) -> list[str]:
    """The units that are not in ``kept``. Where they would overfill it, only what is met just now stays in it."""
    met = set(chain.from_iterable(units))
    missing = met.difference(kept)
    if len(kept) + len(missing) > MOST_KEPT:
        still = {u: kept[u] for u in met if u in kept}
        kept.clear()
        kept.update(still)
    return list(missing)


def forget_long(kept: dict[str, bytes], units: Sequence[str]) -> None:
    """Long units are rare: they don't stay."""
    for u in units:
        if len(u) > LONGEST_KEPT:
            del kept[u]


class TextEncoder:
    """Encode whole texts: the pattern's matches one by one, by way of the units that a worker remembers."""

    def __init__(self, bpe: SegmentTreeBpe, pattern: str):
        import regex

        self.bpe, self.split = bpe, regex.compile(pattern)
        self.kept: dict[str, bytes] = {}

    def learn(self, units: list[str]) -> None:
        whole = [bool(SIMPLE.fullmatch(u)) for u in units]
        matches = [[u.encode()] if w else [m.encode("utf-8", "replace") for m in self.split.findall(u)] for u, w in zip(units, whole, strict=True)]
        distinct = list({m for ms in matches for m in ms})
        ids = dict(zip(distinct, self.bpe.encode_many(distinct), strict=True))
        self.kept.update((u, ids[ms[0]] if len(ms) == 1 else b"".join(ids[m] for m in ms)) for u, ms in zip(units, matches, strict=True))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        claim(self.kept)
        units = [UNIT.findall(t) if t else [] for t in texts]
        self.learn(new := forget_and_list(self.kept, units))
        out = [np.frombuffer(b"".join(map(self.kept.__getitem__, us)), dtype=np.uint32) for us in units]
        forget_long(self.kept, new)
        return out


_encoders: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """This worker's encoder for a rank file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(SegmentTreeBpe(load_ranks(path)), pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key and ids (array<int>) of its whole text."""

    def ids(texts: list[str | None]) -> dict[str, object]:
        return {"ids": [x.astype(np.int32) for x in text_encoder(rank_path, pattern).encode(texts)]}

    return map_texts(docs, text, [key], "ids array<int>", ids)


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, and the SHA-256 of the ids in decimal, joined by commas, and of the bytes they decode to.

    One pass over the texts, no exchange; ids live only inside a task.
    """

    def digest(texts: list[str | None]) -> dict[str, object]:
        encoder = text_encoder(rank_path, pattern)
        decimal = _decimals(encoder.bpe.size)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in encoder.encode(texts):
            ids = ids.tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(encoder.bpe.decode(ids)).hexdigest())
        return out

    return map_texts(docs, text, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


_decimal_strings: list[str] = []


def _decimals(size: int) -> list[str]:
    if len(_decimal_strings) < size:
        _decimal_strings.extend(map(str, range(len(_decimal_strings), size)))
    return _decimal_strings
