"""Operator 7. Toxicity with noisy-channel deobfuscation.

1. ``letter_counts`` counts letter trigrams over all documents: a character language model of fixed size, whatever the
   corpus. Contexts are letters a-z, a word's edge, and one class for all other letters.
2. ``Decoder`` restores tokens. A token is a lattice: each character stands for itself, for the letters that it looks
   like (leetspeak), or for nothing (a separator, a repetition); runs of three or more one-character tokens are one
   lattice whose spaces may vanish. Viterbi finds the cheapest reading under channel costs and language model. Words of
   letters alone, no two equal ones in a row, have one path and skip the search, and so do tokens without letters that hold
   less than two look-alikes; a worker remembers tokens, so each costs one search.
3. A logistic model over marks of the restored text - words, and beginnings that several of its words share - is fitted
   on a bounded sample of labelled documents, over the marks that tell toxic documents best. Its words also enter the
   language model, which then decodes the whole corpus.

Two passes over the texts besides the sample; exchanged are only the trigram counts and the sample's word counts.

Defined cases. A null or empty text has no words and gets the score of the intercept. Null labels and labels of no
document are not used; if the sample lacks a class, every score is the smoothed share of label 1 (1/2 without any label).
Repeated rows get repeated scores. Very long texts are read whole: a token costs some 20 microseconds a character that the
search reads, so one token of mixed characters of 20 MB takes minutes. Equal Viterbi costs go to the first reading in the order of the options. Labels,
language, source and id are never inputs of a score. Other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import claim, map_texts, slices
from tidelog.llm.quality_classifier import labelled_sample

#: Labels that the model is fitted on at most (twice as many documents, as a doc_id may have several rows), and the words
#: and stems that it may use.
SAMPLE_ROWS, MOST_MARKERS = 20_000, 300

#: Word beginnings of these lengths count as well, by how many of a text's words share one: this often or oftener.
STEMS, OFTEN = (4, 5, 6), (1, 2, 3)

#: Tokens that a worker remembers at most.
MOST_KEPT = 400_000
#: Longer ones are rare, and worked out each time.
LONGEST_KEPT = 64

THRESHOLD = 0.7

#: The letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}

#: Costs, in nats: reading a look-alike, or a wildcard; dropping a separator, a look-alike before a token's letters, after
#: them (a mark; a digit) or between them, the second of two equal letters, a further one, a space; and keeping a space
#: between one-character tokens.
LIKE, WILD, SEPARATOR, LEAD, TRAIL, TRAIL_DIGIT, INNER, TWICE, MORE, SPACE, KEEP_SPACE = 0.7, 2.0, 0.6, 2.0, 0.4, 1.5, 3.0, 2.5, 0.2, 0.3, 1.5

EDGE_CODE, OTHER_CODE, CODES = 0, 27, 28

_FOLD = np.zeros(256, dtype=np.int64)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_FOLD[192:] = OTHER_CODE  # the first byte of a character beyond ASCII
_SKIPPED = (np.arange(256) >= 128) & (np.arange(256) < 192)

_PLAIN = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1")
#: One-character tokens in a row; the first may have punctuation before it, the last after it.
_SPELT = re.compile(r"(?<![^\x20\x09-\x0D])[^\w\s]*[^\x20\x09-\x0D](?:[\x20\x09-\x0D]+[^\x20\x09-\x0D](?![^\x20\x09-\x0D]))+[\x20\x09-\x0D]+[^\x20\x09-\x0D][^\w\s]*(?![^\x20\x09-\x0D])")
#: Marks at a token's edges that can only be dropped.
_EDGES = ".,;:?\"')[]}>%&*-_=~^/\\`"


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER_CODE


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts, by (before, last, next): CODES**3 numbers reach the driver at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(low, 512).to_pylist()
                for i, j in slices(texts):
                    raw = np.frombuffer("\n\n".join(t or "" for t in texts[i:j]).encode("utf-8", "replace"), dtype=np.uint8)
                    c = _FOLD[raw[~_SKIPPED[raw]]]
                    c = np.concatenate([[0], c, [0]])
                    c = c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]  # one edge between words
                    total += np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = docs.select(text).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(CODES**3)
    for r in rows:
        total[r["at"]] = r["n"]
    return total.reshape(CODES, CODES, CODES)


def language_model(counts: np.ndarray, known_words: list[str], weight: float = 0.5) -> np.ndarray:
    """Costs (-log p) of the next code after two, from corpus counts mixed with the trigrams of ``known_words``."""

    def smooth(c: np.ndarray) -> np.ndarray:
        c = c.copy()
        c[:, EDGE_CODE, :] = c[:, EDGE_CODE, :].sum(0)[None, :]  # what stood before the last word doesn't count
        two = c.sum(0)
        one = (two.sum(0) + 0.5) / (two.sum() + 0.5 * CODES)
        p2 = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
        return (c + 20 * p2[None]) / (c.sum(2, keepdims=True) + 20)

    p = smooth(counts)
    if known_words:
        own = np.zeros_like(counts)
        for w in known_words:
            c = [EDGE_CODE, EDGE_CODE, *map(code, w), EDGE_CODE]
            for a, b, d in zip(c, c[1:], c[2:], strict=False):
                own[a, b, d] += 100
        p = (1 - weight) * p + weight * smooth(own)
    return -np.log(p)


def lattice(token: str, whole: bool = False) -> list[list[tuple[str, float]]]:
    """For each character of a token (lower case) its readings (letters, a space or nothing) and their costs.

    In a token without letters, or if ``whole``, look-alikes are read, but for repetitions and marks around digits alone.
    """
    letters = [k for k, c in enumerate(token) if c.isalpha()]
    first, last = (letters[0], letters[-1]) if letters else (len(token), -1)
    digits = [] if letters else [k for k, c in enumerate(token) if c.isdigit()]
    out = []
    run = 0
    for k, c in enumerate(token):
        run = run + 1 if k and token[k - 1] == c else 1
        if c.isspace():
            out.append([("", SPACE), (" ", KEEP_SPACE)])
        elif c.isalpha():
            longer = run >= 2 and (run >= 3 or (k + 1 < len(token) and token[k + 1] == c))
            out.append([(c, 0.0)] + ([("", MORE if longer else TWICE)] if run >= 2 else []))
        else:
            like = LOOKS_LIKE.get(c, "")
            drop = SEPARATOR if not like else INNER if first < k < last else LEAD if k < first else TRAIL_DIGIT if c.isdigit() else TRAIL
            if c == "*" and not first < k < last:
                like = ""
            if like and (whole or not letters):
                outside = digits and not digits[0] <= k <= digits[-1]
                drops = [("", LEAD if k < digits[0] else TRAIL)] if outside else [("", TWICE)] if run >= 2 else []
                out.append(drops + [(x, LIKE) for x in like])
                continue
            out.append([("", drop if run == 1 or c.isdigit() else MORE)] + [(x, WILD if c == "*" else LIKE) for x in like])
    return out


class Decoder(dict):
    """Token (lower case) to its restored words, remembered within a bound."""

    def __init__(self, costs: np.ndarray):
        super().__init__()
        self.costs = costs.tolist()

    def __missing__(self, token: str) -> str:
        out = self.decode(token)
        if len(token) <= LONGEST_KEPT:
            if len(self) > MOST_KEPT:
                self.clear()
            self[token] = out
        return out

    def decode(self, token: str) -> str:
        core = token.strip(_EDGES)
        if _PLAIN.fullmatch(core) and not any(a == b for a, b in zip(core, core[1:], strict=False)):
            return core
        if not any(c.isalpha() for c in token) and len(set(core) & LOOKS_LIKE.keys()) < 2:
            return ""
        out = self.search(token)
        core = core.rstrip("!")
        if core[-1:] in ("$", "+") and core[0].isalpha() and (other := self.search(core, True)) not in ("", out):
            return f"{out} {other}"  # a mark at the end, or a letter: both
        return out

    def search(self, token: str, whole: bool = False) -> str:
        """Viterbi over the lattice; a state is the last two codes, so their number is bounded by the options.

        A token without letters, or with all look-alikes read, is a word only if it costs less than letters at random.
        """
        costs = self.costs
        # state: cost, and the reading so far as a linked list
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE_CODE, EDGE_CODE): (0.0, None)}
        for options in lattice(token, whole):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, own in options:
                    if not letters:
                        state, c, p = (a, b), cost + own, path
                    else:
                        d = EDGE_CODE if letters == " " else code(letters)
                        if d == b == EDGE_CODE:
                            state, c, p = (a, b), cost + own, path
                        else:
                            state, c, p = (b, d), cost + own + costs[a][b][d], (path, letters)
                    if state not in after or c < after[state][0]:
                        after[state] = (c, p)
            states = after
        cost, path = min(((c + costs[a][b][EDGE_CODE], p) for (a, b), (c, p) in states.items()), key=lambda x: x[0])
        read = []
        while path is not None:
            path, letters = path
            read.append(letters)
        if (whole or not any(c.isalpha() for c in token)) and cost >= (len(read) + 1) * math.log(CODES):
            return ""
        return "".join(reversed(read)).strip()

    def restore(self, text: str | None) -> set[str]:
        """The distinct restored words of a text."""
        if not text:
            return set()
        text = text.lower()
        found: set[str] = set()
        for spelt in _SPELT.findall(text):
            run = spelt.split()
            for part in (run, run[1:], run[:-1]):  # a one-letter word may stand before or after
                if len(part) > 2:
                    found.update(self[" ".join(part)].split())
        for token in set(text.split()):
            t = self[token]
            found.update(t.split()) if " " in t else found.add(t)
            if t != token and t != (core := token.strip(_EDGES)) and _PLAIN.fullmatch(core) and not _THRICE.search(core):
                found.add(core)  # a word with doubled letters counts as it stands, too
        found.discard("")
        return found


def marks(found: set[str], stems: set[str] | None = None) -> set[str]:
    """The marks of a text's restored words: the words, and ``stem-n`` for stems (all, or the given) of n words or more."""
    counts: dict[str, int] = {}
    for k in STEMS:
        for w in found:
            if len(w) > k and (stems is None or w[:k] in stems):
                counts[w[:k]] = counts.get(w[:k], 0) + 1
    return found | {f"{stem}-{n}" for stem, c in counts.items() for n in OFTEN if c >= n}


@dataclass
class ToxicityModel:
    costs: np.ndarray
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def score(self, found: list[set[str]]) -> np.ndarray:
        weight = dict(zip(self.words, self.weights.tolist(), strict=True))
        stems = {w.rpartition("-")[0] for w in self.words if "-" in w}
        sums = np.array([sum(weight[w] for w in sorted(marks(f, stems) & weight.keys())) for f in found], dtype=float)
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -35, 35)))


_decoders: dict[bytes, Decoder] = {}


def _decoder(costs: np.ndarray) -> Decoder:
    """This worker's decoder for a model; only the last model's is kept."""
    name = costs.tobytes()
    if name not in _decoders:
        _decoders.clear()
        _decoders[name] = Decoder(costs)
    claim(_decoders[name])
    return _decoders[name]


def fit_words(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_documents(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, label: str = "toxic") -> ToxicityModel:
    """The model of the usable labels (``usable`` is about the column doc_id); letters are counted over all of ``docs``."""
    counts = letter_counts(docs)
    costs = language_model(counts, [])
    sample = labelled_sample(docs, labels, label, sample_rows, usable)
    shipped = docs.sparkSession.sparkContext.broadcast(costs)
    words = map_texts(sample, "text", ["doc_id", "label"], "words array<string>", lambda ts: {"words": [sorted(marks(_decoder(shipped.value).restore(t))) for t in ts]})
    words = words.withColumn("toxic", (F.col("label") > 0).cast("long")).select("doc_id", "toxic", "words").cache()
    totals = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = totals["n"], totals["t"]
    if not t or t == n:
        words.unpersist()
        share = (t + 1) / (n + 2)
        return ToxicityModel(costs, intercept=float(np.log(share / (1 - share))))
    by_word = words.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("all"), F.sum("toxic").alias("hits"))
    share = F.col("hits") / F.col("all")
    lift = F.col("hits") * F.log2((F.col("hits") + 0.5) / (F.col("all") + 1) / F.lit((t + 1) / (n + 2)))
    best = by_word.where((F.col("hits") >= 5) & (share > 3 * t / n)).withColumn("lift", lift).orderBy(F.desc("lift"), "word").limit(MOST_MARKERS)
    markers = [r["word"] for r in best.select("word").collect()]
    if not markers:
        words.unpersist()
        return ToxicityModel(costs, intercept=float(np.log((t + 1) / (n - t + 1))))
    mine = F.array(*[F.lit(m) for m in markers])
    rows = words.select("doc_id", "toxic", F.array_intersect("words", mine).alias("has")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "has").limit(2 * sample_rows).collect()
    words.unpersist()
    at = {w: k for k, w in enumerate(markers)}
    x, y = np.zeros((len(rows), len(markers))), np.array([r["toxic"] for r in rows], dtype=float)
    for k, r in enumerate(rows):
        x[k, [at[w] for w in r["has"]]] = 1
    weights, intercept = fit_words(x, y)
    strong = [w for w, b in zip(markers, weights, strict=True) if b > 0.7 and len(w) >= 3 and w.isalpha()]
    return ToxicityModel(language_model(counts, strong), markers, weights, intercept)


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, score and predicted: one pass over the texts, no exchange."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> dict[str, object]:
        decoder = _decoder(shipped.value.costs)
        return {"score": shipped.value.score([decoder.restore(t) for t in texts])}

    return map_texts(docs, text, keep, "score double", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def restored_text(docs: DataFrame, model: ToxicityModel, keep: list, text: str = "text") -> DataFrame:
    """The columns ``keep`` and words: the distinct restored words of each text, sorted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.costs)
    return map_texts(docs, text, keep, "words array<string>", lambda ts: {"words": [sorted(_decoder(shipped.value).restore(t)) for t in ts]})
