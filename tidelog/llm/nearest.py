"""Operator 6. Approximate nearest neighbours by multiprobe p-stable hashing.

1. Equal vectors are one *point* with its least ids (as many as a query may return), so copies cost nothing further.
2. A bounded sample of points and, for a few of them, their true neighbours among *all* points give the distance ``near``
   within which most queries have their k neighbours. ``fit`` then chooses the hash functions: in each of ``tables`` tables a
   point falls into the cell of some random projections, ``floor((a.x + b) / width)``. Of the widths, numbers of projections
   and chances that find enough of the true neighbours, it takes those that cost a query least, so cells get finer as the
   table grows.
3. A query perturbs its cell in each table. The chance that a neighbour at distance ``near`` lies in a perturbed cell is a
   product of normal probabilities, from how near the query is to each border. Cells are visited in order of that chance
   until the chances sum up to ``success``. A neighbour is missed by all tables with (1 - success)**tables.
4. Points, and the cells that queries visit, are dealt to parts by cell. A cell of very many points or queries is split
   over several parts. A part computes distances from its queries to the points of their cells and keeps each query's
   best; Spark merges the tables' and parts' candidates, ranked by exact distances in double precision.
5. Queries that found fewer than k neighbours, or whose k-th is much farther than ``near``, go on with an index for a
   greater distance, doubled at least each time, over the points that these few queries' cells hold. When hashing for that
   distance would save nothing, there is one cell: an exact search for whatever is left.

Work grows with the queries and the points in the cells they visit. How many these are depends on the data: where
neighbours are much nearer than other points, a share that falls with the table's size; where they are not (random
directions), most of the table, with this method as with any.

Defined cases. Vectors that are null, empty, zero, of another length than most of the sample, or that hold a null or
non-finite component take no part, as queries or candidates. Null ids take no part. Of rows of one id, the vector that
sorts first counts. Ties go to the smaller id. An empty table gives no rows. Very long vectors only make tasks larger.
Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidelog.llm._common import materialize, sieve

#: Points that the index is fitted on, and those of them whose true neighbours are looked up, at most.
SAMPLE_POINTS, SAMPLE_QUERIES = 2_000, 40

#: Tables; the chances, to find a neighbour at the fitted distance in a table, that ``fit`` chooses from; and the share of
#: known neighbours that it must find.
TABLES, SUCCESSES, RECALL = 2, (0.65, 0.75, 0.85, 0.92), 0.97

#: What ``fit`` chooses from: projections of a table, and a cell's width in units of the distance of near neighbours.
DIRECTIONS, WIDTHS = (4, 6, 8, 12, 16), (2.5, 4.0, 5.5, 8.0)

#: Probes of a query that ``fit`` goes up to, and what one costs, counted in distances.
MOST_PROBES, PROBE_COST = 4_096, 4

#: Points, and visits of queries, that a part holds, about.
PART_POINTS, PART_QUERIES = 8_192, 2_048

#: A query is done if its k-th neighbour is at most so many times as far as the index was fitted for.
SLACK = 1.25


@dataclass
class Index:
    directions: np.ndarray  # tables x k x dimensions
    shifts: np.ndarray  # tables x k, in cells
    codes: np.ndarray  # tables x k: odd numbers that turn a cell's coordinates into one integer
    width: float
    near: float
    success: float

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        """Where points lie, in units of cells."""
        return x @ self.directions[table].T / self.width + self.shifts[table]

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """The numbers of the points' cells in a table: sums of coded coordinates, modulo 2**64."""
        return (np.floor(self.places(x, table)).astype(np.int64) * self.codes[table]).sum(1) + table

    def probes(self, x: np.ndarray, table: int, most: int | None = None) -> list[np.ndarray] | None:
        """For each query the cells to visit, likeliest first, until their chances reach ``success``; None if a query
        needs more than ``most``."""
        at = self.places(x, table)
        own = np.floor(at).astype(np.int64)
        home = (own * self.codes[table]).sum(1) + table
        k = own.shape[1]
        if not k:
            return [np.array([h]) for h in home]
        reach = max(1, math.ceil(4.5 * self.near / self.width))
        steps = np.arange(-reach, reach + 1)
        below = _normal((own[:, :, None] + np.arange(-reach, reach + 2) - at[:, :, None]) * (self.width / self.near))
        logs = -np.log(np.maximum(below[..., 1:] - below[..., :-1], 1e-300))  # queries x k x steps
        out = []
        for q in range(len(x)):
            least = logs[q].min(1)
            cost = logs[q] - least[:, None]
            target = self.success * math.exp(min(700.0, least.sum()))
            second = np.sort(cost, 1)[:, 1]
            bound = 2.0
            while True:
                costs, cells = np.zeros(1), home[q : q + 1]
                for i in np.argsort(-second).tolist():  # those with no near border first: they add least
                    fit = cost[i] <= bound
                    joint = (costs[:, None] + cost[i, fit]).ravel()
                    cells = (cells[:, None] + steps[fit] * self.codes[table, i]).ravel()[joint <= bound]
                    costs = joint[joint <= bound]
                chances = np.exp(-costs)
                if chances.sum() >= target or bound > 200:
                    break
                if most and len(costs) > most:
                    return None
                bound += 1.0
            order = np.argsort(costs, kind="stable")
            out.append(cells[order[: int(np.searchsorted(np.cumsum(chances[order]), target)) + 1]])
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2))


def hash_functions(dimensions: int, tables: int, directions: int, width: float, near: float, success: float, seed: int = 20240501) -> Index:
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((tables, directions, dimensions))
    return Index(a, rng.uniform(0, 1, (tables, directions)), rng.integers(-(2**62), 2**62, (tables, directions)) * 2 + 1, width, near, success)


def trial(index: Index, sample: np.ndarray, queries: np.ndarray, known: list[np.ndarray], n: int) -> tuple[float, float]:
    """The share of the ``known`` neighbours of ``queries`` that the index finds, and what a query costs on average, in
    distances: points met among ``n`` like those of ``sample``, and probes. Infinite if a query needs too many probes."""
    met = probed = 0
    missed = [np.ones(len(v), dtype=bool) for v in known]
    for t in range(len(index.directions)):
        visits = index.probes(queries, t, MOST_PROBES)
        if visits is None:
            return 0.0, math.inf
        found, counts = np.unique(index.cells(sample, t), return_counts=True)
        for q, cells in enumerate(visits):
            at = np.minimum(np.searchsorted(found, cells), len(found) - 1)
            met += int(counts[at][found[at] == cells].sum())
            probed += len(cells)
            if known and len(known[q]):
                missed[q] &= ~np.isin(index.cells(known[q], t), cells)
    hits = [1 - m.mean() for m in missed if len(m)]
    return float(np.mean(hits)) if hits else 1.0, (met * n / len(sample) + PROBE_COST * probed) / len(queries)


def fit(sample: np.ndarray, queries: np.ndarray, near: float, n: int, tables: int = TABLES, known: list[np.ndarray] | None = None, wanted: float = RECALL) -> Index:
    """The cheapest hash functions for ``n`` points like those of ``sample`` that find the ``known`` neighbours of
    ``queries``, or else neighbours at the distance ``near``.

    Without known neighbours, one table with one cell is a choice, too: it costs all ``n``.
    """
    d = sample.shape[1]
    best, least = None, (True, math.inf, math.inf)
    if not known:
        best, least = hash_functions(d, 1, 0, near, near, 1.0), (False, n, 0.0)
    for k in DIRECTIONS:
        for w in WIDTHS:
            for success in SUCCESSES if known else SUCCESSES[-1:]:
                index = hash_functions(d, tables, k, w * near, near, success)
                recall, cost = trial(index, sample, queries, known or [], n)
                rank = (True, -recall, cost) if recall < wanted else (False, cost, 0.0)  # of those that find too few, the one that finds most
                if rank < least:
                    best, least = index, rank
                if recall >= wanted or cost >= least[1] and not least[0]:
                    break  # a greater chance only costs more
    return best


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, without negative zeros; v is float if it was, else double."""
    kind = vectors.schema[vector].dataType
    element = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast(element) + F.lit(0.0).cast(element)).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def once_each(rows: DataFrame) -> DataFrame:
    """``usable`` rows, one for each id. Only ids are shuffled, and the rows of the ids that repeat."""
    repeated = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return rows
    first = F.row_number().over(Window.partitionBy("id").orderBy("v"))
    chosen = rows.join(repeated, "id", "left_semi").withColumn("n", first).where("n = 1").drop("n")
    return rows.join(repeated, "id", "left_anti").union(chosen)


def copies(rows: DataFrame, k: int) -> DataFrame:
    """(point, ids): of each vector that several ids have, the least id and the k + 1 least ones. Vectors are told apart by
    two 64-bit hashes here, so that no vector moves."""
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))  # Spark keeps the first of each group before it shuffles
    few = rows.select(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), "id").withColumn("n", rank).where(F.col("n") <= k + 1)
    return few.groupBy("a", "b").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("point", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def true_neighbours(points: DataFrame, names: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest points to each of ``queries`` (the points ``names``), nearest first: exact over all points, in one pass
    that keeps k a task."""
    shipped = points.sparkSession.sparkContext.broadcast((names, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shipped.value
        best = np.full((len(asked), k), np.inf)
        held = np.zeros((len(asked), k, asked.shape[1]))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x = _matrix(part.column(1))
                squares = _squares(asked, x)
                squares[own[:, None] == part.column(0).to_numpy()[None]] = np.inf
                both = np.concatenate([best, squares], 1)
                at = np.argpartition(both, k - 1, 1)[:, :k]
                best = np.take_along_axis(both, at, 1)
                old = np.take_along_axis(held, np.minimum(at, k - 1)[:, :, None], 1)
                held = np.where((at < k)[:, :, None], old, x[np.maximum(at - k, 0)])
        q, nth = np.nonzero(np.isfinite(best))
        flat = held[q, nth]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * asked.shape[1]), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best[q, nth], pa.float64()), vectors], ["query", "square", "v"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy("square", "v"))
    found = points.select("point", "v").mapInArrow(run, "query long, square double, v array<double>").withColumn("n", rank).where(F.col("n") <= k)
    rows = found.orderBy("query", "n").toArrow()
    at = rows.column("query").to_numpy()
    vectors = _matrix(rows.column("v").combine_chunks()) if len(at) else np.zeros((0, queries.shape[1]))
    return [vectors[at == q] for q in range(len(queries))]


def near_distance(distances: list[float]) -> float:
    """Within which most queries have their neighbours; where distances differ widely, the nearer ones' come first, as later
    rounds take the others."""
    if not distances:
        return 1.0
    return max(min(float(np.quantile(distances, 0.9)), 2 * float(np.quantile(distances, 0.25))), 1e-12)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by one matrix product; exact up to rounding in the order of the vectors' own squares."""
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)


#: Pairs of a cell from which on its distances come from a matrix product; pairs that are held at once.
BLOCK_PAIRS, HELD_PAIRS = 4_096, 400_000


class _Best:
    """The k + 1 nearest candidates of each query met so far."""

    def __init__(self, asked: np.ndarray, x: np.ndarray, names: np.ndarray, k: int):
        self.asked, self.x, self.names, self.k = asked, x, names, k
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, q: np.ndarray, p: np.ndarray) -> None:
        for low in range(0, len(q), 16_384):
            a, b = q[low : low + 16_384], p[low : low + 16_384]
            self.held.append((a, b, np.sqrt(((self.x[b] - self.asked[a]) ** 2).sum(1))))
        self.n += len(q)
        if self.n > HELD_PAIRS:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        q, p, distance = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((self.names[p], distance, q))
        q, p, distance = q[order], p[order], distance[order]
        point = self.names[p]
        new = np.append(True, (q[1:] != q[:-1]) | (point[1:] != point[:-1]))  # a point that two tables found
        q, p, distance = q[new], p[new], distance[new]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        few = rank <= self.k
        self.held = [(q[few], p[few], distance[few])]
        self.n = int(few.sum())
        return self.held[0]


def search_part(names: np.ndarray, cells: np.ndarray, x: np.ndarray, asked: np.ndarray, visits: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of query, place of point, distance): of each query the k + 1 nearest points in the cells that it visits.

    Small cells' pairs are listed and measured together; large cells take one matrix product for all their queries.
    """
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    sizes = np.diff(np.append(starts, len(cells)))
    query = np.repeat(np.arange(len(visits)), [len(v) for v in visits])
    visit = np.concatenate(visits)
    hit = np.minimum(np.searchsorted(found, visit), len(found) - 1)
    there = found[hit] == visit
    query, hit = query[there], hit[there]
    best = _Best(asked, x, names, k)
    visitors = np.bincount(hit, minlength=len(found))
    large = (sizes * visitors >= BLOCK_PAIRS)[hit]
    small_q, small_c = query[~large], hit[~large]
    ends = np.cumsum(sizes[small_c])
    low = 0
    while low < len(small_q):  # so many visits at once that their pairs are about HELD_PAIRS
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HELD_PAIRS, side="right")))
        n = sizes[small_c[low:high]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best.add(np.repeat(small_q[low:high], n), order[np.repeat(starts[small_c[low:high]], n) + inside])
        low = high
    query, hit = query[large], hit[large]
    by_cell = np.argsort(hit, kind="stable")
    for group in np.split(by_cell, np.flatnonzero(np.diff(hit[by_cell])) + 1) if len(by_cell) else []:
        c = hit[group[0]]
        at = order[starts[c] : starts[c] + sizes[c]]
        step = max(1, 1_000_000 // len(at))
        for low in range(0, len(group), step):
            own = query[group[low : low + step]]
            squares = _squares(asked[own], x[at])
            if len(at) > k + 1:
                slack = 1e-12 * ((asked[own] ** 2).sum(1) + (x[at] ** 2).sum(1).max())
                keep = squares <= (np.partition(squares, k, 1)[:, k] + slack)[:, None]
            else:
                keep = np.ones(squares.shape, dtype=bool)
            a, b = np.nonzero(keep)
            best.add(own[a], at[b])
    return best.reduce()


def _search(k: int):
    """``search_part`` over rows sorted by part, with a part's points (query -1) before its queries."""

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held)
        n = int((rows.column("query").to_numpy() < 0).sum())
        if not n or n == rows.num_rows:
            return None
        mine, queries = rows.slice(0, n), rows.slice(n)
        visits = [np.array(v, dtype=np.int64) for v in queries.column("visit").to_pylist()]
        names = mine.column("point").to_numpy()
        q, p, distance = search_part(names, mine.column("cell").to_numpy(), _matrix(mine.column("v").combine_chunks()), _matrix(queries.column("v").combine_chunks()), visits, k)
        return pa.RecordBatch.from_arrays([pa.array(queries.column("query").to_numpy()[q]), pa.array(names[p]), pa.array(distance)], ["query", "point", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: int | None = None
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for low, high in zip(borders, borders[1:], strict=False):
                if low == high:
                    continue
                if at is not None and parts[low] != at:
                    if (out := search(held)) is not None:
                        yield out
                    held = []
                at = parts[low]
                held.append(batch.slice(low, high - low))
        if held and (out := search(held)) is not None:
            yield out

    return run


def candidates(points: DataFrame, asked: DataFrame, index: Index, k: int, n: int, pruned: bool) -> DataFrame:
    """(query, point, score): of each query and part the k + 1 nearest points in the cells that the query visits.

    ``points``: point, v; ``asked``: query, v. ``pruned``: leave out beforehand most points whose cells nobody visits.
    """
    shipped = points.sparkSession.sparkContext.broadcast(index)
    tables = len(index.directions)

    def into_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cells = np.stack([shipped.value.cells(x, t) for t in range(tables)], 1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "cells"])

    def into_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                x = _matrix(part.column(1))
                by_table = [shipped.value.probes(x, t) for t in range(tables)]
                lists = [np.concatenate(own) for own in zip(*by_table, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], ["query", "cells"])

    element = points.schema["v"].dataType.simpleString()
    placed = points.select("point", "v").mapInArrow(into_cells, f"point long, v {element}, cells array<long>").select("point", "v", F.explode("cells").alias("cell"))
    sizes = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("points")), "cells")
    probes = asked.select("query", "v").mapInArrow(into_probes, "query long, cells array<long>").select("query", F.explode("cells").alias("cell"))
    visits = materialize(probes.join(sizes, "cell").select("query", "cell"), "visits")
    crowded = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("queries")).where(F.col("queries") > PART_QUERIES)
    # few: a cell counts if it alone fills a part
    big = materialize(sizes.where(F.col("points") > PART_POINTS).join(crowded, "cell", "full").select("cell", F.ceil(F.coalesce(F.col("points") / PART_POINTS, F.lit(1))).cast("int").alias("splits"), F.ceil(F.coalesce(F.col("queries") / PART_QUERIES, F.lit(1))).cast("int").alias("groups")), "big-cells")
    parts = max(1, math.ceil(n * tables / PART_POINTS), math.ceil(visits.count() / (16 * PART_QUERIES)))

    def dealt(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Rows with their parts: of a big cell, one's own split or group, with all groups or splits of the other side."""
        some = rows.join(big, "cell", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("splits", "groups")})
        some = some.withColumns({"_own": F.pmod(F.xxhash64(name), F.col(own)), "_other": F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1))})
        split, group = (F.col("_own"), F.col("_other")) if own == "splits" else (F.col("_other"), F.col("_own"))
        return some.withColumn("part", F.pmod(F.xxhash64("cell", split, group), F.lit(parts)).cast("int")).drop("splits", "groups", "_own", "_other")

    if pruned:
        placed = sieve(placed.withColumn("_hash", F.xxhash64("cell")), visits.select(F.xxhash64("cell").alias("_hash")).distinct()).where("_maybe")
    stored = dealt(placed, "point", "splits", "groups").select("part", F.lit(-1).cast("long").alias("query"), "point", "cell", "v", F.lit(None).cast("array<long>").alias("visit"))
    going = dealt(visits, "query", "groups", "splits").groupBy("query", "part").agg(F.sort_array(F.collect_set("cell")).alias("visit")).join(asked, "query")
    both = stored.union(going.select("part", "query", F.lit(None).cast("long"), F.lit(None).cast("long"), "v", "visit"))
    return both.repartition("part").sortWithinPartitions("part", "query").mapInArrow(_search(k), "query long, point long, score double")


def _merged(found: DataFrame, same: DataFrame, k: int) -> DataFrame:
    """The k best of all candidates, copies and all, without the query itself."""
    once = found.groupBy("query", "point").agg(F.min("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))
    top = once.withColumn("n", best).where(F.col("n") <= k + 1).drop("n")
    ids = top.join(same, "point", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("point"))).alias("vec_id")).where("vec_id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return ids.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = once_each(usable(vectors, key, vector))
    points = materialize(rows.groupBy("v").agg(F.min("id").alias("point")).select("point", "v"), "points")
    sample = _sample(points, "point", SAMPLE_POINTS)
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = pa.compute.list_value_length(sample.column("v")).to_pylist()
    d = max(set(lengths), key=lambda size: (lengths.count(size), size))
    sample = sample.filter(pa.array([size == d for size in lengths]))
    points = points.where(F.size("v") == d)
    same = materialize(copies(rows.where(F.size("v") == d), k), "copies")
    n = points.count()
    x = _matrix(sample.column("v").combine_chunks())
    queries = x[:SAMPLE_QUERIES]
    known = true_neighbours(points, sample.column("point").to_numpy()[:SAMPLE_QUERIES], queries, k)
    far = [np.sqrt(((v - q) ** 2).sum(1)) for q, v in zip(queries, known, strict=True)]
    near = near_distance([float(f.max()) for f in far if len(f)])
    known = [v[f <= near] for f, v in zip(far, known, strict=True)]
    asked = materialize(once_each(usable(vectors.where(F.col(key) % every == 0), key, vector)).where(F.size("v") == d).select(F.col("id").alias("query"), "v"), "queries")
    found, settled, first = None, [], True
    while True:
        index = fit(x, queries if first else _matrix(_sample(asked, "query", SAMPLE_QUERIES).column("v").combine_chunks()), near, n, tables, known if first and n > 1 else None)
        new = candidates(points, asked, index, k, n, pruned=not first)
        found = materialize(new if found is None else found.join(asked.select("query"), "query", "left_semi").union(new), "found")
        answers = materialize(_merged(found, same, k), "answers")
        last = not index.directions.shape[1]
        enough = answers.where(F.col("rank") == k).withColumn("done", F.col("score") <= SLACK * near)
        if last:
            return _all_of([*settled, answers])
        waiting = asked.select("query", "v").join(enough, asked["query"] == enough["query_id"], "left").where("NOT coalesce(done, false)").select("query", "v", "score")
        asked = materialize(waiting, "waiting")
        left = asked.agg(F.count(F.lit(1)).alias("n"), F.percentile("score", 0.1).alias("near"), F.count("score").alias("full")).first()
        if not left["n"]:
            return _all_of([*settled, answers])
        settled.append(answers.join(asked.select(F.col("query").alias("query_id")), "query_id", "left_anti"))
        near = max(2 * near, left["near"] if left["full"] == left["n"] else 0.0)
        first = False


def _sample(rows: DataFrame, key: str, limit: int) -> pa.Table:
    """(key, v) of at most ``limit`` rows, those of the smallest hashes of their key."""
    return rows.orderBy(F.xxhash64(key)).limit(limit).select(key, F.col("v").cast("array<double>").alias("v")).toArrow()


def _all_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out
