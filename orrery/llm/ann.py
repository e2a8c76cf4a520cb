"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Largest inner product becomes least distance by one more coordinate: with M the greatest norm, x gets sqrt(M^2 - |x|^2) and
a query gets 0, so |q - x|^2 = |q|^2 + M^2 - 2 q.x. Coordinates are then turned by one random rotation.
Rows go to inverted lists by their nearest centroid. Centroids are fitted by k-means on at most ``SAMPLE`` rows, those with
the smallest id hashes; every row is indexed. Each query probes the lists with the nearest centroids; how many is measured on
the table itself: the true neighbours of at most ``MEASURED`` queries (those with the smallest id hashes) are found by reading
every row once, and the least number of probes is taken that reaches the wanted share of them. On vectors without directions that
number grows with the number of lists.

Lists lie on *shelves* of at most about ``SHELF_ROWS`` rows: near lists share one, a larger list is dealt over several. A query
goes once to every shelf that holds a list it probes, and the queries of a shelf are dealt to blocks of about ``QUERY_BLOCK``
that get the shelf's rows each, so no task holds a hot list or all queries of one. A block has as many queries as a shelf has rows, so what is sent
grows with queries times the shelves that they probe. Number of lists: rows / ``LIST_ROWS``, at
most ``MOST_LISTS``, so that each has twenty rows of the sample.

Inside a shelf a query scans its lists, the nearest first. Candidates lie in column blocks of rotated coordinates. After a
block, the partial distance d over k of D dimensions estimates the whole distance: a rotated difference has partial lengths
close to sqrt(k/D) of its own, and the test gives up a candidate if d exceeds the query's current k-th distance by
more than (1 + EPSILON/sqrt(k))^2 k/D allows. The current distance is that of the shelf's lists scanned so far. While many candidates of a list are left a
block is read for all of them at once, then for the survivors alone. Exact inner products are taken in double precision from the
original vectors, of all candidates that survive, and each shelf returns its best rows for each query. A query's
answer is its 20 best rows over all shelves, ties to the smaller id.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part, neither do rows with a
null id; vectors of another length than the commonest take no part; queries with fewer candidates get all that were found; equal
vectors are all candidates; of rows with one id each is a candidate, and they are one query (the
vector that sorts first); a query never returns rows of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 20_480
MEASURED = 128
LIST_ROWS = 512
MOST_LISTS = 1024
SHELF_ROWS = 16_384
#: Queries that share one copy of a shelf's rows: as many as it has rows, so rows sent again are never more than queries sent.
QUERY_BLOCK = SHELF_ROWS
#: Queries that are scanned at a time.
SCANNED = 1024
EPSILON = 2.1
COLUMNS = 16
#: Partial distances that are held at a time.
TILE = 1 << 20
SLACK = 1 + 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        for j in range(len(centres)):
            own = x[near == j]
            centres[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Places of the n nearest centres of each row, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        d = (centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T
        some = np.argpartition(d, n - 1, 1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(d), 1))
        out.append(np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(1), 1))
    return np.concatenate(out) if out else np.zeros((0, n), int)


class Space:
    """Lifting, rotation and centroids."""

    def __init__(self, vectors: np.ndarray, norm: float, lists: int, seed: int = 11):
        self.norm = norm
        turn, upper = np.linalg.qr(np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1,) * 2))
        self.turn = turn * np.sign(np.diag(upper))
        self.centres = kmeans(self.lift(vectors), lists)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))] @ self.turn

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        # only the direction of a query matters: at norm M it lies among the rows
        q = q * (self.norm / np.sqrt((q**2).sum(1, keepdims=True)))
        return np.c_[q, np.zeros(len(q))] @ self.turn


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1), 0)


def survivors(queries: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the rows that no test gives up against each query's bound."""
    dims = rows.shape[1]
    partial, pair = distances(queries[:, :COLUMNS], rows[:, :COLUMNS]), None
    for read in range(COLUMNS, dims + COLUMNS, COLUMNS):
        allowed = bound * (SLACK if read >= dims else read / dims * (1 + EPSILON / np.sqrt(read)) ** 2)
        if pair is None:
            alive = partial <= allowed[:, None]
            if read >= dims or np.count_nonzero(alive) * 8 < alive.size:
                pair = np.nonzero(alive)
                partial = partial[pair]
        else:
            alive = partial <= allowed[pair[0]]
            pair, partial = (pair[0][alive], pair[1][alive]), partial[alive]
        if read < dims:
            more = slice(read, read + COLUMNS)
            partial = partial + (distances(queries[:, more], rows[:, more]) if pair is None else ((queries[pair[0], more] - rows[pair[1], more]) ** 2).sum(1))
    return *pair, partial


def scan(queries: np.ndarray, probed: list[np.ndarray], rows: np.ndarray, edges: dict[int, tuple[int, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that were read to the end and lie within the ``most``-th distance of the query.

    ``edges`` are the rows of each list, ``probed`` each query's lists, the nearest first.
    """
    top = np.full((len(queries), most), np.inf)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    asks: dict[tuple[bool, int], list[int]] = {}
    for i, lists in enumerate(probed):
        for n, x in enumerate(lists):
            asks.setdefault((n > 0, int(x)), []).append(i)
    for (_, x), who in sorted(asks.items()):
        a, b = edges.get(x, (0, 0))
        step = max(1, TILE // max(1, b - a))
        for some in (np.array(who[i : i + step]) for i in range(0, len(who) if b > a else 0, step)):
            q, r, d = survivors(queries[some], rows[a:b], top[some, -1])
            found.append((some[q], r + a, d))
            best = np.full((len(some), most + b - a), np.inf)
            best[:, :most], best[q, most + r] = top[some], d
            best.partition(most - 1, 1)
            best = best[:, :most]
            best.sort(1)
            top[some] = best
    q, r, d = map(np.concatenate, zip(*found, strict=True))
    near = d <= top[q, -1] * SLACK
    return q[near], r[near]


def stack(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dims)


def probes_needed(indexed: DataFrame, queries: DataFrame, space: Space, k: int, reached: float) -> int:
    """The least number of probed lists that hold ``reached`` of the k true neighbours of a bounded number of queries."""
    lists = len(space.centres)
    some = queries.orderBy(F.xxhash64("id"), "id").limit(MEASURED).collect() if lists > 1 else []
    if not some:
        return lists
    names, q = np.array([r["id"] for r in some]), np.array([r["v"] for r in some])
    shared = indexed.sparkSession.sparkContext.broadcast((names, q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        top = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(q)
        for batch in batches:
            if batch.num_rows:
                ids, own = batch.column("id").to_numpy(), batch.column("list").to_numpy()
                scores = q @ stack(batch.column("v"), q.shape[1]).T
                for i in range(len(q)):
                    at = np.flatnonzero(ids != names[i])
                    if len(at) > k:
                        at = at[scores[i, at] >= np.partition(scores[i, at], -k)[-k]]
                    every = [np.concatenate(x) for x in zip(top[i], (scores[i, at], ids[at], own[at]), strict=True)]
                    first = np.lexsort((every[1], -every[0]))[:k]
                    top[i] = tuple(x[first] for x in every)
        which = np.repeat(np.arange(len(q), dtype=np.int32), [len(t[0]) for t in top])
        columns = [np.concatenate([t[j] for t in top]) for j in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(which), *map(pa.array, columns)], ["query", "score", "id", "list"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = indexed.select("list", "id", "v").mapInArrow(best, "query int, score double, id long, list int").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query", "list").collect()
    if not found:
        return lists
    place = nearest(space.lift_query(q), space.centres, lists).argsort(1)
    needed = np.sort([place[r["query"], r["list"]] for r in found])
    return int(needed[int(np.ceil(reached * len(needed))) - 1]) + 1


def shelves(centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shelf of each list and the number of shelves it is dealt over; near lists follow each other."""
    first, parts, shelf, left = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // SHELF_ROWS)), -1, 0
    near = nearest(centres, kmeans(centres, max(1, min(len(centres), int(sizes.sum()) // SHELF_ROWS))), 1)[:, 0]
    for i in np.lexsort((np.arange(len(sizes)), near)):
        if sizes[i] > left or parts[i] > 1:
            shelf, left = shelf + 1, SHELF_ROWS
        first[i] = shelf
        left = left - sizes[i] if parts[i] == 1 else 0
        shelf += int(parts[i]) - 1
    return first, parts


def equal_runs(of: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by list, vector and id, and for each where the run of its list and vector starts."""
    _, vector = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, vector, of))
    first = np.r_[True, (of[order][1:] != of[order][:-1]) | (vector[order][1:] != vector[order][:-1])]
    return order, np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, reached: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): the k rows with the largest inner product found for each query; ``reached`` is the share of
    the true neighbours of measured queries that lie in probed lists."""
    spark = vectors.sparkSession
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims, total, norm = sizes["d"], sizes["n"], float(np.sqrt(sizes["m"]))
    rows = rows.where(F.size("v") == dims)
    lists = int(min(MOST_LISTS, max(1, total // LIST_ROWS)))
    sample = stack(rows.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).toArrow().column("v"), dims)
    space = Space(sample, norm, min(lists, len(sample)))
    shared = spark.sparkContext.broadcast(space)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            if batch.num_rows:
                near = nearest(space.lift(stack(batch.column("v"), dims)), space.centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("id"), batch.column("v")], ["list", "id", "v"])

    indexed = materialize(rows.select("id", "v").mapInArrow(assign, "list int, id long, v array<double>"), "lists")
    sizes = np.zeros(len(space.centres), np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["n"]
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    probes = probes_needed(indexed, queries, space, k, reached)
    first, parts = shelves(space.centres, sizes)
    place = spark.sparkContext.broadcast((first, parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, (first, parts) = shared.value, place.value
        for batch in batches:
            if batch.num_rows:
                near = nearest(space.lift_query(stack(batch.column("v"), dims)), space.centres, probes)
                many, flat = parts[near.ravel()], near.ravel()
                query, held = np.repeat(np.repeat(np.arange(len(near)), near.shape[1]), many), np.repeat(flat, many)
                shelf = np.repeat(first[flat], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                # a row for each query and shelf, with the lists there as near as they are
                order = np.lexsort((np.arange(len(query)), shelf, query))
                query, held, shelf = query[order], held[order], shelf[order]
                start = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (shelf[1:] != shelf[:-1])]) if len(query) else np.zeros(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(query)], pa.int32()), pa.array(held, pa.int32()))
                which = pa.array(query[start])
                yield pa.RecordBatch.from_arrays([pa.array(shelf[start], pa.int64()), lists, batch.column("id").take(which), batch.column("v").take(which)], ["shelf", "lists", "id", "v"])

    asked = materialize(queries.mapInArrow(probe, "shelf long, lists array<int>, id long, v array<double>"), "asked")
    blocks = asked.groupBy("shelf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    where = F.broadcast(spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(first))], "list int, first long, parts int"))  # at most MOST_LISTS rows
    held = indexed.join(where, "list").select((F.col("first") + F.pmod(F.xxhash64("id", "v"), "parts")).alias("shelf"), "list", "id", "v")
    held = held.join(blocks, "shelf").select("shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "id", "v")
    asked = asked.join(blocks, "shelf").select("shelf", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "lists", "id", "v")

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            space = shared.value
            of, ids, x = rows.column("list").to_numpy(), rows.column("id").to_numpy(), stack(rows.column("v"), dims)
            names, vectors, lists = queries.column("id").to_numpy(), stack(queries.column("v"), dims), [np.array(p) for p in queries.column("lists").to_pylist()]
            # of rows alike in id and vector k are enough, and of those alike in vector k besides a query's own
            order, start = equal_runs(of, ids, x)
            alike = np.r_[True, (start[1:] != start[:-1]) | (ids[order][1:] != ids[order][:-1])]
            order = order[np.arange(len(order)) - np.maximum.accumulate(np.where(alike, np.arange(len(order)), 0)) < k]
            of, ids, x = of[order], ids[order], x[order]
            asking = ids[np.isin(ids, names)]
            own = int(np.unique(asking, return_counts=True)[1].max()) if len(asking) else 0  # rows that a query may have to leave out
            order, start = equal_runs(of, ids, x)
            order = order[np.arange(len(order)) - start < k + own]
            of, ids, x = of[order], ids[order], x[order]
            cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
            edges = {int(of[a]): (int(a), int(b)) for a, b in zip(cut, cut[1:], strict=False)}
            lifted, parts_ = space.lift(x), []
            for low in range(0, len(names), SCANNED):
                mine = slice(low, low + SCANNED)
                q, r = scan(space.lift_query(vectors[mine]), lists[mine], lifted, edges, k + own)
                q = q + low
                other = names[q] != ids[r]
                q, r = q[other], r[other]
                score = np.concatenate([np.zeros(0), *((x[r[i : i + 65536]] * vectors[q[i : i + 65536]]).sum(1) for i in range(0, len(q), 65536))])
                best = np.lexsort((ids[r], -score, q))
                q, r, score = q[best], r[best], score[best]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                parts_.append((names[q][rank < k], ids[r][rank < k], score[rank < k]))
            out = [np.concatenate(c) for c in zip(*parts_, strict=True)]
        return pa.table(out, ["query_id", "id", "score"])

    found = asked.groupBy("shelf", "block").cogroup(held.groupBy("shelf", "block")).applyInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
