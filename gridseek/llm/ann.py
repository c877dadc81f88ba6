"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, so that the largest inner product is the least distance. A bounded sample
gives centroids by k-means with a charge for crowded clusters. Centroids are linked to their neighbours in
a graph held in memory; a best-first walk finds a vector's nearest lists, many vectors at a time. A vector
near a boundary goes to several lists: those within `closure` times the least distance, but none that lies
close to a chosen list (`apart`, in parts of the vector's distance: where all centroids are nearer to each
other than to the vectors, as in many dimensions, 1 would keep every vector in one list). A query, brought
to the length of the longest vector, reads the lists within `ratio` times its least distance; if the walk
ends before that, it looks at all centroids. Every row is indexed; what is sampled is only where the
centroids lie.

Lists stay balanced at any skew: one of more than LIST_CAP rows is split by a hash, and one that many
queries read is copied, so a task scores at most LIST_CAP rows against QUERY_CAP queries. The scores of
what the lists propose are summed in the order of the components on the original vectors, so equal
vectors have equal scores, and ties go to the smaller id.

Cases: vectors that are null, zero, of another length than most, or with null or non-finite components, and
rows of a null id, take no part; equal rows are one row, other rows of one id count once, with their best score,
and a query id that has several vectors asks with the least of them; a query whose lists hold too few vectors, or
whose lists give fewer ids than there are, reads all lists; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.llm.common import checkpointed

LIST_CAP, QUERY_CAP = 2048, 1024


@dataclass(frozen=True)
class Params:
    sample: int = 20_000  # rows that the centroids are fitted on, at most about
    list_rows: int = 128  # rows of a list, about
    max_lists: int = 8_192  # bounds the centroids that are broadcast
    closure: float = 1.2  # a vector joins lists up to so many times its least distance
    apart: float = 0.5  # and so far, in parts of its distance, from those it has joined
    replicas: int = 5
    ratio: float = 1.13  # a query reads lists up to so many times its least distance
    beam: int = 128  # lists that the walk keeps
    degree: int = 24
    iterations: int = 8


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def augment(x: np.ndarray, longest: float) -> np.ndarray:
    """With the component that gives every vector the length `longest`."""
    return np.concatenate([x, np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0))[:, None]], axis=1)


def balanced_centroids(x: np.ndarray, k: int, iterations: int, seed: int = 7) -> np.ndarray:
    """k-means whose assignment adds a charge that grows with a cluster's size."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    k, charge = len(c), np.zeros(len(c))
    for _ in range(iterations):
        nearest = np.concatenate([np.argmin(_distances(x[i : i + 1024], c) + charge, axis=1) for i in range(0, len(x), 1024)])
        sizes = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
        if (~full).any():
            c[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
        spread = np.mean(((x - c[nearest]) ** 2).sum(1))
        charge = 0.1 * spread * np.log1p(sizes * k / len(x))
    return c


class CentroidGraph:
    """Centroids with links to their neighbours, and a walk over them."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.c, n = centroids, len(centroids)
        near = np.empty((n, min(degree, max(n - 1, 1))), np.int64)
        for i in range(0, n, 512):
            d = _distances(centroids[i : i + 512], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + len(d)] = np.argsort(d, axis=1)[:, : near.shape[1]]
        far = np.random.default_rng(5).integers(0, n, (n, 4))  # long links keep the graph in one piece
        self.links = np.concatenate([near, far], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest centroids that a best-first walk finds, nearest first, and their squared distances."""
        n, beam = len(self.c), min(beam, len(self.c))
        rows = np.arange(len(x))
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        dist = _distances(x, self.c[self.entries])
        opened = np.zeros(ids.shape, bool)
        for _ in range(2 * beam):
            best = np.where(opened, np.inf, dist)
            pick = best.argmin(1)
            live = np.isfinite(best[rows, pick])
            if not live.any():
                break
            opened = opened.copy()
            opened[rows, pick] = True
            new = self.links[ids[rows, pick]]
            fresh = ~seen[rows[:, None], new] & live[:, None]
            seen[rows[:, None], new] |= live[:, None]
            gap = self.c[new] - x[:, None]
            d = np.where(fresh, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
            d[:, 1:][new[:, 1:] == new[:, :-1]] = np.inf
            ids, dist, opened = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1), np.concatenate([opened, ~fresh], 1)
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, opened = (np.take_along_axis(a, order, 1) for a in (ids, dist, opened))
        # the walk can reach one centroid by two links at once
        twice = np.zeros(ids.shape, bool)
        order = np.argsort(ids, axis=1, kind="stable")
        s = np.take_along_axis(ids, order, 1)
        np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
        dist = np.where(twice, np.inf, dist)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def closure_lists(graph: CentroidGraph, x: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: each vector's nearest list, first, and the others its boundary closeness calls for."""
    ids, d2 = graph.walk(x, max(16, 2 * p.replicas))
    d, chosen = np.sqrt(d2), [ids[:, 0]]
    keep = [np.ones(len(x), bool)]
    count = np.ones(len(x), int)
    for j in range(1, ids.shape[1]):
        ok = (d[:, j] <= p.closure * d[:, 0]) & (count < p.replicas)
        for c, was in zip(chosen, keep, strict=True):
            between = np.sqrt(((graph.c[c] - graph.c[ids[:, j]]) ** 2).sum(1))
            ok &= ~was | (between > p.apart * d[:, j])
        chosen.append(ids[:, j])
        keep.append(ok)
        count += ok
    rows, which = np.nonzero(np.stack(keep, 1))
    return rows, np.stack(chosen, 1)[rows, which]


def lists_to_read(graph: CentroidGraph, q: np.ndarray, longest: float, own: np.ndarray, k: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) pairs. own: how many vectors have a list as their nearest."""
    q = np.concatenate([q * (longest / np.sqrt((q * q).sum(1)))[:, None], np.zeros((len(q), 1))], axis=1)
    ids, d2 = graph.walk(q, p.beam)
    d = np.sqrt(d2)
    near = np.isfinite(d) & (d <= p.ratio * d[:, :1])
    near |= np.isfinite(d) & (np.cumsum(own[ids], axis=1) - own[ids] <= 4 * (k + 1))
    wide = np.flatnonzero(near[:, -1] & (ids.shape[1] < len(graph.c)))  # the walk ended within the ratio
    near[wide] = False
    at, which = np.nonzero(near)
    lists = ids[at, which]
    if len(wide):
        full = np.sqrt(_distances(q[wide], graph.c))
        row, which = np.nonzero(full <= np.maximum(p.ratio * full.min(1), d[wide, -1])[:, None])
        at, lists = np.concatenate([at, wide[row]]), np.concatenate([lists, which])
    few = np.flatnonzero(np.bincount(at, own[lists], len(q)) < min(4 * (k + 1), own.sum()))
    rest = ~np.isin(at, few)
    return np.concatenate([at[rest], np.repeat(few, len(graph.c))]), np.concatenate([lists[rest], np.tile(np.arange(len(graph.c)), len(few))])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among the vectors of other ids."""
    p = params
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    asks = queries.select(queries[id_col].cast("long").alias("id"), queries[vector_col].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    shape = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).orderBy(F.desc("rows"), "n").first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    dim, total, longest = shape["n"], shape["rows"], float(shape["square"]) ** 0.5
    rows, asks = rows.filter(F.size("v") == dim), asks.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))

    # centroids from a bounded sample
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    sample = rows.filter(part < int(min(1.0, p.sample / total) * (1 << 30))).select("v").toArrow() if total > 64 else rows.select("v").toArrow()
    if not sample.num_rows:
        sample = rows.select("v").limit(64).toArrow()
    x = augment(_matrix(sample.column("v").combine_chunks()), longest)
    x = x[np.lexsort(x.T[::-1])]
    n_lists = int(max(1, min(p.max_lists, total // p.list_rows, len(x) // 3)))
    graph = rows.sparkSession.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, n_lists, p.iterations), p.degree))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield b.slice(at, 512)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, lists = closure_lists(graph.value, augment(_matrix(b.column(1)), longest), p)
            first = np.concatenate([[True], at[1:] != at[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(first), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["list", "first", "id", "v"])

    posted = checkpointed(rows.mapInArrow(post, "list long, first boolean, id long, v array<double>"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("own")).collect()  # a row for each list
    own = np.zeros(n_lists, np.int64)
    for r in sizes:
        own[r["list"]] = r["own"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, lists = lists_to_read(graph.value, _matrix(b.column(1)), longest, own, k, p)
            yield pa.RecordBatch.from_arrays([pa.array(lists), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["list", "id", "v"])

    def score(rows_: pa.Table, queries_: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows_.num_rows and queries_.num_rows:
            order = np.argsort(rows_.column("id").to_numpy(), kind="stable")
            all_ids, v = rows_.column("id").to_numpy()[order], _matrix(rows_.column("v").combine_chunks())[order]
            first = np.flatnonzero(np.append(True, all_ids[1:] != all_ids[:-1]))  # an id can have several vectors
            ids, until = all_ids[first], np.append(first[1:], len(all_ids))
            asks_, q = queries_.column("id").to_numpy(), _matrix(queries_.column("v").combine_chunks())
            rough = np.maximum.reduceat(q @ v.T, first, axis=1)
            rough[asks_[:, None] == ids[None]] = -np.inf
            slack = 1e-9 * (np.abs(q).sum(1) * np.abs(v).max() + 1e-300)
            top = min(k + 1, len(ids))  # its own id among them
            bar = np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top] - slack
            for i in range(len(asks_)):
                near = np.flatnonzero((rough[i] >= bar[i]) & (rough[i] > -np.inf))
                if not len(near):
                    continue
                size = until[near] - first[near]
                at = np.cumsum(size) - size
                exact = np.maximum.reduceat(dots(q[i], v[np.arange(size.sum()) + np.repeat(first[near] - at, size)]), at)
                best = np.lexsort((ids[near], -exact))[:k]
                out[0] += [asks_[i]] * len(best)
                out[1] += ids[near[best]].tolist()
                out[2] += exact[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def nearest(asked: DataFrame) -> DataFrame:
        """The k nearest ids of what the lists of each query hold. asked: a row for each query and list."""
        readers = asked.groupBy("list").agg(F.count("*").alias("readers"))
        # a row for each list: at most max_lists
        cells = rows.sparkSession.createDataFrame([(r["list"], -(-r["n"] // LIST_CAP)) for r in sizes], "list long, parts long").join(readers, "list").withColumn("copies", F.ceil(F.col("readers") / QUERY_CAP))
        cells = F.broadcast(cells.select("list", "parts", "copies"))
        left = posted.join(cells, "list").withColumn("part", F.pmod(F.xxhash64("id", "v"), "parts")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        right = asked.join(cells, "list").withColumn("copy", F.pmod(F.xxhash64("id"), "copies")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        keys = ["list", "part", "copy"]
        found = left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")
        ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = checkpointed(nearest(checkpointed(asks.mapInArrow(ask, "list long, id long, v array<double>"))))
    # where ids have several vectors, lists can hold enough vectors and too few ids
    most = min(k, rows.select("id").distinct().limit(k + 1).count() - 1)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
    short = checkpointed(asks.join(full, asks["id"] == full["query_id"], "left_anti"))
    if most < 1 or short.isEmpty():
        return found
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lists - 1).cast("long")))
    again = nearest(checkpointed(short.select(every.alias("list"), "id", "v")))
    return found.join(short.select("id"), found["query_id"] == short["id"], "left_anti").union(again)


def dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, alike for equal vectors."""
    total = np.zeros(len(v))
    for j in range(v.shape[1]):
        total += q[j] * v[:, j]
    return total
