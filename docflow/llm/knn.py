"""Exact top-k search by inner product as a Voronoi join: queries and data are grouped by pivots, bounds of scores between groups
follow from summaries, data go only to the query groups that they may matter to, and each group is solved locally.

Components are turned into integers, floor(scale * x); scores are exact integers. For a query group with pivot p and radius u, and a
vector at distance d from its pivot s, every score lies within |p| d + u |s| + u d of the product p.s. The summaries of the data
groups are their k + 1 smallest distances, which give a score that k others reach for any query of a group.

There are about as many pivots as the square root of the rows. The queries can be grouped by all of them or by fewer: more groups have
tighter bounds, but a vector that no bound excludes goes to each of them. For each of some numbers of groups, the vectors that its
bounds let through are counted, and the number with the least work (products, and copies of vectors) is taken.

Defined results: vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows without an id;
missing components count as 0; rows with the query's id are its own and no candidates; equal rows count once; ties go to the smaller
id; a scaled component or a result that is no 64-bit integer is an error; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.hashing import mix
from docflow.session import materialize, ship

#: Pivots, at most.
MAX_PIVOTS = 1024
#: Queries that are solved together at most, and data rows of one block, about.
GROUP_QUERIES = 1024
BLOCK_ROWS = 4096
#: Products that cost as much as sending one vector to one more group, about.
COPY_COST = 50
EXACT = 2.0**53


def integers(data: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: the distinct usable vectors as packed 64-bit integers."""

    def run(batches):
        for b in batches:
            ids, packed = [], []
            for vec_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if vec_id is None or x is None or any(c is None for c in x):
                    continue
                v = np.floor(scale * np.array(x, np.float64))
                if np.isfinite(np.array(x, np.float64)).all():
                    if (np.abs(v) >= 2.0**63).any():
                        raise OverflowError(f"vector {vec_id} has a component beyond 64-bit integers")
                    ids.append(vec_id)
                    packed.append(v.astype(np.int64).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "v"])

    return data.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary").distinct()


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    if all(len(x) == 8 * dim for x in packed):
        return np.frombuffer(b"".join(packed), np.int64).reshape(len(packed), dim)
    out = np.zeros((len(packed), dim), np.int64)
    for i, x in enumerate(packed):
        out[i, : len(x) // 8] = np.frombuffer(x, np.int64)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where all sums are exact there, as Python integers where 64 bits may not do."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2.0**62 else a.astype(object) @ b.astype(object).T


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest pivot and the distance to it."""
    x = x.astype(np.float64)
    square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    cell = square.argmin(1)
    return cell.astype(np.int32), np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(1), 0))


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, cell, d."""

    def run(batches):
        for b in batches:
            cell, d = nearest(matrix(b.column(1).to_pylist(), pivots.shape[1]), pivots) if b.num_rows else (np.zeros(0, np.int32), np.zeros(0))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(d, pa.float64())], ["vec_id", "v", "cell", "d"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary, cell int, d double")


def nearest_distances(assigned: DataFrame, n: int) -> list[tuple[int, list[float]]]:
    """The n smallest distances of each cell; reduced in each task first, so at most cells * n values a task are shuffled."""

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for b in batches:
            cell, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell):
                best[int(c)] = np.sort(np.append(best.get(int(c), np.zeros(0)), d[cell == c]))[:n]
        cells = [c for c, x in best.items() for _ in x]
        yield pa.record_batch([pa.array(cells, pa.int32()), pa.array([v for x in best.values() for v in x], pa.float64())], ["cell", "d"])

    least = assigned.select("cell", "d").mapInArrow(run, "cell int, d double")
    ranked = least.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("r") <= n)
    return [(r.cell, sorted(r.ds)) for r in ranked.groupBy("cell").agg(F.collect_list("d").alias("ds")).collect()]


def query_cells(queries: DataFrame, pivots: np.ndarray, levels: list[int]) -> DataFrame:
    """vec_id, v, cells, ds: the nearest of the first n pivots and the distance to it, for each n of levels."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(1).to_pylist(), pivots.shape[1])
            found = [nearest(x, pivots[:n]) for n in levels] if b.num_rows else []
            cells = np.array([c for c, _ in found]).T.tolist() if found else []
            ds = np.array([d for _, d in found]).T.tolist() if found else []
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cells, pa.list_(pa.int32())), pa.array(ds, pa.list_(pa.float64()))], ["vec_id", "v", "cells", "ds"])

    return queries.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary, cells array<int>, ds array<double>")


class Grouping:
    """Query groups (cells of the first n pivots that hold queries) and the bounds of their scores."""

    def __init__(self, pivots: np.ndarray, cells: np.ndarray, counts: np.ndarray, radius: np.ndarray, summaries: list[tuple[int, list[float]]], k: int):
        self.cells, self.counts, self.radius = cells, counts, radius
        groups = pivots[cells]
        self.norm, self.pivot_norm, self.between = np.linalg.norm(groups, axis=1), np.linalg.norm(pivots, axis=1), groups @ pivots.T
        self.slack = 1e-6 * (1 + float(np.abs(self.between).max(initial=0)))  # rounding is allowed for
        c = np.array([c for c, ds in summaries for _ in ds], np.int64)
        d = np.array([x for _, ds in summaries for x in ds], np.float64)
        self.reach = np.full(len(cells), -np.inf)  # a score that k + 1 vectors reach for every query of the group
        if len(d) > k:
            for g in range(len(cells)):
                lows = self.between[g, c] - self.norm[g] * d - radius[g] * (self.pivot_norm[c] + d)
                self.reach[g] = np.partition(lows, len(d) - k - 1)[len(d) - k - 1]

    def wanted(self, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        """For each group and each vector (its cell and distance), whether it may be among the best of a query of the group."""
        most = self.between[:, cell] + np.outer(self.norm, d) + np.outer(self.radius, self.pivot_norm[cell] + d)
        return most + self.slack * (1 + d) >= self.reach[:, None]


def wanted_counts(assigned: DataFrame, groupings: list[Grouping]) -> list[np.ndarray]:
    """For each grouping, the number of vectors that each of its groups wants."""

    def run(batches):
        counts = [np.zeros(len(g.cells), np.int64) for g in groupings]
        for b in batches:
            cell, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in range(0, len(cell), 1024):
                for at, g in zip(counts, groupings, strict=True):
                    at += g.wanted(cell[i : i + 1024], d[i : i + 1024]).sum(1)
        level = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        yield pa.record_batch([pa.array(level, pa.int32()), pa.array(np.concatenate([np.arange(len(c)) for c in counts]), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], ["level", "grp", "n"])

    out = [np.zeros(len(g.cells), np.int64) for g in groupings]
    each = assigned.select("cell", "d").mapInArrow(run, "level int, grp int, n long")
    for r in each.groupBy("level", "grp").agg(F.sum("n").alias("n")).collect():  # one row for each group
        out[r.level][r.grp] = r.n
    return out


@dataclass
class Plan:
    queries: DataFrame
    assigned: DataFrame
    level: int
    grouping: Grouping
    wanted: np.ndarray
    dim: int
    total: int

    @property
    def routed_share(self) -> float:
        """Products that are computed, of all between queries and vectors."""
        return float((self.wanted * self.grouping.counts).sum()) / max(1, self.total * int(self.grouping.counts.sum()))


def plan(data: DataFrame, is_query: Column, k: int, scale: int, n_pivots: int | None, group_queries: int) -> Plan | None:
    """Pivots, cells, summaries and the grouping with the least work; None without queries or vectors."""
    vectors = materialize(integers(data, scale), "vectors")
    total, width, n_queries = vectors.agg(F.count("*"), F.max(F.length("v")), F.count_if(is_query)).first()
    if not n_queries:
        return None
    dim = (width or 0) // 8
    n_pivots = n_pivots or min(MAX_PIVOTS, math.isqrt(total) + 1)
    pivots = matrix([r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()], dim).astype(np.float64)
    assigned = materialize(assign(vectors, pivots), "cells")
    levels = sorted({min(len(pivots), 4**i) for i in range(6)})
    queries = materialize(query_cells(vectors.where(is_query), pivots, levels), "queries")
    at = queries.select(F.posexplode(F.arrays_zip("cells", "ds")).alias("level", "at")).groupBy("level", F.col("at.cells").alias("cell")).agg(F.count("*").alias("n"), F.max("at.ds").alias("d"))
    found = sorted(map(tuple, at.collect()))  # at most the sum of levels
    summaries = nearest_distances(assigned, k + 1)
    groupings = []
    for i in range(len(levels)):
        cells, counts, radius = (np.array(x) for x in zip(*((c, n, d) for level, c, n, d in found if level == i), strict=True))
        groupings.append(Grouping(pivots, cells, counts, radius, summaries, k))
    wanted = wanted_counts(assigned, groupings)
    work = [float((w * g.counts + COPY_COST * w * -(-g.counts // group_queries)).sum()) for g, w in zip(groupings, wanted, strict=True)]
    best = int(np.argmin(work))
    return Plan(queries, assigned, best, groupings[best], wanted[best], dim, total)


def search(data: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, n_pivots: int | None = None, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query."""
    ship(data.sparkSession)
    made = plan(data, is_query, k, scale, n_pivots, group_queries)
    if made is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    grouping, dim, level = made.grouping, made.dim, made.level
    chunks = -(-grouping.counts // group_queries)  # a group with many queries is solved in chunks of them
    blocks = np.maximum(1, -(-made.wanted // block_rows))
    index = {int(c): g for g, c in enumerate(grouping.cells)}

    def spread(vec_id: pa.Array, v: pa.Array, at: np.ndarray, grp: np.ndarray, own: np.ndarray, own_of: np.ndarray, every: np.ndarray, names: list[str]) -> pa.RecordBatch:
        """Row at[i] to group grp[i]: one part of own_of by hash, all of the other parts."""
        n = every[grp]
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, grp = np.repeat(at, n), np.repeat(grp, n)
        take = pa.array(at)
        part = (own[at] % own_of[grp].astype(np.uint64)).astype(np.int32)
        return pa.record_batch([pa.array(grp.astype(np.int32)), pa.array(part), pa.array(other.astype(np.int32)), vec_id.take(take), v.take(take)], names)

    def keyed(vec_id: pa.Array) -> np.ndarray:
        return mix(vec_id.to_numpy().astype(np.int64).view(np.uint64))

    def route(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                g, at = np.nonzero(grouping.wanted(part.column(2).to_numpy(), part.column(3).to_numpy()))
                yield spread(part.column(0), part.column(1), at, g, keyed(part.column(0)), blocks, chunks, ["grp", "block", "chunk", "vec_id", "v"])

    def ask(batches):
        for b in batches:
            grp = np.array([index[c[level]] for c in b.column(2).to_pylist()], np.int64)
            yield spread(b.column(0), b.column(1), np.arange(b.num_rows), grp, keyed(b.column(0)), chunks, blocks, ["qgrp", "qchunk", "qblock", "query_id", "v"])

    routed = made.assigned.mapInArrow(route, "grp int, block int, chunk int, vec_id long, v binary")
    asked = made.queries.select("vec_id", "v", "cells").mapInArrow(ask, "qgrp int, qchunk int, qblock int, query_id long, v binary")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        qid, did = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        order = np.argsort(did, kind="stable")
        did = did[order]
        x = matrix(right.column("v").to_pylist(), dim)[order]
        q = matrix(left.column("v").to_pylist(), dim)
        out = []
        for i in range(0, len(qid), 256):
            scores = products(q[i : i + 256], x)
            for row, own in zip(scores, qid[i : i + 256], strict=True):
                others = np.flatnonzero(did != own)
                s = row[others]
                if len(s) > k:
                    bound = np.partition(s, len(s) - k)[len(s) - k]
                    keep = np.flatnonzero(s >= bound)
                    others, s = others[keep], s[keep]
                best = np.argsort(-s, kind="stable")[:k]
                out.append((np.full(len(best), own), did[others[best]], s[best]))
        a, b = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array([int(s) for x in out for s in x[2]], pa.int64())})

    found = asked.groupBy("qgrp", "qchunk", "qblock").cogroup(routed.groupBy("grp", "chunk", "block")).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SEARCH_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
