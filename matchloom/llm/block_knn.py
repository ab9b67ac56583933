"""Exact nearest neighbours by inner product, as a block matrix join with int8 tiles.

Queries and candidates are packed into tiles, matrices of a bounded size in one row of a table.
Tiles of queries are dealt into blocks and tiles of candidates into groups, each of bounded bytes, and every pair of
a block and a group is one task's work: a cogrouped join on the two numbers. No vector passes
through the driver. A vector ``x`` is held as ``scale * q + e`` with ``q`` in int8, so a
tile of products of int8 vectors gives each inner product up to an error that the norms of
the parts bound:

    ``|<x, y> - sx sy <qx, qy>| <= |x'| |ey| + |ex| |y'| + |ex| |ey|``

where ``x'`` is the quantised vector. Pairs whose upper bound stays under the query's k-th best
so far are dropped; the rest are computed again from the original components in double
precision, one component after the other, and merged into the query's heap. Each pair of block and
group returns k rows a query at most, and these are merged by a window over the query.

Equal vectors within a tile are looked at once for all: only the ``k + 1`` smallest ids of a
group can be among a query's k nearest, so the rest are set aside without loss.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component
take no part, as query or candidate; vectors of another length than the query's are no
candidates of it; ties go to the smaller id; rows with the query's own id are left out;
rows that repeat an id are candidates each,
and of queries that repeat an id the one whose vector sorts first counts; a product beyond the largest double is
infinite, and one that is not a number (of infinite parts of both signs) counts as negative infinity; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Candidates and queries of a tile of products; a tile takes 16 MB a matrix.
TILE, QUERY_TILE = 4096, 512
#: Bytes of a tile as it is packed, of the queries of a block and of the candidates of a group.
TILE_BYTES, QUERY_BLOCK_BYTES, GROUP_BYTES = 4_000_000, 32_000_000, 32_000_000


class Tile:
    """Vectors of one length with their int8 parts and error norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.v = ids, vectors.astype(np.float64)
        peak = np.abs(self.v).max(1)
        self.scale = peak / 127.0
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            self.q = np.rint(self.v / self.scale[:, None]).astype(np.int8)
            part = self.q * self.scale[:, None]
            self.norm = np.sqrt((part**2).sum(1))
            self.error = np.sqrt(((self.v - part) ** 2).sum(1)) * (1 + 1e-9) + 1e-300

    def take(self, at: np.ndarray) -> "Tile":
        return Tile(self.ids[at], self.v[at])


def products(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of all pairs and a bound on their errors."""
    total = np.zeros((len(a.ids), len(b.ids)))
    for s in range(0, a.q.shape[1], 1024):  # sums of 1024 products of int8 are exact in float32
        total += a.q[:, s : s + 1024].astype(np.float32) @ b.q[:, s : s + 1024].astype(np.float32).T
    total *= a.scale[:, None] * b.scale
    bound = a.norm[:, None] * b.error + a.error[:, None] * (b.norm + b.error)
    bound += 1e-12 * (a.norm + a.error)[:, None] * (b.norm + b.error)  # rounding
    return total, bound


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, component by component in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _valid(ids: np.ndarray, values: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors that take part, for each length."""
    by: dict[int, list[int]] = {}
    for i, x in enumerate(values):
        if x is not None and len(x):
            by.setdefault(len(x), []).append(i)
    for _, at in sorted(by.items()):
        matrix = np.array([np.asarray(values[i], np.float64) for i in at])
        ok = np.isfinite(matrix).all(1) & (matrix != 0).any(1) & ~pd.isna(ids[at])
        if ok.any():
            yield ids[at][ok].astype(np.int64), matrix[ok]


class Heaps:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: Tile, k: int) -> None:
        self.queries, self.k = queries, k
        n = len(queries.ids)
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, tile: Tile) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            near, bound = products(self.queries, tile)
            sure = np.isfinite(near) & np.isfinite(bound)  # other pairs set no floor, and all go on to be recomputed
            own = self.queries.ids[:, None] == tile.ids
            floor = self.score[:, -1]
            if near.shape[1] > self.k:
                low = np.where(own | ~sure, -np.inf, near - bound)
                floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
            qi, ci = np.nonzero((~sure | (near + bound >= floor[:, None])) & ~own)
            if not len(qi):
                return
            found = exact(self.queries.v[qi], tile.v[ci])
        found = np.where(np.isnan(found), -np.inf, found)
        # Merge: old and new entries by query, best first, and the first k of each query.
        rows = np.concatenate([np.repeat(np.arange(len(self.score)), self.k), qi])
        score, ids = np.concatenate([self.score.ravel(), found]), np.concatenate([self.id.ravel(), tile.ids[ci]])
        order = np.lexsort((ids, -score, rows))
        rows, score, ids = rows[order], score[order], ids[order]
        start = np.searchsorted(rows, np.arange(len(self.score)))
        best = start[:, None] + np.arange(self.k)
        self.score, self.id = score[best], ids[best]


def few_copies(tile: Tile, k: int) -> Tile:
    """Of equal vectors, the ``k + 1`` smallest ids."""
    order = np.argsort(tile.ids, kind="stable")
    keys = np.ascontiguousarray(tile.v[order]).view(np.dtype((np.void, tile.v.shape[1] * 8))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    by = np.argsort(group, kind="stable")
    nth = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    kept = order[by[nth <= k]]
    return tile if len(kept) == len(order) else tile.take(np.sort(kept))


PACKED = "tile long, size int, ids binary, vectors binary"


def packed(df: DataFrame, rows: int, copies: int | None = None) -> DataFrame:
    """The vectors of ``(id, v)`` that take part, as tiles of one length each: at most ``rows`` vectors and about ``TILE_BYTES``.

    With ``copies``, a tile keeps only so many of the smallest ids of equal vectors, and one more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def tile(size: int) -> pd.DataFrame:
            nonlocal made
            whole = Tile(*(np.concatenate(x) for x in zip(*held.pop(size), strict=True)))
            whole = whole if copies is None else few_copies(whole, copies)
            made += 1
            return pd.DataFrame({"tile": [task << 32 | made], "size": [size], "ids": [whole.ids.astype("<i8").tobytes()], "vectors": [whole.v.astype("<f8").tobytes()]})

        for batch in batches:
            for ids, matrix in _valid(batch["id"].to_numpy(object), batch["v"].tolist()):
                size = matrix.shape[1]
                most = max(1, min(rows, TILE_BYTES // (8 * size)))
                for s in range(0, len(ids), most):
                    part = ids[s : s + most], matrix[s : s + most]
                    if size in held and sum(len(x) for x, _ in held[size]) + len(part[0]) > most:
                        yield tile(size)
                    held.setdefault(size, []).append(part)
        for size in list(held):
            yield tile(size)

    return df.mapInPandas(run, PACKED)


def _tile(row) -> Tile:
    return Tile(np.frombuffer(row.ids, "<i8"), np.frombuffer(row.vectors, "<f8").reshape(-1, row.size))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = QUERY_BLOCK_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Return ``(query_id, rank, id, score)``: for each query its ``k`` nearest rows of ``vectors``."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    once = pick(queries).where(F.col("id").isNotNull() & finite).groupBy("id").agg(F.min("v").alias("v"))
    asked = staged(packed(once, QUERY_TILE), "queries")
    tiles = staged(packed(pick(vectors), TILE, k), "tiles")

    def parts(df: DataFrame, each: int, least: int) -> int:
        r = df.agg(F.sum(F.octet_length("vectors")).alias("bytes"), F.count("*").alias("tiles")).first()
        return max(1, -(-(r["bytes"] or 0) // each), min(least, r["tiles"]))

    blocks, groups = parts(asked, block_bytes, 1), parts(tiles, group_bytes, spark.sparkContext.defaultParallelism)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")
    left = asked.withColumn("block", dealt(blocks)).withColumn("group", spread(groups))
    right = tiles.withColumn("group", dealt(groups)).withColumn("block", spread(blocks))

    def meet(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        heaps = [Heaps(_tile(r), k) for r in ours.itertuples()]
        for r in theirs.itertuples():
            candidates = _tile(r)
            for h in heaps:
                if h.queries.v.shape[1] == r.size:
                    h.offer(candidates)
        ok = [h.id != np.iinfo(np.int64).max for h in heaps]
        joined = lambda each, kind: np.concatenate([np.zeros(0, kind), *each])
        return pd.DataFrame(
            {
                "query_id": joined([np.repeat(h.queries.ids, k)[o.ravel()] for h, o in zip(heaps, ok, strict=True)], np.int64),
                "id": joined([h.id[o] for h, o in zip(heaps, ok, strict=True)], np.int64),
                "score": joined([h.score[o] for h, o in zip(heaps, ok, strict=True)], np.float64),
            }
        )

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(meet, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
