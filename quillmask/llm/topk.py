"""Exact top-k inner products by columnar branch-and-bound.

Vectors are written once, in blocks, to the shared folder. A task takes a block of queries and reads blocks of rows from there one
after the other, so that no row is sent to any query. A block lies dimension by dimension; scores are accumulated a few dimensions at a
time, and rows that can't reach a query's k-th score any more, by the Cauchy-Schwarz bound on the mass that remains, are compacted away.
The k-th scores carry over from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import batch, materialise, store_of

#: Rows and queries that a task holds at a time; dimensions that are added at once; share of survivors from which on rows are gathered.
ROW_BLOCK, QUERY_BLOCK, DIMENSIONS, SPARSE = 8192, 512, 16, 0.25


class Search:
    """The k best rows of each of some queries of one length, over any number of blocks of rows."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.q, self.own, self.k = queries, own, k
        self.steps = range(0, queries.shape[1], DIMENSIONS)
        self.tails = [np.sqrt((queries[:, at + DIMENSIONS :] ** 2).sum(axis=1)) for at in self.steps]
        self.floor = np.full(len(queries), -np.inf)
        self.scores = [np.zeros(0)] * len(queries)
        self.ids = [np.zeros(0, np.int64)] * len(queries)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[i], scores]), np.concatenate([self.ids[i], ids])
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[-self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[best], ids[best]
        if len(best) == self.k:
            self.floor[i] = self.scores[i][-1]

    def block(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """x: dimensions x rows, ids and row numbers. A query's own row takes no part."""
        tails = [np.sqrt((x[at + DIMENSIONS :] ** 2).sum(axis=0)) for at in self.steps]
        sums = np.zeros((len(self.q), x.shape[1]))
        place = {r: j for j, r in enumerate(rows.tolist())}
        for i, own in enumerate(self.own.tolist()):
            if own in place:
                sums[i, place[own]] = -np.inf
        for step, at in enumerate(self.steps):
            sums += self.q[:, at : at + DIMENSIONS] @ x[at : at + DIMENSIONS]
            if not self.tails[step].any():
                break
            if step == 0 and np.isinf(self.floor).any() and x.shape[1] > self.k:  # whole scores of the best so far are a floor
                best = np.argpartition(-sums, self.k - 1, axis=1)[:, : self.k]
                whole = np.where(np.isinf(np.take_along_axis(sums, best, axis=1)), -np.inf, np.einsum("qd,dqk->qk", self.q, x[:, best]))
                self.floor = np.maximum(self.floor, whole.min(axis=1))
            # a little slack, as norms are rounded
            alive = sums + self.tails[step][:, None] * tails[step] * (1 + 1e-9) + 1e-6 >= self.floor[:, None]
            if alive.mean() < SPARSE:
                for i in range(len(self.q)):
                    self.finish(i, np.flatnonzero(alive[i]), sums[i], x, ids, tails, step + 1)
                return
        for i in range(len(self.q)):
            near = np.flatnonzero((sums[i] >= self.floor[i]) & ~np.isinf(sums[i]))
            self.add(i, sums[i, near], ids[near])

    def finish(self, i: int, alive: np.ndarray, sums: np.ndarray, x: np.ndarray, ids: np.ndarray, tails: list[np.ndarray], step: int) -> None:
        """One query's survivors to the last dimension, fewer from step to step."""
        alive = alive[~np.isinf(sums[alive])]
        scores = sums[alive]
        for n, at in list(enumerate(self.steps))[step:]:
            if not len(alive):
                return
            scores = scores + self.q[i, at : at + DIMENSIONS] @ x[at : at + DIMENSIONS, alive]
            keep = scores + self.tails[n][i] * tails[n][alive] * (1 + 1e-9) + 1e-6 >= self.floor[i]
            alive, scores = alive[keep], scores[keep]
        self.add(i, scores, ids[alive])


def blocks(folder: str, files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors in columns, ids, row numbers) of the written rows, those of one length at a time."""
    store, path = store_of(folder)
    for name in files:
        with store.open_input_file(f"{path}/{name}") as f:
            for b in pq.ParquetFile(f).iter_batches(ROW_BLOCK, columns=["row", "vec_id", "v"]):
                v = b.column("v")
                ends = np.asarray(v.offsets)
                flat, sizes = np.asarray(v.values), np.diff(ends)
                for d in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == d)
                    yield np.ascontiguousarray(flat[ends[at][None, :] + np.arange(d)[:, None]]), np.asarray(b.column("vec_id"))[at], np.asarray(b.column("row"))[at]


def _ask(folder: str, files: list[str], parts: int, k: int):
    """(part, row, vec_id, v), sorted by part -> each query's k best among every parts-th file from `part` on."""
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answers(rows: list[tuple]) -> pa.RecordBatch:
        found = {}
        by_size: dict[int, list[tuple]] = {}
        for r in rows:
            by_size.setdefault(len(r[3]), []).append(r)
        for d, own in by_size.items():
            found[d] = Search(np.array([r[3] for r in own], np.float64), np.array([r[1] for r in own]), k)
        for x, ids, numbers in blocks(folder, files[rows[0][0] :: parts]):
            if len(x) in found:
                found[len(x)].block(x, ids, numbers)
        out = [(r[1], r[2], i, s) for d, own in by_size.items() for r, ids, scores in zip(own, found[d].ids, found[d].scores) for i, s in zip(ids.tolist(), scores.astype(np.int64).tolist())]
        return batch(schema, *(list(map(list, zip(*out))) or [[], [], [], []]))

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and (held[0][0] != r[0] or len(held) == QUERY_BLOCK):
                    yield answers(held)
                    held = []
                held.append(r)
        if held:
            yield answers(held)

    return fn


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, the k largest inner products with other rows.

    Components become floor(scale * x); scores are exact while they stay below 2**53. Ties go to the smaller vec_id. Vectors that are
    null, empty or hold a null or non-finite component, and rows without vec_id, take no part; only vectors of equal length meet. Rows
    that repeat a vec_id are rows of their own: each asks, and each answers all but itself. Fewer than k other rows: all of them. Other
    columns are ignored. The shared folder must be one that pyarrow.fs opens on executors.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    # the number is written with its row, so that every reader sees the same
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    if not rows.known_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    asked = rows.where(F.col("vec_id") % every == 0)
    cores, n = spark.sparkContext.defaultParallelism, asked.count()
    # blocks of queries; where these are fewer than cores, the files of rows are dealt out as well
    groups = max(-(-n // QUERY_BLOCK), min(cores, -(-n // 64)), 1)
    parts = min(len(rows.files), max(1, cores // groups))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    asked = asked.repartition(groups * parts, "part", "group").sortWithinPartitions("part").select("part", "row", "vec_id", "v")
    found = asked.mapInArrow(_ask(rows.folder, rows.files, parts, k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
