"""Approximate nearest neighbours by collision-counting hashing with virtual rehashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, integral, materialise, spread

#: Vectors of one index. Smaller tables are dealt into as many indexes as there are shuffle partitions, of LEAST vectors at least.
INDEX = 16_384
LEAST = 1_024
#: Hash functions (projections), half width of a window at radius 1, and growth of the radius from round to round.
PROJECTIONS = 64
HALF_WIDTH = 1.0
GROWTH = 1.2
#: The collision threshold lies this many standard deviations under the count expected at the radius.
DEVIATIONS = 2.3
SEED = 42


def threshold(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, deviations: float = DEVIATIONS) -> int:
    """Collisions that make a vector a candidate: a vector at the radius has fewer with a probability of about 1 %."""
    p = math.erf(half_width / math.sqrt(2))
    return max(1, math.floor(projections * p - deviations * math.sqrt(projections * p * (1 - p))))


def directions(width: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """The hash functions: standard normal directions, the same in all tasks."""
    return np.random.default_rng(seed).standard_normal((width, projections))


class Index:
    """Vectors with one sorted array for each projection.

    At radius R a vector collides with a query in a projection if their
    values differ by at most HALF_WIDTH x R. Growing R only widens the
    query-centred windows on the sorted arrays, so one index serves all radii
    (virtual rehashing) and each round counts only what is newly inside.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.axes = ids[order], vectors[order], axes
        values = self.vectors @ axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(values.T, self.order, axis=1)
        # a scale only: half the typical distance of two vectors at the start of the ladder is narrow, at its end all is inside
        spread_ = float(values.std(axis=0).mean()) * math.sqrt(2)
        self.first = max(spread_, 1e-30) / 16
        self.least = threshold(axes.shape[1])

    def _radii(self, at: np.ndarray) -> np.ndarray:
        """The radii of the rounds: growing from the index's first until the windows hold all vectors."""
        far = max(float((at - self.values[:, 0]).max()), float((self.values[:, -1] - at).max()), self.first)
        rounds = max(1, math.ceil(math.log(far / HALF_WIDTH / self.first) / math.log(GROWTH)) + 1)
        return self.first * GROWTH ** np.arange(rounds + 1)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, own id left out.

        A vector whose collisions reach the threshold is verified: its exact
        distance is taken. The radius grows until the kth distance is within
        it, or until all vectors are verified.
        """
        n = len(self.ids)
        at = query @ self.axes
        radii = self._radii(at)
        # where each round's windows begin and end in every sorted array
        lower = np.array([np.searchsorted(v, x - HALF_WIDTH * radii) for v, x in zip(self.values, at, strict=True)])
        upper = np.array([np.searchsorted(v, x + HALF_WIDTH * radii, side="right") for v, x in zip(self.values, at, strict=True)])
        collisions = np.zeros(n, dtype=np.int64)
        verified = self.ids == query_id
        ids, distances = np.zeros(0, dtype=np.int64), np.zeros(0)
        for r, radius in enumerate(radii):
            if r:
                fresh = [o[a:b] for o, a, b in zip(self.order, lower[:, r], lower[:, r - 1])] + [o[a:b] for o, a, b in zip(self.order, upper[:, r - 1], upper[:, r])]
            else:
                fresh = [o[a:b] for o, a, b in zip(self.order, lower[:, 0], upper[:, 0])]
            collisions += np.bincount(np.concatenate(fresh), minlength=n)
            near = np.flatnonzero((collisions >= self.least) & ~verified)
            if len(near):
                verified[near] = True
                ids = np.concatenate([ids, self.ids[near]])
                distances = np.concatenate([distances, np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))])
                best = np.lexsort((ids, distances))[:k]
                ids, distances = ids[best], distances[best]
            if len(ids) >= k and distances[-1] <= radius:
                break
        return ids, distances


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v array<double>``: rows with an id and a vector that isn't null, zero, or holding null or non-finite components."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists(x, lambda e: e != 0)
    return vectors.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & fine).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The batch's vectors as rows; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(column), width))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", index: int = INDEX) -> DataFrame:
    """The k nearest found of each query by Euclidean distance: ``query_id, rank, vec_id, score``.

    ``queries`` is a condition on ``vec_id``. All rows are hashed into
    indexes of about ``index`` vectors. Each task receives the vectors of an
    index, sorted before the queries, builds it, and then answers the queries
    as they stream in; only the queries are copied, once for each index, and
    a task holds one index and one batch of queries. Every index searches
    until its own kth distance is within its radius, the results are merged
    by distance, then by smaller id.

    Every row with another id than the query's is a candidate, repeated rows
    each; repeated query rows are asked once. Vectors shorter than the
    longest are taken to end in zeros. Fewer candidates than k: all of them.
    No vectors or no queries: no rows.
    """
    integral(vectors, vec_id)
    rows = materialise(usable(vectors, vec_id, vector), "collision-vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-sizes.n // index), min(tasks, sizes.n // LEAST))
    width = max(sizes.d or 1, 1)
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    held = rows.select(spread("vec_id", blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = directions(width)
        block, parts, built = None, [], None
        for batch in batches:
            blocks_, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            ids, matrix = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)
            edges = np.flatnonzero(np.diff(blocks_) | np.diff(kinds)) + 1
            found = []
            for lo, hi in zip([0, *edges], [*edges, len(ids)], strict=True):
                if blocks_[lo] != block:
                    block, parts, built = blocks_[lo], [], None
                if kinds[lo] == 0:
                    parts.append((ids[lo:hi], matrix[lo:hi]))
                    continue
                if built is None and parts:
                    built, parts = Index(np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts]), axes), []
                if built is not None:
                    for query_id, query in zip(ids[lo:hi], matrix[lo:hi], strict=True):
                        found.append((query_id, *built.search(query_id, query, k)))
            if found:
                asks = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asks, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

    both = held.unionAll(sent).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    found = materialise(both.mapInArrow(search, "query_id long, vec_id long, score double"), "collision-found")
    discard(rows)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
