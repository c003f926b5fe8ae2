"""Exact top-k inner products with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, spread

#: Cells of each dimension (4 bits), candidates and queries of a pair of blocks.
CELLS = 16
CANDIDATES = 16_384
QUERIES = 2_048
#: Exact vectors are read this many at a time, best bound first.
READ = 32


def grid(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``vec_id, v array<double>``: components floor(scale * x). Vectors that are null or hold null, NaN or infinite components take no part; neither do null ids."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.col(vec_id).isNotNull()
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def approximate(matrix: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximation file of a block: cell numbers (uint8), and each dimension's lowest value and cell width."""
    low = matrix.min(axis=0)
    width = np.maximum((matrix.max(axis=0) - low) / cells, 1e-9)
    return np.minimum((matrix - low) / width, cells - 1).astype(np.uint8), low, width


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The block's k best (query_id, vec_id, score) of each query, by score then smaller id, own id left out.

    The scan of the cells bounds each score from both sides: a cell's centre
    gives the middle, half a cell's width in each dimension the slack. The
    exact vectors are then read in order of the better bound, until the next
    bound is below the kth exact score. Components beyond a shorter vector's
    end count as zero. Products are integers in doubles, exact below 2^53.
    """
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    cell, low, width = approximate(matrix)
    centre = low + (cell + 0.5) * width
    out = []
    for at in range(0, len(queries), 128):
        part = queries[at : at + 128]
        middle = part @ centre.T
        slack = np.abs(part) @ (0.5 * width) + 1e-6
        for qid, q, mid, s in zip(query_ids[at : at + 128], part, middle, slack, strict=True):
            mid[ids == qid] = -np.inf
            keep = min(k, len(mid))
            floor_ = np.partition(mid, len(mid) - keep)[len(mid) - keep] - s
            near = np.flatnonzero((mid + s >= floor_) & (mid > -np.inf))
            near = near[np.argsort(-mid[near], kind="stable")]
            best_ids, best = np.empty(0, dtype=np.int64), np.empty(0)
            for lo in range(0, len(near), max(READ, k)):
                batch = near[lo : lo + max(READ, k)]
                if len(best) >= k and mid[batch[0]] + s < best[k - 1]:
                    break
                all_ids, scores = np.concatenate([best_ids, ids[batch]]), np.concatenate([best, matrix[batch] @ q])
                top = np.lexsort((all_ids, -scores))[:k]
                best_ids, best = all_ids[top], scores[top]
            out += [(int(qid), int(i), int(x)) for i, x in zip(best_ids, best, strict=True)]
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    if all(len(v) == width for v in column):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width))
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 20, candidates: int = CANDIDATES, queries_per_block: int = QUERIES, **options) -> DataFrame:
    """Each query's k highest inner products: ``query_id, rank, vec_id, score``; ties go to the smaller vec_id.

    ``vectors`` are hashed into blocks of about ``candidates`` rows, the rows
    that meet ``queries`` (a condition on ``vec_id``) into blocks too; every
    pair of blocks is one group, searched by ``search_block`` and merged per
    query. Block sizes bound each group's memory. Every row with another id
    than the query's is a candidate, repeated rows each; repeated queries are
    asked once. Fewer candidates than k: all of them. No queries: no rows.
    """
    rows = materialise(grid(vectors, **options), "va-grid")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(queries).alias("q"), F.max(F.size("v")).alias("d")).first()
    blocks, asks = max(1, -(-sizes.n // candidates)), max(1, -(-sizes.q // queries_per_block))
    width = max(sizes.d or 1, 1)
    left = rows.withColumns({"cb": spread("vec_id", blocks).cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))})
    right = asked.withColumns({"qb": spread("vec_id", asks).cast("int"), "cb": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def search(block: pd.DataFrame, asks_: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(asks_):
            found = search_block(asks_.vec_id.to_numpy(), _matrix(asks_.v, width), block.vec_id.to_numpy(), _matrix(block.v, width), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    pairs = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
