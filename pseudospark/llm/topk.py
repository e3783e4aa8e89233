"""Exact top-k inner products by columnar branch and bound.

Vectors lie dimension by dimension. For a query, the products of one block of dimensions after another are added up
over the candidates that are left; the norms of what remains of query and candidate bound each final score from both
sides (Cauchy-Schwarz), and candidates whose upper bound is below the k-th best lower bound are compacted away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pseudospark.sources.files import Workspace

DIMENSIONS = 16  # in a block
CANDIDATE_ROWS = 2048
QUERY_ROWS = 512


def _matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(-1, dimensions)


def block_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query id, id, score) of each query's k best vectors of other ids; ties go to the smaller id."""
    n, dimensions = vectors.shape
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, dimensions)
    # Sums below 2^53 are exact in doubles; beyond the range of long, Python's integers take over.
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(vectors[:, order].T.astype(kind))
    asked = queries[:, order].astype(kind)
    starts = list(range(0, dimensions, DIMENSIONS)) or [0]

    def rest(rows: np.ndarray) -> list[np.ndarray]:
        squares = rows.astype(np.float64) ** 2
        return [np.sqrt(squares[a + DIMENSIONS :].sum(axis=0)) for a in starts]

    left, left_asked = rest(columns), rest(asked.T)
    opening = asked[:, :DIMENSIONS] @ columns[:DIMENSIONS]
    for q in range(len(asked)):
        alive = np.flatnonzero(ids != query_ids[q])
        score = opening[q][alive]
        for block, start in enumerate(starts):
            if block:
                score = score + asked[q, start : start + DIMENSIONS] @ columns[start : start + DIMENSIONS][:, alive]
            if len(alive) > k and block + 1 < len(starts):
                slack = (left_asked[block][q] * left[block][alive]) * (1 + 1e-9) + 1e-6
                known = score.astype(np.float64)
                least = np.partition(known - slack, len(alive) - k)[len(alive) - k]
                keep = known + slack >= least - 1e-9 * abs(least)
                alive, score = alive[keep], score[keep]
        values = np.array([int(s) for s in score], dtype=object) if kind is object else score.astype(np.int64)
        best = sorted(zip((-values).tolist(), ids[alive].tolist()))[:k] if kind is object else [
            (-int(values[i]), int(ids[alive[i]])) for i in np.lexsort((ids[alive], -values))[:k]
        ]
        for negative, id in best:
            yield int(query_ids[q]), id, max(-(2**63), min(2**63 - 1, -negative))


def _blocks(k: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(queries) and len(vectors):
            dimensions = queries["dimensions"][0].as_py()
            rows = list(
                block_top(
                    _matrix(queries["components"], dimensions) if dimensions else np.zeros((len(queries), 0)),
                    queries["vec_id"].to_numpy(),
                    _matrix(vectors["components"], dimensions) if dimensions else np.zeros((len(vectors), 0)),
                    vectors["vec_id"].to_numpy(),
                    k,
                )
            )
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return search


def top_inner_products(
    vectors: DataFrame, workspace: Workspace, *, query_modulus: int, k: int = 5, scale: float = 256.0
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best scores of each query (an id divisible by ``query_modulus``).

    Components x of ``vectors`` (``vec_id, embedding``) become floor(scale * x), as double; a score is the inner product.
    Candidates are all rows of other ids and the same number of components; ties go to the smaller id. Vectors that are
    null or hold null or non-finite components take no part, nor do rows without id. Rows that repeat id and vector count
    once; an id with several vectors is one query and one candidate for each, an own vector is never a candidate, and
    the query's best k are taken over all its vectors. Other columns are ignored; an empty table gives no rows. Scores
    beyond the range of long are cut to it.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    parts = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .where(whole)
        .select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("components"))
        .distinct()
    )
    parts = workspace.save(parts.withColumn("dimensions", F.size("components")), "components")
    asked = F.col("vec_id") % query_modulus == 0
    n, q = parts.select(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-q // QUERY_ROWS))
    spread = F.xxhash64("vec_id", "components")
    # Each block of queries meets each block of candidates in a group of its own, of bounded size.
    left = (
        parts.where(asked)
        .withColumn("query_block", F.pmod(spread, F.lit(query_blocks)))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    )
    right = parts.withColumn("block", F.pmod(spread, F.lit(blocks))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>"))
    )
    keys = ["dimensions", "query_block", "block"]
    names = [*keys, "vec_id", "components"]
    found = (
        left.select(*names)
        .groupBy(*keys)
        .cogroup(right.select(*names).groupBy(*keys))
        .applyInArrow(_blocks(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
