"""Exact top-k search by inner product, with candidates eliminated by a pivot table.

Vectors become integers, so scores are exact. |q - x|^2 = |q|^2 + |x|^2 - 2 q.x turns a lower bound of
the distance into an upper bound of the score, and each pivot p gives one: |d(q, p) - d(x, p)|. The
largest over many pivots bounds best. A query goes through the candidates of a block in the order of
their upper bounds and stops where the bound falls below its k-th best score.

Queries are compared with all rows in blocks: a block of queries meets a block of candidates in one
task, with bounded memory, and each pair of blocks leaves at most k rows a query. The blocks' results
are merged by partial aggregation. No rows are sampled but the pivots, of which any choice is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, materialize

K = 10
SCALE = 1024
PIVOTS = 48
CANDIDATES_TOGETHER = 16_384
QUERIES_TOGETHER = 1_024
STEP = 256


def quantized(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """__id, __v (floor(scale * x) as doubles, which are whole numbers) and __dim, of valid vectors."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    longest = F.size(x) * F.pow(F.coalesce(F.array_max(F.transform(x, lambda c: F.abs(c * scale))), F.lit(0.0)), 2)
    message = F.concat(F.lit("scores of vector "), F.col(f"`{vec_id}`").cast("string"), F.lit(" don't fit into 64 bits"))
    fits = F.when(longest < 2.0**62, x).otherwise(F.raise_error(message).cast("array<double>"))
    whole = F.transform(fits, lambda c: F.floor(c * scale).cast("double"))
    return vectors.filter(F.col(f"`{embedding}`").isNotNull() & F.col(f"`{vec_id}`").isNotNull() & ~bad).select(F.col(f"`{vec_id}`").cast("long").alias("__id"), whole.alias("__v"), F.size(x).alias("__dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _search(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of the candidates: ids and scores. All numbers are whole."""
    top = max(float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)))
    if top * top * max(1, q.shape[1]) >= 2.0**52:  # doubles would round: whole numbers of any size
        q, x = (np.array([[int(c) for c in r] for r in m], object).reshape(m.shape) for m in (q, x))
        for k_q in range(len(q)):
            score = x.dot(q[k_q]) if len(x) else np.zeros(0, object)
            order = sorted((i for i in range(len(x)) if xid[i] != qid[k_q]), key=lambda i: (-score[i], xid[i]))[:k]
            yield qid[k_q], xid[order], np.array([int(score[i]) for i in order], object)
        return
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    pp = (pivots * pivots).sum(1)
    far = lambda m, mm: np.sqrt(np.maximum(mm[:, None] + pp - 2 * (m @ pivots.T), 0))
    x_far, q_far = far(x, xx), far(q, qq)
    for i in range(len(q)):
        least = np.abs(x_far - q_far[i]).max(1) if len(pivots) else np.zeros(len(x))
        # The square roots round by parts of the norms, also where the bound itself is near zero or negative.
        most = (qq[i] + xx - least * least) / 2 + 1e-9 * (qq[i] + xx + least * least) + 0.5
        order = np.argsort(-most, kind="stable")
        best_s, best_id = np.zeros(0), np.zeros(0, np.int64)
        for start in range(0, len(order), STEP):
            if len(best_s) == k and most[order[start]] < best_s[-1]:
                break
            part = order[start : start + STEP]
            part = part[xid[part] != qid[i]]
            s = np.concatenate([best_s, x[part] @ q[i]])
            ids = np.concatenate([best_id, xid[part]])
            first = np.lexsort((ids, -s))[:k]
            best_s, best_id = s[first], ids[first]
        yield qid[i], best_id, best_s.astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query, ties to the smaller id, never itself.

    is_query is a condition on __id. Vectors that are null or hold nulls or non-finite numbers take no
    part; vectors of different dimensions aren't compared. A vector that is too long for its scores to be sure to
    fit into 64 bits (dimensions times the square of its largest component, scaled, of 2^62) is an error that
    names it. Repeated rows are candidates of their own,
    and a repeated query is answered once. Fewer candidates than k give fewer rows; none give none.
    """
    rows = materialize(quantized(vectors, vec_id, embedding, scale), "vectors")
    n = rows.count()
    queries = rows.filter(is_query).dropDuplicates(["__id"])
    n_blocks = bucket_count(n, CANDIDATES_TOGETHER)
    q_blocks = bucket_count(queries.count(), QUERIES_TOGETHER)
    chosen = rows.orderBy(F.xxhash64("__id"), "__id").limit(pivots).collect()
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(r["__dim"], []).append(r["__v"])
    pivot_table = {d: np.array(v, float).reshape(len(v), d) for d, v in by_dim.items()}

    block = lambda m: F.pmod(F.xxhash64(F.lit("block"), "__id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cands = rows.select("__dim", block(n_blocks).alias("__cb"), every(q_blocks).alias("__qb"), "__id", "__v")
    asked = queries.select("__dim", every(n_blocks).alias("__cb"), block(q_blocks).alias("__qb"), "__id", "__v")

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        found = ([], [], [])
        if q.num_rows and x.num_rows:
            dim = q.column("__dim")[0].as_py()
            part = lambda t: (t.column("__id").to_numpy(), _matrix(t.column("__v").combine_chunks(), dim))
            none = np.zeros((0, dim))
            for i, ids, scores in _search(*part(q), *part(x), pivot_table.get(dim, none), k):
                found[0].extend([i] * len(ids))
                found[1].extend(ids)
                found[2].extend(int(s) for s in scores)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    keys = ["__dim", "__cb", "__qb"]
    near = asked.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
