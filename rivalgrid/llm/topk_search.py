"""Exact top-k by inner product: sorted lists without random access.

Every dimension of a block of candidates is a list sorted by value. A query reads each list from the
end that its own sign makes best, all lists to the same depth. A component not yet read is at most
the last value read from its list (the frontier) and at least the list's worst value, so each
candidate has an upper and a lower bound. Reading stops when no candidate outside could still reach
the k-th best lower bound; the scores of those inside are then resolved in full.

Bounds of a whole block are matrix products: with frontiers f (top) and g (bottom), the upper bound
of x is q+ . where(x >= f, x, f) + q- . where(x <= g, x, g), and the lower bound has the list's worst
value in the place of the frontier. Depth doubles from one reading to the next, and queries that
are done leave.

Rows are dealt to blocks by a hash of their content and position key, of a size that does not grow
with the table; a task holds one block of candidates and one of queries. The number of pairs of
blocks is the work that is asked for: all queries against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES, FIRST_DEPTH = 8192, 4096, 0.25


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which all sums of products are exact integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def read_lists(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query row, candidate rows) with every candidate that can be among the query's k best."""
    n = len(x)
    order = np.sort(x, axis=0)
    worst, best = order[0], order[-1]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    live = np.arange(len(q))
    depth = max(k + 1, int(n * FIRST_DEPTH))
    while len(live):
        if depth >= n:
            for i in live:
                yield i, np.arange(n)
            return
        top, bottom = order[n - depth], order[depth - 1]
        read_top, read_bottom = x >= top, x <= bottom
        upper = plus[live] @ np.where(read_top, x, top).T + minus[live] @ np.where(read_bottom, x, bottom).T
        lower = plus[live] @ np.where(read_top, x, worst).T + minus[live] @ np.where(read_bottom, x, best).T
        own = q_id[live][:, None] == x_id[None, :]
        lower[own] = -np.inf
        upper[own] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(live), -np.inf)
        inside = upper >= kth[:, None]
        few = inside.sum(axis=1) <= max(2 * k, n // 8)
        for i in np.flatnonzero(few):
            yield live[i], np.flatnonzero(inside[i])
        live = live[~few]
        depth *= 2


def best_of_block(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of the block for each query, exact scores, ties to the smaller id."""
    kind = _exact_type(q, x)
    if kind is object:
        q, x = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(x)
        score = q.dot(x.T)
        score = np.where(q_id[:, None] == x_id[None, :], None, score)
        out = []
        for i in range(len(q)):
            row = sorted((-s, c) for s, c in zip(score[i], x_id, strict=True) if s is not None)[:k]
            out += [(q_id[i], c, -s) for s, c in row]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    q, x = q.astype(kind), x.astype(kind)
    by_id = np.argsort(x_id, kind="stable")
    x, x_id = x[by_id], x_id[by_id]
    parts = []
    whole: list[int] = []

    def keep(i: int, rows: np.ndarray, score: np.ndarray) -> None:
        ok = x_id[rows] != q_id[i]
        rows, score = rows[ok], score[ok]
        if len(rows) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            near = np.flatnonzero(score >= kth)
            rows, score = rows[near], score[near]
        first = np.argsort(-score, kind="stable")[:k]
        parts.append((np.full(len(first), q_id[i]), x_id[rows[first]], score[first].astype(np.int64)))

    for i, rows in read_lists(q, q_id, x, x_id, k):
        if len(rows) == len(x):
            whole.append(i)
        else:
            keep(i, rows, x[rows] @ q[i])
    for at in range(0, len(whole), 256):
        some = whole[at:at + 256]
        for i, score in zip(some, q[some] @ x.T, strict=True):
            keep(i, np.arange(len(x)), score)
    if not parts:
        return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.int64)})
    return pd.DataFrame({n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(("query_id", "vec_id", "score"))})


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id, v (floor(scale * component) as doubles): vectors NULL or with a NULL or non-finite component,
    and rows without an id, are left out."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def top_k(
    df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding",
    rows: int = ROWS, queries: int = QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``.

    Scores are inner products of integer vectors; ties go to the smaller vec_id. A row is no candidate
    for a query of its own id. Only vectors of the query's length are its candidates. A query without
    candidates has no rows; an empty table gives an empty table. Repeated rows are candidates each.
    """
    vectors = integer_vectors(df, vec_id, vector, scale).withColumn("d", F.size("v"))
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    row_blocks, query_blocks = max(1, math.ceil(n / rows)), max(1, math.ceil(n_queries / queries))
    spread = F.xxhash64("id", "v", F.monotonically_increasing_id())
    candidates = (
        vectors.withColumn("rb", F.pmod(spread, F.lit(row_blocks)).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    asked = (
        vectors.where(F.col("id") % every == 0).withColumn("qb", F.pmod(spread, F.lit(query_blocks)).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))))
    keys = ["d", "rb", "qb"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.int64)})
        q, x = np.stack(right["v"].to_list()), np.stack(left["v"].to_list())
        return best_of_block(q, right["id"].to_numpy(), x, left["id"].to_numpy(), k)

    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
