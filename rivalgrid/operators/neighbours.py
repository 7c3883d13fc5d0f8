"""Exact nearest neighbours within a category.

The space is cut into cells of a few hundred rows by planes across the principal axes, fitted on a
bounded sample. A query looks into its own cell first; the k-th distance found there bounds all others, and
it visits only cells whose box around their rows can hold something closer. Where rows lie along few
axes that is a handful of cells, however many there are. Cells and their visitors are cut into blocks of a fixed
size; one task compares one block of rows with one block of queries and returns k candidates per query, so
neither a big category nor a big cell lands in one task, and pairs are never written out. Of
equal vectors only the smallest ids can be among the nearest, so a run of them is a few rows.

Inside a block most pairs are never measured: along the principal axes, in growing groups, a lower bound
of the distance rules them out (``close_pairs``). The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.session import cut_lineage

DIGITS = 9
_SLACK = 1e-6
# Boxes bound distances along this many axes; beyond that many axes of spread they rule out little.
_BOX_AXES, _FEW_AXES = 16, 16.0
# Sampled rows a cell is fitted on, and in all.
_ROWS_A_CELL, _SAMPLE = 16, 1 << 17


def feature_stats(pool: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population SD per feature (an SD of zero reads as one): one small row."""
    row = pool.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] if (row[f"s_{f}"] or 0.0) > 1e-9 else 1.0) for f in features}


def standardized(stats: dict[str, tuple[float, float]]) -> Column:
    return F.array(*[(F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in stats.items()])


def principal_axes(pool: DataFrame, dims: int) -> tuple[np.ndarray, float, int]:
    """Orthonormal axes of the vectors' scatter, the widest first, over how many axes it is spread, and the number
    of rows: sums of dims x dims numbers per task."""
    def sums(parts):
        total = np.zeros((dims + 1, dims + 1))
        for part in parts:
            rows = np.c_[np.array(part["vec"].tolist()).reshape(-1, dims), np.ones(len(part))]
            total += rows.T @ rows
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    rows = pool.select("vec").mapInPandas(sums, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dims + 1) ** 2)
    for r in rows:
        total[r["at"]] = r["v"]
    total = total.reshape(dims + 1, dims + 1)
    n, mean = total[-1, -1], total[-1, :-1] / max(total[-1, -1], 1.0)
    scatter = total[:-1, :-1] / max(n, 1.0) - np.outer(mean, mean)
    if not np.isfinite(scatter).all():
        return np.eye(dims), float(dims), int(n)
    wide, axes = np.linalg.eigh(scatter)
    wide = np.maximum(wide, 0.0)
    return axes[:, ::-1], float(wide.sum() ** 2 / max(np.square(wide).sum(), 1e-300)), int(n)


def cut_space(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes that cut rows into cells of at most ``most``: axis (-1: a cell), cut and first child of each node.
    The second child follows the first; rows up to the cut go to the first."""
    axis, cut, child, todo = [-1], [0.0], [0], [(0, rows)]
    while todo:
        node, part = todo.pop()
        if len(part) <= most:
            continue
        spread = part.max(axis=0) - part.min(axis=0)
        a = int(spread.argmax())
        if not spread[a] > 0:
            continue
        at = float(np.median(part[:, a]))
        if at >= part[:, a].max():
            at = float(part[part[:, a] < at, a].max())
        low = part[:, a] <= at
        axis[node], cut[node], child[node] = a, at, len(axis)
        axis += [-1, -1]
        cut += [0.0, 0.0]
        child += [0, 0]
        todo += [(len(axis) - 2, part[low]), (len(axis) - 1, part[~low])]
    return np.array(axis), np.array(cut), np.array(child)


def cell_of(tree: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    axis, cut, child = tree
    node = np.zeros(len(rows), dtype=np.int64)
    while True:
        at = np.flatnonzero(axis[node] >= 0)
        if not len(at):
            return node
        here = node[at]
        node[at] = child[here] + (rows[at, axis[here]] > cut[here])


def cells_within(rows: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) pairs whose box may hold something within the row's bound."""
    gap = np.zeros((len(rows), len(low)))
    for d in range(low.shape[1]):
        x = rows[:, d, None]
        gap += np.square(np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0.0))
    slack = _SLACK + 1e-9 * np.abs(rows).max(initial=0.0)
    return np.nonzero(~(gap > np.square(bound + slack)[:, None]))


def _segments(dims: int) -> list[tuple[int, int]]:
    """Axes in growing groups: 4, 4, 8, 16, ... of them."""
    ends, step = [], 4
    while sum(ends) < dims:
        ends.append(min(step, dims - sum(ends)))
        step = sum(ends)
    edges = np.r_[0, np.cumsum(ends)]
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def close_pairs(q: np.ndarray, p: np.ndarray, bound: np.ndarray, k: int, axes: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, row of p, distance) among which are the k nearest of every q within its bound.

    Squared differences along the first axes, and the difference of the lengths along the others, bound a
    distance from below. The bound grows with each group of axes, and pairs beyond the query's own bound,
    or beyond the k-th smallest upper bound seen in this block, are dropped. Only what is left is measured.
    """
    qr, pr = q @ axes, p @ axes
    tol = 1e-10 * (np.square(q).sum(axis=1).max(initial=0.0) + np.square(p).sum(axis=1).max(initial=0.0)) + 1e-8
    most = np.square(bound + 1e-7) + tol
    low = np.zeros((len(q), len(p)))
    alive = np.ones(low.shape, dtype=bool) if same is None else ~same
    i = j = None
    for begin, end in _segments(q.shape[1]):
        qs, ps = qr[:, begin:end], pr[:, begin:end]
        rest_q, rest_p = (np.sqrt(np.square(x[:, end:]).sum(axis=1)) for x in (qr, pr))
        if i is None:
            low += np.maximum(np.square(qs).sum(axis=1)[:, None] + np.square(ps).sum(axis=1)[None, :] - 2.0 * (qs @ ps.T), 0.0)
            if len(p) > k:
                high = np.where(alive, low + np.square(rest_q[:, None] + rest_p[None, :]), np.inf)
                most = np.minimum(most, np.partition(high, k - 1, axis=1)[:, k - 1] + 2 * tol)
            alive &= low + np.square(rest_q[:, None] - rest_p[None, :]) <= most[:, None] + tol
            if alive.mean() < 0.1:
                i, j = np.nonzero(alive)
                left = low[i, j]
        else:
            left = left + np.square(qs[i] - ps[j]).sum(axis=1)
            ok = left + np.square(rest_q[i] - rest_p[j]) <= most[i] + tol
            i, j, left = i[ok], j[ok], left[ok]
    if i is None:
        i, j = np.nonzero(alive)
    total = np.zeros(len(i))
    for d in range(q.shape[1]):
        gap = q[i, d] - p[j, d]
        total += gap * gap
    return i, j, np.round(np.sqrt(total), DIGITS)


def _compare(k: int, skip_self: bool, axes: np.ndarray):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["category", "qid", "id", "dist"]
        if queries.empty or rows.empty:
            return pd.DataFrame({c: [] for c in columns})
        q, p = np.array(queries["vec"].tolist()), np.array(rows["vec"].tolist())
        qids, ids, bound = queries["qid"].to_numpy(), rows["id"].to_numpy(), queries["bound"].fillna(np.inf).to_numpy()
        out = []
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            same = qids[part, None] == ids[None, :] if skip_self else None
            i, j, dist = close_pairs(q[part], p, bound[part], k, axes, same)
            order = np.lexsort((ids[j], dist, i))
            i, j, dist = i[order], j[order], dist[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            ok = place < k
            out.append(pd.DataFrame({"qid": qids[part][i[ok]], "id": ids[j[ok]], "dist": dist[ok]}))
        result = pd.concat(out, ignore_index=True)
        result.insert(0, "category", queries["category"].iloc[0])
        return result[columns]

    return run


def _vectors(part: pd.DataFrame) -> np.ndarray:
    return np.array(part["vec"].tolist(), dtype=float)


def nearest(
    queries: DataFrame, pool: DataFrame, k: int, *, skip_self: bool = False, pivots: int = 64, block: int = 4096, cell: int = 512
) -> DataFrame:
    """The k nearest pool rows of the same category per query: (category, qid, id, dist, pos).

    Inputs carry id, category and vec (equal-length array). Distances are rounded to 9 digits and
    ties go to the smaller id. ``skip_self`` leaves out the pool row with the query's own id. The pool is
    cut into cells of about ``cell`` rows. Where it is spread over many axes boxes rule out little, so there are
    about ``pivots`` cells at most: every query travels to nearly all of them.
    """
    need = k + (1 if skip_self else 0)
    alike = Window.partitionBy("category", "vec").orderBy("id")
    pool = pool.where(F.col("category").isNotNull()).select("category", "id", "vec")
    pool = cut_lineage(pool.withColumn("_copy", F.row_number().over(alike)).where(F.col("_copy") <= need).drop("_copy"))
    queries = queries.where(F.col("category").isNotNull()).select("category", F.col("id").alias("qid"), "vec")
    kinds = {"category": pool.schema["category"].dataType.simpleString(), "qid": queries.schema["qid"].dataType.simpleString(),
             "id": pool.schema["id"].dataType.simpleString(), "vec": "array<double>"}
    shape = f"category {kinds['category']}, qid {kinds['qid']}, id {kinds['id']}, dist double"
    dims = pool.agg(F.max(F.size("vec")).alias("d")).first()["d"]
    if dims is None:
        return pool.sparkSession.createDataFrame([], f"{shape}, pos int")
    axes, spread, n = principal_axes(pool, dims)
    size = cell if spread <= _FEW_AXES else max(cell, n // pivots)
    # the planes come from a sample of a few rows a cell, by the hash of their ids
    share = min(_ROWS_A_CELL / size, _SAMPLE / max(n, 1))
    per_cell = max(int(size * share), 2)
    sample = pool.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).toPandas()
    trees = {c: cut_space(_vectors(part) @ axes, per_cell) for c, part in sample.groupby("category")}
    one_cell = cut_space(np.zeros((0, dims)), 1)

    def place(parts):
        for part in parts:
            if len(part):
                rows, cells = _vectors(part) @ axes, np.zeros(len(part), dtype=np.int64)
                for c, at in part.groupby("category").indices.items():
                    cells[at] = cell_of(trees.get(c, one_cell), rows[at])
                yield part.assign(cell=cells, rot=list(rows[:, :_BOX_AXES]))

    def placed_as(df: DataFrame, key: str) -> DataFrame:
        return df.mapInPandas(place, f"category {kinds['category']}, {key} {kinds[key]}, vec array<double>, cell long, rot array<double>")

    placed = cut_lineage(placed_as(pool, "id"))
    box = range(min(dims, _BOX_AXES))
    found = placed.groupBy("category", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
        F.array(*[F.min(F.col("rot")[d]) for d in box]).alias("low"), F.array(*[F.max(F.col("rot")[d]) for d in box]).alias("high"))
    found = cut_lineage(found)
    cells = found.select("category", "cell", "blocks")
    boxes = {c: (part["cell"].to_numpy(), np.array(part["low"].tolist()), np.array(part["high"].tolist()))
             for c, part in found.select("category", "cell", "low", "high").toPandas().groupby("category")}
    asked = cut_lineage(placed_as(queries, "qid").drop("rot"))

    def compared(visiting: DataFrame) -> DataFrame:
        """Up to k candidates per query and block of the cells it visits."""
        crowd = visiting.groupBy("category", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("qblocks"))
        crowd = cut_lineage(cells.join(crowd, ["category", "cell"]))
        keys = ["category", "cell", "pblock", "qblock"]
        left = visiting.join(crowd, ["category", "cell"]).withColumns({
            "pblock": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
            "qblock": F.pmod(F.xxhash64("qid"), F.col("qblocks")).cast("int")}).select(*[F.col(c).alias(c) for c in (*keys, "qid", "vec", "bound")])
        right = placed.join(crowd, ["category", "cell"]).withColumns({
            "pblock": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"),
            "qblock": F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1))}).select(*[F.col(c).alias(c) for c in (*keys, "id", "vec")])
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(k, skip_self, axes), shape)

    best = Window.partitionBy("category", "qid").orderBy("dist", "id")

    def first_k(candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k)

    # a query's own cell first: what it holds bounds the visits to all others
    near = first_k(compared(asked.withColumn("bound", F.lit(None).cast("double"))))
    if all(len(ids) == 1 for ids, _, _ in boxes.values()):
        return near
    near = cut_lineage(near)
    kth = near.where(F.col("pos") == k).select("category", "qid", F.col("dist").alias("bound"))

    def visit(parts):
        for part in parts:
            for c, at in part.groupby("category").indices.items():
                ids, low, high = boxes.get(c, (np.zeros(0, dtype=np.int64),) * 3)
                for begin in range(0, len(at) if len(ids) > 1 else 0, 256):
                    asking = part.iloc[at[begin:begin + 256]]
                    bound = asking["bound"].fillna(np.inf).to_numpy()
                    i, b = cells_within((_vectors(asking) @ axes)[:, :_BOX_AXES], bound, low, high)
                    other = ids[b] != asking["cell"].to_numpy()[i]
                    yield asking.iloc[i[other]].assign(cell=ids[b[other]])

    again = asked.join(kth, ["category", "qid"], "left").select("category", "qid", "vec", "cell", "bound")
    visits = again.mapInPandas(visit, f"category {kinds['category']}, qid {kinds['qid']}, vec array<double>, cell long, bound double")
    return first_k(near.drop("pos").unionByName(compared(cut_lineage(visits))))


def within_cutoff(neighbours: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Drop neighbours beyond the category's cutoff, but always keep the nearest one."""
    rows = neighbours.join(cutoffs, "category", "left")
    return rows.where(F.col("cutoff").isNull() | (F.col("dist") <= F.col("cutoff")) | (F.col("pos") == 1)).drop("cutoff")
