"""Exact neighbours against brute force: equal vectors, a category with most rows, tiny blocks."""

import numpy as np
from pyspark.sql import functions as F

from rivalgrid.operators.models import fit_interest, fit_price
from rivalgrid.operators import neighbours as nb
from rivalgrid.operators.neighbours import nearest, within_cutoff


def brute(rows, k):
    out = {}
    for i, c, v in rows:
        near = sorted((round(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), 9), j) for j, d, w in rows if d == c and j != i)
        out[i] = near[:k]
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        hot = i % 3 == 0
        vec = [0.5, 0.5, 0.5] if hot else [float(x) for x in rng.integers(0, 6, 3) / 5]
        rows.append((i, "big" if i % 10 else "small", vec))
    df = spark.createDataFrame(rows, "id long, category string, vec array<double>")
    got = nearest(df, df, 4, skip_self=True, pivots=5, block=32).toPandas()
    want = brute(rows, 4)
    for qid, part in got.groupby("qid"):
        part = part.sort_values("pos")
        assert list(zip(part["dist"], part["id"])) == want[qid]
    assert got["qid"].nunique() == 400


def test_small_pool_returns_all(spark):
    df = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0])], "id long, category string, vec array<double>")
    got = nearest(df, df, 5, skip_self=True).toPandas()
    assert sorted(zip(got["qid"], got["id"])) == [(1, 2), (2, 1)]


def test_cutoff_keeps_the_nearest(spark):
    near = spark.createDataFrame([("a", 1, 5, 3.0, 1), ("a", 1, 6, 4.0, 2)], "category string, qid long, id long, dist double, pos int")
    cut = spark.createDataFrame([("a", 1.0)], "category string, cutoff double")
    assert [r["id"] for r in within_cutoff(near, cut).collect()] == [5]


def test_price_fit_is_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = np.expm1(np.abs(0.3 + x @ [0.2, -0.1]))
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, target double")
    model = fit_price(df, ["a", "b"])
    want = np.linalg.lstsq(np.c_[x, np.ones(200)], np.log1p(y), rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], want, atol=1e-6)


def test_interest_fit_has_zero_gradient(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, label double")
    model, stats = fit_interest(df, ["a", "b"])
    z = np.c_[[(x[:, i] - stats[f][0]) / stats[f][1] for i, f in enumerate("ab")]].T
    w = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(z @ w + model.intercept)))
    assert np.allclose(z.T @ (p - y) + w, 0, atol=1e-2)
    assert abs((p - y).sum()) < 1e-2
    assert df.select(F.count("*")).first()[0] == 300


def test_cells_of_few_rows_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x = rng.normal(size=2)
        vec = [0.5] * 4 if i % 7 == 0 else [float(np.round(x[0], 1)), float(x[1]), float(x[0] + x[1]), float(i % 3)]
        rows.append((i, "big" if i % 10 else "small", vec))
    df = spark.createDataFrame(rows, "id long, category string, vec array<double>")
    got = nearest(df, df, 4, skip_self=True, block=32, cell=16).toPandas()
    want = brute(rows, 4)
    assert got["qid"].nunique() == 600
    for qid, part in got.groupby("qid"):
        part = part.sort_values("pos")
        assert list(zip(part["dist"], part["id"])) == want[qid]


def test_cells_a_query_visits_do_not_grow_with_the_pool():
    """With four times the rows and cells of one size, a query's k-th distance still reaches a few boxes only."""
    visits = {}
    for n in (4000, 16000):
        rows = np.random.default_rng(6).normal(size=(n, 3))
        tree = nb.cut_space(rows, 64)
        cells = nb.cell_of(tree, rows)
        ids = np.unique(cells)
        assert np.bincount(cells).max() <= 64
        low, high = (np.array([f(rows[cells == c], axis=0) for c in ids]) for f in (np.min, np.max))
        asking = rows[::200]
        bound = np.sort(np.sqrt(np.square(asking[:, None] - rows[None]).sum(axis=2)), axis=1)[:, 5]
        i, box = nb.cells_within(asking, bound, low, high)
        assert all((cells[np.sqrt(np.square(rows - q).sum(axis=1)) <= b][:, None] == ids[box[i == at]]).any(axis=1).all() for at, (q, b) in enumerate(zip(asking, bound)))
        visits[n] = len(i) / len(asking)
    assert visits[16000] < 1.5 * visits[4000] < 20
