"""Skew-proof operators against brute force on groups that hold most of the rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivalgrid.operators import ranking as rk
from rivalgrid.session import PARTITION_BYTES, partitions_for


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.integers(5)}", int(i), float(rng.integers(20))) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, id long, v double").cache()


def test_row_numbers_match_window(skewed):
    order = [F.col("v").desc(), F.col("id").asc()]
    got = rk.row_numbers_any_size(skewed, ["g"], order).select("id", "rank").toPandas().set_index("id")["rank"]
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).select("id", "rank").toPandas().set_index("id")["rank"]
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_order_of_input_does_not_matter(skewed):
    order = [F.col("v").desc(), F.col("id").asc()]
    a = rk.row_numbers_any_size(skewed, ["g"], order).toPandas().sort_values("id")["rank"].tolist()
    b = rk.row_numbers_any_size(skewed.orderBy(F.rand(3)).repartition(7), ["g"], order).toPandas().sort_values("id")["rank"].tolist()
    assert a == b


def test_percentiles_match_numpy(skewed):
    got = rk.percentiles_any_size(skewed, ["g"], "v", {"p25": 0.25, "p90": 0.9}).toPandas().set_index("g")
    for g, rows in skewed.toPandas().groupby("g"):
        assert got.loc[g, "p25"] == pytest.approx(np.percentile(rows["v"], 25))
        assert got.loc[g, "p90"] == pytest.approx(np.percentile(rows["v"], 90))


def test_cumulative_share(skewed):
    got = rk.cumulative_share(skewed, ["g"], "v", "s").toPandas()
    for _, rows in got.groupby("g"):
        for r in rows.head(20).itertuples():
            assert r.s == pytest.approx((rows["v"] <= r.v).mean())


def test_band_sums(skewed):
    rows = skewed.withColumn("x", F.col("v") / 20).withColumn("one", F.lit(1.0))
    got = rk.band_sums(rows, ["g"], "id", "x", 0.1 + 1e-9, {"one": "n"}).toPandas().set_index("id")["n"]
    pdf = rows.toPandas()
    for r in pdf.head(30).itertuples():
        near = pdf[(pdf["g"] == r.g) & ((pdf["x"] - r.x).abs() <= 0.1 + 1e-9)]
        assert got[r.id] == len(near)


def test_first_row_and_top_n(skewed):
    first = rk.first_row(skewed, ["g"], [(-F.col("v")).alias("a"), F.col("id")]).toPandas().set_index("g")
    top = rk.top_n_any_size(skewed, ["g"], [F.col("v").desc(), F.col("id").asc()], "id", 3).toPandas()
    for g, rows in skewed.toPandas().groupby("g"):
        best = rows.sort_values(["v", "id"], ascending=[False, True])
        assert first.loc[g, "id"] == best["id"].iloc[0]
        assert top[top["g"] == g].sort_values("pos")["id"].tolist() == best["id"].head(3).tolist()


def test_null_keeps_null_rank(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 5.0)], "c string, id int, v double")
    got = {r["id"]: r["rank"] for r in rk.rank_by_category(df, ["c"], "v", ["id"]).collect()}
    assert got == {3: 1, 1: 2, 2: None}


def test_leave_one_out_conventions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "g string, v double")
    rows = {(r["g"], r["v"]): (r["x"], r["y"]) for r in rk.leave_one_out(rk.leave_one_out(df, ["g"], "v", "x"), ["g"], "v", "y", alone=0.0).collect()}
    assert rows == {("a", 1.0): (3.0, 3.0), ("a", 3.0): (1.0, 1.0), ("b", 7.0): (None, 0.0)}


def test_summaries_of_small_and_large_groups(spark):
    """Two groups sort inside a task, one is beyond the limit; a group of NULLs and a NULL group stay."""
    rows = [("a", 1.0), ("a", 4.0), ("b", None), (None, 2.0), (None, 3.0), *[("hot", float(i % 7)) for i in range(50)]]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["mid"], r["p90"]) for r in rk.summaries_any_size(
        df, ["g"], "v", {"mid": 0.5, "p90": 0.9}, {"n": F.count(F.lit(1))}, most=10).collect()}
    hot = np.quantile([i % 7 for i in range(50)], [0.5, 0.9])
    assert got == {"a": (2, 2.5, pytest.approx(3.7)), "b": (1, None, None), None: (2, 2.5, pytest.approx(2.9)), "hot": (50, hot[0], pytest.approx(hot[1]))}


def test_partitions_grow_with_the_input_and_come_back(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    with partitions_for(spark, 100 * PARTITION_BYTES) as n:
        assert n == 100 and spark.conf.get("spark.sql.shuffle.partitions") == "100"
    with partitions_for(spark, 1) as n:
        assert n == int(own)
    assert spark.conf.get("spark.sql.shuffle.partitions") == own
