"""A cross-section of registered queries beside their SQL on the smallest tables, and the contract."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a60_allowed_table", "a10_matchup_index", "w01_rank_entities", "a39_collapse_variants", "a37_promote_best_failed", "a36_consolidate_prices", "a44_team_tendencies",
          "j07_asof_rank", "m02_nearest_neighbours", "w08_confidence", "a27_scored_plays", "w15_value_above_free", "x07_leverage", "k02_status_stream", "k07_frozen_estimates",
          "s09_ranking_documents", "s24_tenant_overwrite", "j05_resolve_identity", "p14_score_rows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def cell(v):
        return "~" if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    listed = ", ".join(columns)
    want = con.execute(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_every_sql_twin_binds(con):
    for name, sql in entry.oracle_sql().items():
        con.execute("EXPLAIN " + sql)
        assert name in entry.queries()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plan_prunes_columns_and_pushes_filters(spark):
    plan = entry.queries()["s22_column_subset"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
