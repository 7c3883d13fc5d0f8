"""Hand-computed rule cases."""

import pytest

from rivalgrid.functions.scoring import compile_rules, needed_columns, score, validate_rules


def one(spark, row, rules, unit=False):
    df = spark.createDataFrame([tuple(row.values())], list(row))
    return score(df, rules, unit).first()["pts"]


def test_yards_and_touchdown(spark):
    assert one(spark, {"receiving_yards": 15.0, "receiving_tds": 1.0}, [("REY", 0.1), ("RETD", 6.0)]) == pytest.approx(7.5)


def test_null_and_absent_are_zero(spark):
    df = spark.createDataFrame([(None, 3.0)], "receptions double, carries double")
    assert score(df, [("REC", 1.0), ("RA", 0.5), ("PTD", 4.0)]).first()["pts"] == 1.5


@pytest.mark.parametrize("yards,want", [(99, 0), (100, 3), (199, 3), (200, 0)])
def test_bonus_bounds(spark, yards, want):
    assert one(spark, {"rushing_yards": float(yards)}, [("RY100", 3.0)]) == want


def test_steps_floor(spark):
    assert one(spark, {"passing_yards": 74.0}, [("PY25", 1.0)]) == 2


@pytest.mark.parametrize("allowed,want", [(0, 5), (1, 4), (6, 4), (7, 3), (46, -5), (60, -5)])
def test_brackets_are_inclusive(spark, allowed, want):
    rules = [("PA0", 5.0), ("PA1", 4.0), ("PA7", 3.0), ("PA46", -5.0)]
    assert one(spark, {"points_allowed": float(allowed)}, rules, unit=True) == want


def test_rule_validation():
    kept = validate_rules([("KRTD", 6), ("PRTD", 6), ("SK", 1), ("PY", 0), ("REC", 1)])
    assert kept == [("KRTD", 6.0), ("REC", 1.0)]
    with pytest.raises(ValueError):
        compile_rules([("NOPE", 1.0)])


def test_needed_columns():
    assert needed_columns(["INC", "RY10"]) == {"attempts", "completions", "rushing_yards"}
