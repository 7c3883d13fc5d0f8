"""Landed streams over many batches, replays, folds; scoreboard and line-up documents; rules in words."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rivalgrid.functions.scoring import default_rules, rules_by_source, rules_in_words
from rivalgrid.operators.plays import board_fraction
from rivalgrid.sources import documents as dc
from rivalgrid.streaming import landing as ld

STATUS = "entity long, ts long, points double"
LOG = "entity long, ts_us long, seq long, value double, is_mark boolean"


def file_stream(spark, folder, rows, schema, files, per_batch=2):
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(folder))


def test_upserts_over_many_batches_read_folded_files(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(20), t, float(t)) for t in r.sample(range(10_000), 400)]
    stream = file_stream(spark, tmp_path / "in", rows, STATUS, 14)
    got = ld.land_stream(stream, ld.newest(["entity"], ["ts"]), "t", every=3, folder=str(tmp_path / "out"))
    want = {}
    for e, t, p in rows:
        want[e] = max(want.get(e, (-1, 0.0)), (t, p))
    assert {x.entity: (x.ts, x.points) for x in got.collect()} == want
    landing = ld.Landing(spark, str(tmp_path / "out" / "rows"), stream.schema, ld.newest(["entity"], ["ts"]), 3)
    assert landing._numbers("batch") == list(range(7)) and landing._numbers("folded") == [2, 5]
    assert [f.rsplit("/", 1)[1] for f in landing.folders()] == ["folded-5", "batch-6"]  # one fold and one batch are read


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    fold = ld.newest(["entity"], ["ts"])
    batches = [spark.createDataFrame([(e, 10 * b + e, float(b)) for e in range(b, b + 3)], STATUS) for b in range(6)]
    landing = ld.Landing(spark, str(tmp_path / "rows"), batches[0].schema, fold, 2)
    assert landing.read().count() == 0
    for n, rows in enumerate(batches):
        landing.land(rows, n)
    before = sorted(landing.read().collect())
    for n in (5, 3, 5):
        landing.land(batches[n], n)
        assert sorted(landing.read().collect()) == before


def plain_log(rows):
    marks, best = {}, {}
    for e, t, _, _, m in rows:
        if m:
            marks[e] = min(t, marks.get(e, t))
    for e, t, s, v, m in rows:
        if not m and (e not in marks or t < marks[e]):
            best[e] = max(best.get(e, (-1, -1, 0.0)), (t, s, v))
    return {e: (b[2], e in marks) for e, b in best.items()}


@pytest.mark.parametrize(("every", "lateness"), [(1, None), (2, 5_000), (3, 100), (100, None)])
def test_log_of_one_hot_key_over_many_batches(spark, tmp_path, every, lateness):
    """Estimates and marks in any order within the lateness allowed; a third of all rows are one key's."""
    r = random.Random(every)
    reach = 4_000 if lateness is None else lateness
    rows = []
    for i in range(600):
        e = 0 if i % 3 == 0 else r.randrange(1, 30)
        rows.append((e, i * 10 + r.randrange(reach // 2 or 1), i, float(i), i > 300 and r.random() < 0.05))
    landing = ld.Landing(spark, str(tmp_path / "rows"), spark.createDataFrame([], LOG).schema, ld.log_until_mark("entity", lateness), every)
    for n in range(6):
        landing.land(spark.createDataFrame(rows[n * 100 : n * 100 + 100], LOG), n)
    got = {x.entity: (x.value, x.frozen) for x in ld.logged(landing.read(), "entity").collect()}
    assert got == plain_log(rows)
    if lateness and every == 3:
        newest = max(x[1] for x in rows)
        held = landing.read().where("not is_mark").groupBy("entity").agg(F.sum((F.col("ts_us") < newest - lateness).cast("int")).alias("n"))
        assert held.agg(F.max("n")).first()[0] <= 1  # of what is settled, one row per key is left


def test_scoreboards_bad_documents_do_not_sink_the_others(spark):
    bodies = [
        json.dumps({"state": "pre", "period": 1, "clock": "15:00", "home": "A", "away": "B", "sent": 1}),
        json.dumps({"state": "in", "period": 3, "clock": "7:30", "home": "C", "away": "D", "sent": 2}),
        json.dumps({"state": "post", "period": 4, "clock": "0:00", "home": "E", "away": "F", "sent": 3}),
        json.dumps({"state": "in", "period": 5, "clock": "5:00", "home": "G", "away": "H", "sent": 4}),
        json.dumps({"state": "in", "period": 2, "clock": "soon", "home": "I", "away": "J", "sent": 5}),
        json.dumps({"state": "in", "period": 2, "clock": "1:00", "home": "K", "sent": 6}), json.dumps({"period": 2}), "{", "", "[1]", None, '{"state": "in", "per',
    ]
    good, bad = dc.scoreboards(spark.createDataFrame([(x,) for x in bodies], "body string"))
    got = {x.grp: x.f for x in good.select("grp", board_fraction().alias("f")).collect()}
    want = {"A": 1.0, "C": 1 - (2 * 900 + 450) / 3600, "E": 0.0, "G": 0.05, "I": 0.5}
    assert got == want | {chr(ord(k) + 1): v for k, v in want.items()}
    assert sorted(x.reason for x in bad.collect()) == ["no teams"] + ["not a scoreboard"] * 6


def test_lineup_documents_of_any_length_come_back_by_position(spark):
    rows = [(p, m, 2 * m + s, i + 1, 1000 * s + i, "RB", None if i == 3 else i / 4) for p in (1, 2) for m in (0, 1) for s, n in ((0, 150), (1, 64)) for i in range(n)]
    df = spark.createDataFrame(rows, "period int, match long, team long, place int, entity long, slot string, pts double")
    bodies = dc.lineup_documents(df)
    pieces = [json.loads(x.body) for x in bodies.collect()]
    assert len(pieces) == 2 * 2 * 3 and max(len(s["lineup"]) for d in pieces for s in d["sides"]) == dc.PIECE
    bye = json.dumps({"period": 1, "match": 9, "piece": 0, "sides": [{"lineup": [{"entity": 5}]}]})
    more = bodies.union(spark.createDataFrame([(bye,), ("{",)], "body string"))
    got = {(x.period, x.team, x.place): (x.entity, x.slot, x.pts) for x in dc.lineup_rows(more).collect()}
    assert got == {(p, t, i): (e, s, v or 0.0) for p, _, t, i, e, s, v in rows}
    assert {x.period for x in dc.lineup_rows(more, 2).collect()} == {1}


def test_rules_in_words(spark):
    own = [(1, None, 0.0), (2, "REC", 1.0), (2, "2PRET", 3.0), (2, "NOPE", 1.0)] + [(3, i, 0.0) for i in ("FG0", "FG40", "FG50", "FG60", "PAT")]
    rules = rules_by_source(default_rules(0.5), spark.createDataFrame(own, "source int, item string, points double"))
    got = {x.source: x for x in rules_in_words(rules).collect()}
    base = dict(default_rules(0.5))
    assert got[1].words == "; ".join(sorted(f"{i}: {p:.3f}" for i, p in base.items())) and got[1].categories == "players,K,DST"
    assert "REC: 1.000" in got[2].words and got[2].unused == "2PRET,NOPE" and got[2].n_items == len(base)
    assert got[3].categories == "players,DST" and "FGM: -1.000" in got[3].words and "PAT" not in got[3].words
