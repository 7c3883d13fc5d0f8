"""Sketches of the n-gram join: candidates of families whose members nearly link."""

import random

import numpy as np
from pyspark.sql import functions as F

from rivalgrid.llm import ngram_join
from tests.llm.test_joins_and_models import brute_components


def test_a_family_just_below_the_threshold_makes_few_candidates(spark, monkeypatch):
    """Variants that differ in somewhat more than linked texts may: each pair was a candidate, once per shared group."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in r.sample(range(0, 300, 3), 5):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    texts += [t + " tail" for t in texts[::9]]
    rows = list(enumerate(texts))
    asked = []
    verified = ngram_join._verified

    def watched(pairs, nodes, plan):
        asked.append((pairs.count(), pairs.distinct().count()))
        return verified(pairs, nodes, plan)

    monkeypatch.setattr(ngram_join, "_verified", watched)
    got = sorted(map(tuple, ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()))
    assert got == sorted(brute_components(rows, 3, 90))
    assert all(n == distinct for n, distinct in asked)
    assert sum(n for n, _ in asked) <= 3 * len(rows)


def test_sketches_differ_in_no_more_slots_than_the_sets_in_tokens(spark):
    plan = ngram_join.Plan.of(3, 90)
    r = np.random.default_rng(5)
    rows = []
    for n, gone, new in [(0, 0, 3), (1, 1, 1), (40, 3, 2), (300, 14, 14), (300, 0, 0), (750, 10, 40), (2000, 60, 90), (50, 0, 900)]:
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.int64))
        b = np.union1d(a[gone:], r.integers(0, 1 << 63, new, dtype=np.int64))
        rows.append((plan.sketch(a).tolist(), plan.sketch(b).tolist(), len(np.setxor1d(a, b))))
    sketches = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, apart long")
    found = sketches.select("apart", ngram_join.parities_apart(F.col("a"), F.col("b")).alias("ab"), ngram_join.parities_apart(F.col("b"), F.col("a")).alias("ba")).collect()
    assert all(x.ab == x.ba <= x.apart for x in found)
    assert any(len(a) == 2 * len(b) or len(b) == 2 * len(a) for a, b, _ in rows)
    # sets that may link keep nearly every difference
    assert [x.ab for x in found][3] >= 24
