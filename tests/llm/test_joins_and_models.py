import itertools
import random
import zlib

import numpy as np
import pytest

from rivalgrid.llm import chat, ngram_join, quality, topk_search
from tests.llm import cases


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def near_texts(seed):
    """Families with few and many edits, chains, shared passages, short texts, copies."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for size in (3, 5, 12, 40, 130, 150, 600):
        for _ in range(3):
            base = [r.choice(vocabulary) for _ in range(size)]
            for _ in range(6):
                copy = list(base)
                for _ in range(r.randint(0, max(1, size // 25))):
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
                out.append(" ".join(copy))
            drift = list(base)
            for _ in range(6):
                drift[r.randrange(len(drift))] = r.choice(vocabulary)
                out.append(" ".join(drift))
    for _ in range(40):
        own = [r.choice(vocabulary) for _ in range(r.choice([0, 2, 4, 8]))]
        out.append(" ".join(passage + own).upper())
    return out + ["", None, "one", "One", "two words", "two  words"] + out[:5]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_components_against_all_pairs(spark, words, percent):
    rows = list(enumerate(near_texts(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.components(df, words, percent).collect()))
    assert got == sorted(brute_components(rows, words, percent))


def test_a_bucket_of_strangers_is_searched_to_the_end(spark, monkeypatch):
    """Texts of the same frequent tokens in other mixes: many pivots fail before a link is found."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    r = random.Random(9)
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(14)]
    texts = [" ".join(r.sample(lines, 9)) for _ in range(60)]
    texts += [t + " tail" for t in texts[::7]]
    rows = list(enumerate(texts))
    got = sorted(map(tuple, ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()))
    assert got == sorted(brute_components(rows, 3, 90))


def test_slices_hold_every_prefix():
    plan = ngram_join.Plan.of(3, 90)
    r = np.random.default_rng(4)
    for n in [*range(1, 160), 500, 511, 560, 2047, 2275, 5000]:
        tokens = np.unique(r.integers(0, 1 << 63, n, dtype=np.int64))
        parts = list(plan.slices(tokens))
        assert parts and all(len(s) >= min(len(tokens), plan.spare(len(tokens)) + 1) for _, s in parts)
        # the next size that may link to this one shares a class with it
        partner = -(-len(tokens) * 100 // 90) if len(tokens) * 100 % 90 else len(tokens) * 100 // 90
        low, high, _ = plan.classes[parts[0][0]]
        assert len(tokens) <= high and (parts[-1][0] == len(plan.classes) - 1 or min(partner, len(tokens) * 100 // 90) <= plan.classes[parts[-1][0]][1])


def test_components_bear_all_rows(spark):
    docs = cases.documents(spark)
    rows = ngram_join.components(docs, 3, 90).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, brute_components([(i, t) for i, t, _ in cases.TEXTS], 3, 90)))
    assert ngram_join.components(cases.empty(spark), 3, 90).count() == 0
    stays = ngram_join.one_of_each(docs, 3, 90)
    assert stays.columns == docs.columns
    assert {r.doc_id for r in stays.collect()} == {1, 4, 5, 6, 7, 8, 9, 11, 12, None}


def brute_top(rows, k, every):
    ok = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-int(q @ x), j) for j, x in ok if j != i and len(x) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(0, 0.12, (900, 16)))]
    rows += [(900 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2020, [1.0, 2.0]), (2021, [3.0, 4.0]), (2040, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_top(rows, 20, 20)
    for sizes in ({}, {"rows": 100, "queries": 17}):
        assert sorted(map(tuple, topk_search.top_k(df, **sizes).collect())) == want
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_lists_are_not_always_read_to_the_end():
    """Where few dimensions matter, reading stops early and still holds the best."""
    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 20, (2000, 3)))
    q = np.array([[50.0, 1.0, 0.0], [0.0, -40.0, 2.0]])
    left = dict(topk_search.read_lists(q, np.array([-1, -2]), x, np.arange(2000), 10))
    for i in (0, 1):
        best = np.argsort(-(x @ q[i]), kind="stable")[:10]
        assert len(left[i]) < 600 and set(best) <= set(left[i])


def test_very_large_components_stay_exact(spark):
    rows = [(20, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0])]
    got = topk_search.top_k(spark.createDataFrame([(i, [x / 2**20 for x in v]) for i, v in rows], "vec_id long, embedding array<double>"))
    assert [(r.query_id, r["rank"], r.vec_id) for r in got.collect()][0] == (20, 1, 1)


def brute_chat(rows, most):
    out = []
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "unknown", x[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "unknown", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        for who in {s for s, _ in turns if s != "system"}:
            for part in range(0, len(turns), most):
                text, mask = "", []
                for speaker, said in turns[part:part + most]:
                    text += chat.OPEN + ("assistant" if speaker == who else "system" if speaker == "system" else f"user name={speaker}") + "\n"
                    if speaker == who:
                        mask.append(f"{len(text)}:{len(text) + len(said)}")
                    text += said + chat.CLOSE
                out.append((conv, who, part // most, min(most, len(turns) - part), text, ",".join(mask)))
    return out


def test_rotation_against_brute_force(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", "ann", None]), r.choice(["hi", "", None, "é😀\n", "long " * 50])) for c in (1, 2, None) for t in [*range(23), 5, 5, None]]
    rows += [(3, 0, "system", "alone"), (4, 1000, "ann", "far"), (4, -7, "bob", "before"), (4, -7, "bob", "before")]
    df = spark.createDataFrame([(*x, "y") for x in rows], "conv_id long, turn long, role string, text string, part string")
    assert sorted(map(repr, map(tuple, chat.rotate(df, most=8).collect()))) == sorted(map(repr, brute_chat(rows, 8)))
    assert chat.rotate(df.limit(0)).count() == 0


def labelled(spark):
    r = random.Random(4)
    words = ["the", "of", "and", "house", "river", "stone", "light", "walks"]
    rows, labels = [], []
    for i in range(1200):
        good = r.random() < 0.8
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 80))) + "."
        rows.append((i, text.capitalize() if good else r.choice([text.replace(" ", " | "), text.upper().replace(" ", "!! "), "buy now " * 30])))
        if good and r.random() < 0.5:
            labels.append((i, 1))
        elif not good and r.random() < 0.5:
            labels.append((i, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_quality_on_the_held_out_fifth(spark):
    docs, labels, known = labelled(spark)
    rows = quality.score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    right = sum(r.predicted == known[r.doc_id] for r in held)
    assert len(held) > 60 and right >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    model = quality.fit(docs, labels)
    assert 0.7 < model.prior < 0.9
    # the labels of the held-out fifth and negative labels change nothing
    other = labels.where("quality = 1").union(docs.where("crc32(cast(doc_id as string)) % 5 = 0").selectExpr("doc_id", "1"))
    assert np.allclose(quality.fit(docs, other).weights, model.weights, atol=1e-6)


def test_quality_bears_all_rows(spark):
    docs, labels, _ = labelled(spark)
    edge = cases.documents(spark)
    rows = quality.score_documents(docs.unionByName(edge.selectExpr("doc_id + 5000 AS doc_id", "text")), labels).collect()
    assert len(rows) == 1200 + len(cases.TEXTS)
    assert len({r.score for r in rows if r.doc_id in (5004, 5005, 5012)}) == 1
    nobody = labels.where("quality > 5")
    assert {r.score for r in quality.score_documents(edge, nobody).collect()} == {0.5}
    assert quality.score_documents(cases.empty(spark), labels).count() == 0
    assert quality.good_documents(edge, nobody).columns == edge.columns
