"""Decontamination, whitening and alignment against brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivalgrid.llm import alignment, decontaminate, ngram_join, whitening
from tests.llm import cases
from tests.llm.test_joins_and_models import brute_components
from tests.llm.test_text_operators import noise

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PASSAGE = " ".join(f"q{i}" for i in range(60))


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_hits(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for item, item_text in items:
        w = plain_words(item_text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[i : i + size]:
                    hit |= set(range(at, at + size))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found), hit


ITEMS = [
    (1, PASSAGE), (2, "Two, WORDS!"), (3, "ran off"), (4, None), (5, " -- "), (None, "no id here at all"), (10, PASSAGE), (10, PASSAGE),
    (7, "É Ünïcödé-漢字"), (8, "the cat sat on the mat and the dog ran off"), (9, "one"), (11, "a b c d e f g h i j k l m n a b c d e f g h i j"),
]
DOCS = [
    PASSAGE, "before " + PASSAGE.upper() + " after", " ".join(f"q{i}" for i in range(9)), " ".join(f"q{i}" for i in range(20, 30)), "two words two-words TWO words",
    PASSAGE + "x " + PASSAGE, "a b c d e f g h i j a b c d e f g h i j k", "ünïcödé ÜNÏCÖDÉ\t漢字", "the cat sat on the mat and the cat sat", "É Ünïcödé 漢字", "ran", "ran. Off", "x\x00ran\x00off",
]


@pytest.mark.parametrize(("window", "shingle"), [(10, 5), (10, 3), (3, 5), (1, 1), (12, 12)])
def test_decontamination_is_plain_search(spark, window, shingle):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(DOCS)], "doc_id long, text string")
    docs = cases.documents(spark).unionByName(more, allowMissingColumns=True).withColumn("items", F.lit("old"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("phrase", F.lit("x"))
    rows = decontaminate.decontaminate(docs, items, window, keep=("doc_id", "items", "row"), shingle=shingle).collect()
    texts = {**{i: t for i, t, _ in cases.TEXTS}, **{100 + i: t for i, t in enumerate(DOCS)}}
    texts[None] = "no id here at all"  # of the two rows without an id the other one is NULL
    assert Counter(r.doc_id for r in rows) == Counter([i for i, _, _ in cases.TEXTS] + [100 + i for i in range(len(DOCS))])
    for r in rows:
        want = plain_hits(None if r.doc_id is None and r.n_words == 0 else texts[r.doc_id], ITEMS, window)
        assert (r.n_words, r.n_hit, r["items"]) == want[:3], r
        assert r.n_items == len(want[2]) and r.contaminated == (want[1] > 0)
        assert {i for s in r.spans for i in range(s.start, s.end)} == want[3]
        assert all(x.end < y.start for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_decontamination_of_or_by_nothing(spark):
    docs, none = cases.documents(spark), spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(docs, none).collect()
    assert len(out) == len(cases.TEXTS) and not any(r.n_hit or r.contaminated or r.n_items for r in out)
    assert decontaminate.decontaminate(cases.empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_clean_documents_stay_whole(spark):
    docs = cases.documents(spark)
    items = spark.createDataFrame([(1, "two words"), (2, "no id")], "item_id long, text string")
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    gone = {"two words", "no id here at all"}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.text not in gone)


def vectors(n=300, d=9, seed=3):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 3, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0] + 5
    return v.astype(np.float32)


def whole(v):
    return np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000


def test_whitening_is_that_of_the_distinct_vectors(spark):
    v = vectors()
    x = np.unique(whole(v), axis=0)
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    bad = [(-1, None), (-2, []), (-3, [float("nan")] * 9), (-4, [1.0] * 8 + [None]), (-5, [float("inf")] * 9), (-6, [1.0] * 4), (-7, [1e30] * 9)]
    rows = [(i, [float(e) for e in row]) for i, row in enumerate(v)] + [(None, [float(e) for e in v[0]])] * 2 + [(7, [float(e) for e in v[1]])]
    df = spark.createDataFrame(bad + rows, "vec_id long, embedding array<float>").withColumn("whitened", F.lit("x")).withColumn("x", F.lit(1))
    out = whitening.whiten(df, keep=("vec_id", "x", "whitened"), components=4).collect()
    assert len(out) == 4 * len(rows) and {r.vec_id for r in out} == {i for i, _ in rows}
    seen = {}
    for r in out:
        seen.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for k in range(4):
        z = (whole(v) - total / n) @ axes[:, k] / np.sqrt(values[k])
        got = np.array([seen[i, k + 1][0].whitened for i in range(len(v))])
        signs[k] = np.sign(z @ got)
        assert np.allclose(got, signs[k] * z, atol=1e-9)
        assert abs(seen[0, k + 1][0].explained / (values[k] / values.sum()) - 1) < 1e-9
    for i, row in enumerate(whole(v)):
        want = sum((n * int(e) - int(t)) ** 2 for e, t in zip(row, total, strict=True))
        assert all(int(q.deviation) == want or i == 7 for q in seen[i, 1])
    assert all(r.n == n and r.identity_error < 1e-9 for r in out)


def test_whitening_of_few_and_flat_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # one distinct vector has no variance
    two = make([(1, [0.0, 0.0, 1.0]), (2, [1.0, 1.0, 1.0])]).collect()
    assert [(r.component, round(abs(r.whitened), 9), r.n, round(r.explained, 12)) for r in two] == [(1, 1.0, 2, 1.0)] * 2
    ties = make([(i, [float(i == j) for j in range(5)]) for i in range(5)]).collect()  # four equal eigenvalues
    assert len(ties) == 20 and max(r.identity_error for r in ties) < 1e-9


def test_factors_and_exact_sums():
    r = np.random.default_rng(1)
    for d, rank in ((1, 1), (7, 7), (8, 3), (33, 20)):
        half = r.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        a = half @ half.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, atol=1e-12)
        values, axes = whitening.one_sided_jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-6, atol=1e-14)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12) and np.allclose(a @ axes, axes * values, atol=1e-12)
    for size in (10, 1 << 20, 1 << 27, 1 << 39):
        y = r.integers(-size, size, (50, 3))
        want = [[sum(int(p) * int(q) for p, q in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert [[int(e) for e in row] for row in whitening.exact_products(y)] == want
    model = whitening.Whitening(3, np.array([6, 3], dtype=object), np.eye(2), np.ones(2), 1.0)
    big = np.array([[1 << 61, 5], [2, 1]])
    assert [int(e) for e in model.deviation(big)] == [(3 * (1 << 61) - 6) ** 2 + 144, 0]
    assert float(Fraction(1, 3)) == 1 / 3


def plain_alignment(texts):
    library = Tokenizer.from_file(PATH_A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letters = {c: b for b, c in enumerate(alignment.byte_letters())}
    out, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in library.id_to_token(i))) for i in library.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text or "")]
        if not text or b"".join(p for _, p in a) != want or b"".join(p for _, p in b) != want:
            a = b = []
        spans = []
        for side in (a, b):
            at, held = 0, []
            for i, piece in side:
                held.append((at, at + len(piece), i))
                at += len(piece)
            spans.append(held)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= cut) for side in spans))
            begin = cut
        counts.update(links)
        out.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(na, nb, ng, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), digest) for na, nb, ng, ls, digest in out], counts, most


@pytest.mark.parametrize(("head", "held"), [(1 << 18, 1 << 20), (40, 100), (0, 1)])
def test_alignment_is_that_of_all_pairs(spark, head, held):
    texts = [t for _, t, _ in cases.TEXTS if t is None or len(t) < 1000] + noise(150, 5) + ["<s></s><unk>", "▁ at▁", "a\x00b", " " * 50, "x" * 300, "<0x41>", "<|endoftext|>x"]
    want, counts, most = plain_alignment(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("n_links", F.lit("old")).withColumn("pairs", F.lit(1))
    out, pairs = alignment.align(docs, PATH_A, PATH_B, keep=("doc_id", "pairs", "n_links"), head=head, held_pairs=held)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()}
    assert got == dict(enumerate(want))
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in counts.items()}


def test_lanes_change_nothing():
    a, b = alignment.side_a(PATH_A), alignment.side_b(PATH_B)
    texts = [t for _, t, _ in cases.TEXTS] + noise(60, 9)
    left, right = alignment.encode_both(texts, a, b)
    want = [np.sort(x) for x in alignment.lockstep(left, right, 1 << 30)]
    for length in (1, 2, 7, 192):
        assert all(np.array_equal(np.sort(x), y) for x, y in zip(alignment.lockstep(left, right, length), want, strict=True))


def test_alignment_of_nothing_and_of_each_repeated_row(spark):
    out, pairs = alignment.align(cases.empty(spark), PATH_A, PATH_B)
    assert out.count() == 0 and pairs.count() == 0
    rows = alignment.align(cases.documents(spark), PATH_A, PATH_B)[0].collect()
    assert len(rows) == len(cases.TEXTS) and sum(r.n_links == 0 and r.groups_sha256 == "" for r in rows) == 3


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (5, 80, 3), (1, 70, 4)])
def test_families_about_the_threshold(spark, words, percent, seed):
    """Copies that differ in a few words each: every pair shares its prefixes, some pairs are linked."""
    r = random.Random(seed)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(r.choice([40, 90]))]
        for _ in range(60):
            copy = list(base)
            for _ in range(r.randrange(0, 9)):
                copy[r.randrange(len(copy))] = r.choice([f"f{family}x{r.randrange(4)}", f"y{r.randrange(10**6)}", f"f{family}w{r.randrange(40)}"])
            rows.append((len(rows), " ".join(copy[: r.choice([len(copy), len(copy), len(copy) - 3])])))
    r.shuffle(rows)
    met = []
    by_difference = ngram_join._by_difference

    def watched(*args):
        out = by_difference(*args)
        met.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "_by_difference", watched)
        patch.setattr(ngram_join, "FEW", 1)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x.doc_id: x.component_id for x in ngram_join.components(df, words, percent).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, words, percent)}
    assert len(met) == 1
