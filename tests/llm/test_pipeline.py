"""The pipeline against a plain version of every stage, and the queries against their SQL."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from rivalgrid.llm import bpe, quality, queries
from tests.llm.test_joins_and_models import brute_components
from tests.llm.test_text_operators import filled, normal


def corpus():
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in "blst" for b in "aeiou" for c in ("n", "r", "st", "")]
    docs, labels = [], []
    for i in range(260):
        good = r.random() < 0.85
        text = " ".join(r.choice(words) for _ in range(r.choice([3, 12, 40, 90]))) + "."
        text = text.capitalize() if good else text.upper().replace(" ", "!! | ")
        docs.append((i, text, "en", r.choices(["a", "b", "c", None], [60, 10, 5, 3])[0]))
        if r.random() < 0.6:
            labels.append((i, int(good), 0))
    for i in range(260, 330):
        text = docs[r.randrange(200)][1]
        if r.random() < 0.5:
            text = text.replace(" ", "  ", 2)
        else:
            parts = text.split(" ")
            parts[r.randrange(len(parts))] = "other"
            text = " ".join(parts)
        docs.append((i, text, "en", r.choice(["a", "b", None])))
    docs += [(400, None, "en", "a"), (401, "", None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], labels


def plain(docs, labels_df, spark):
    model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels_df)
    rows = [d for d in docs if model.score(d[1]) >= quality.THRESHOLD]
    groups = {}
    for d in rows:
        groups.setdefault(normal(d[1]), []).append(d)
    rows = [min(g, key=lambda d: (-len(d[1] or ""), d[0])) for g in groups.values()]
    least = {d: c for d, _, c in brute_components([(d[0], d[1]) for d in rows], 5, 80)}
    rows = [d for d in rows if least[d[0]] == d[0]]
    size = lambda d: len((d[1] or "").encode().split())
    order = [s for s in [*sorted({d[3] for d in rows if d[3] is not None}), None] if s in {d[3] for d in rows}]
    totals = [sum(size(d) for d in rows if d[3] == s) for s in order]
    targets = filled(totals, [i % 3 + 1 for i in range(len(order))])
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    out = Counter()
    for s, total, target in zip(order, totals, targets, strict=True):
        each = min(target / total, 3.0) if total else 0.0
        u = int(hashlib.md5(("7:" + ("null" if s is None else "=" + s)).encode()).hexdigest()[:8], 16) / 2**32
        mine = sorted((d for d in rows if d[3] == s), key=lambda d: (size(d), hashlib.md5(str(d[0]).encode()).hexdigest()[:2], d[0]))
        for i, d in enumerate(mine, 1):
            copies = math.floor(each * i + u) - math.floor(each * (i - 1) + u)
            if copies:
                out[d[0], tuple(encoder.encode_ordinary(d[1] or ""))] += copies
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels_df.write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain(docs, labels_df, spark)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in rows) == want
    texts = {d[0]: d[1] or "" for d in docs}
    assert all(r.n_tokens == len(r.token_ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels = corpus()
    df = spark.createDataFrame(docs[:40], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
