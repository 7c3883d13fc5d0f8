"""Tables of the byte-pair encoding: never spelled out in a plan, whole whatever their size."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from rivalgrid.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_tables_stay_out_of_plans(spark):
    """The plan held every rank and every known word with its ids, some megabytes for each of its strings."""
    texts = [" ".join(f"zq{chr(97 + i % 26)}x{chr(97 + i // 26)}wk" for i in range(600))] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded, codec = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    plan = encoded._jdf.queryExecution().toString()
    assert "zqaxbwk" not in plan and len(plan) < 1_000_000
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert all(list(r.token_ids) == library.encode_ordinary(r.text) for r in encoded.collect())


def test_bpe_knows_tokens_and_words_that_repeat(spark):
    """Both are looked up once; a token took a second look-up, in the ranks."""
    texts = ["the cat zzqxj sat", "the cat zzqxj ran"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codec = bpe.Codec(spark, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    known = codec.known_words(docs, "text")
    words = ["the", " cat", " zzqxj", " sat", " ran", "é"]
    row = spark.range(1).select(*[known.get(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words)]).first()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    single = [w for w in words if len(library.encode_ordinary(w)) == 1]
    assert single
    for w, ids in zip(words, row, strict=True):
        assert ids == library.encode_ordinary(w) if w in single or w == " zzqxj" else ids is None


def test_bpe_known_words_are_bounded_in_bytes(spark, monkeypatch):
    """Only their number was bounded, so long words could make the table six times as large."""
    docs = spark.createDataFrame([(i, "qzxqzxqz " * 3 + "wjvwjvwj") for i in range(2)], "doc_id long, text string")
    codec = bpe.Codec(spark, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "ALL_BYTES", 10)
    known = codec.known_words(docs, "text")
    row = spark.range(1).select(known.get(F.lit(" qzxqzxqz")).alias("often"), known.get(F.lit(" wjvwjvwj")).alias("twice")).first()
    assert row.often is not None and row.twice is None


def table_bytes(known):
    """Of the rows that scalar subqueries bring to the driver."""
    tables = [t for t in (known, *vars(known).values()) if hasattr(t, "row")]
    return sum(t.row._jdf.queryExecution().executedPlan().executeCollect()[0].getSizeInBytes() for t in tables)


def test_bpe_known_words_are_small(spark, monkeypatch):
    """Each known word took 64 bytes of the table that passes the driver, several times; rare ones are in strings."""
    words = [f"z{a}q{b}x{c}w" for a in "abcdefghijklmnopqrst" for b in "bcdfghjklmnpqrstvwxz" for c in "bcdfghjkmn"]
    odd = [" éあ𝄞\ufeff", " zbqcxd", " zbqcxdwzbqcxdw", "\n", ".\x00\x01", "\ufffd\ufffe\uffff"]
    texts = ["".join(f" {w}" for w in words)] * 2 + ["".join(odd)] * 2 + [" zbqcxdw" + odd[-1] + " once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codec = bpe.Codec(spark, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "FREQUENT", 4, raising=False)
    full, none = codec.known_words(docs, "text"), codec.known_words(docs, "text", 0)
    assert table_bytes(full) - table_bytes(none) < 45 * len(words)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert all(list(r.token_ids) == library.encode_ordinary(r.text) for r in codec.encode(docs, "text", "token_ids", full).collect())
    some = [f" {w}" for w in words[::400]] + [" zbqcxd", " zbqcxdwzbqcxdw"]
    asked = [*some, "zaqbxbw", " zaqbxb", ""]
    ids = spark.range(1).select(*[full.get(F.lit(w)).alias(f"w{i}") for i, w in enumerate(asked)]).first()
    assert [*ids] == [library.encode_ordinary(w) for w in some] + [None] * 3
