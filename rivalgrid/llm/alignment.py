"""Cross-tokenizer alignment: where two vocabularies cut the same text, and which of their tokens meet.

Each text is encoded by A (byte-level BPE, of a blank and the text) and by B (pieces with byte fallback,
which adds the blank itself). Both sequences cover the same bytes, so aligning them is a merge of two
sorted lists of token ends. The merge is run in lockstep over all documents of a batch: one state vector
holds a pointer into A and one into B per lane; each step emits one link per lane, emits a cut where both
tokens end together, moves on whichever token ends first (or both), and drops the lanes that are done. A
lane is a document, or a stretch of a long one between two cuts, so that no long document is left alone
in the loop.

How often an id pair is linked is a property of the corpus. Tasks count pairs in bounded tables and emit
those; the sums are shuffled by pair. Going back, the ``HEAD`` most frequent pairs (a bounded table) are
looked up in the tasks, and only links of rarer pairs are joined by pair, so no pair that many documents
hold is a join key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rivalgrid.llm.token_counts import byte_letters
from rivalgrid.session import cut_lineage

HEAD, HELD_PAIRS, CHUNK_CHARS, LANE, WIDTH = 1 << 18, 1 << 20, 1 << 20, 192, 1 << 31
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Side:
    """One tokenizer: encoder of a list of texts, bytes of each id."""

    encode: object
    pieces: list[bytes]
    lengths: np.ndarray


@lru_cache(maxsize=2)
def side_a(path: str) -> Side:
    """The byte-level vocabulary, run by its ranks: ids follow the order of merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = {c: b for b, c in enumerate(byte_letters())}
    vocab = spec["model"]["vocab"]
    special = {t["content"] for t in spec["added_tokens"]}
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    ranks = {pieces[i]: i for token, i in vocab.items() if token not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    fast = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(t) if fast else whole.encode(t, add_special_tokens=False).ids for t in (" " + t for t in texts)]

    return Side(encode, pieces, np.array([len(p) for p in pieces], dtype=np.int64))


@lru_cache(maxsize=2)
def side_b(path: str) -> Side:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    one_byte = regex.compile(r"<0x([0-9A-F]{2})>")
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = one_byte.fullmatch(piece) if model.is_byte(i) else None
        pieces.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces, np.array([len(p) for p in pieces], dtype=np.int64))


@dataclass(frozen=True)
class Tokens:
    """Ragged tokens of a batch: ids, where each ends in the bytes of the batch, first token of each document."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(rows: list[list[int]], lengths: np.ndarray) -> Tokens:
        ids = np.fromiter((i for row in rows for i in row), dtype=np.int64, count=sum(map(len, rows)))
        first = np.r_[0, np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))]
        return Tokens(ids, np.cumsum(lengths[ids]), first)


def lanes(a: Tokens, b: Tokens, length: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in A, start in B and end in A of each lane: documents, cut about every ``length`` tokens of A
    where a token of B ends too (a few ends after the mark are tried; without one the lane just goes on)."""
    sizes = np.diff(a.first)
    inner = np.maximum(sizes // length - 1, 0)
    mark = np.repeat(a.first[:-1], inner) + length * (1 + np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner))
    tries = mark[:, None] - 1 + np.arange(min(16, length))
    met = np.searchsorted(b.ends, a.ends[tries])
    hit = b.ends[np.minimum(met, len(b.ends) - 1)] == a.ends[tries] if len(b.ends) else np.zeros_like(tries, dtype=bool)
    found, which = hit.any(axis=1), hit.argmax(axis=1)
    rows = np.flatnonzero(found)
    some = sizes > 0
    in_a = np.r_[a.first[:-1][some], tries[rows, which[rows]] + 1]
    in_b = np.r_[b.first[:-1][some], met[rows, which[rows]] + 1]
    order = np.argsort(in_a, kind="stable")
    in_a, in_b = in_a[order], in_b[order]
    return in_a, in_b, np.r_[in_a[1:], a.first[-1:]][: len(in_a)]


def lockstep(a: Tokens, b: Tokens, length: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as numbers of tokens of A and of B, and cuts as the last token of either side before each."""
    at_a, at_b, stop = lanes(a, b, length)
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(at_a):
        link_a.append(at_a)
        link_b.append(at_b)
        end_a, end_b = a.ends[at_a], b.ends[at_b]
        both = end_a == end_b
        cut_a.append(at_a[both])
        cut_b.append(at_b[both])
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        alive = at_a < stop
        if not alive.all():
            at_a, at_b, stop = at_a[alive], at_b[alive], stop[alive]
    none = [np.zeros(0, dtype=np.int64)]
    return tuple(np.concatenate(parts or none) for parts in (link_a, link_b, cut_a, cut_b))


@lru_cache(maxsize=4)
def _written(n: int, mark: str) -> list[str]:
    return [f"{i}{mark}" for i in range(n)]


def group_texts(a: Tokens, b: Tokens, cut_a: np.ndarray, cut_b: np.ndarray, n_a: int, n_b: int) -> list[str]:
    """For each document its groups as ``a1,a2|b1;a3|b2,b3``."""
    cut_a, cut_b = np.sort(cut_a), np.sort(cut_b)
    last_a, last_b = np.zeros(len(a.ids), dtype=bool), np.zeros(len(b.ids), dtype=bool)
    last_a[cut_a] = last_b[cut_b] = True
    # group of a token: cuts before it; A comes before B inside a group
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(a.ids)) + np.searchsorted(group_b, group_a, side="left")
    place_b = np.arange(len(b.ids)) + np.searchsorted(group_a, group_b, side="right")
    code = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
    code[place_a] = np.where(last_a, n_a, 0) + a.ids
    code[place_b] = 2 * n_a + np.where(last_b, n_b, 0) + b.ids
    table = _all_written(n_a, n_b)
    words = [table[c] for c in code.tolist()]
    first = (a.first + b.first).tolist()
    return ["".join(words[i:j])[:-1] for i, j in zip(first, first[1:], strict=False)]


@lru_cache(maxsize=2)
def _all_written(n_a: int, n_b: int) -> list[str]:
    return _written(n_a, ",") + _written(n_a, "|") + _written(n_b, ",") + _written(n_b, ";")


def encode_both(texts: list[str | None], a: Side, b: Side) -> tuple[Tokens, Tokens]:
    """Tokens of each text on both sides; none where the text is empty or a side does not give its bytes back."""
    full = [t or "" for t in texts]
    ids_a, ids_b = a.encode(full), b.encode(full)
    for k, text in enumerate(full):
        bytes_ = b" " + text.encode("utf-8", "surrogatepass")
        if not text or b"".join(map(b.pieces.__getitem__, ids_b[k])) != bytes_ or b"".join(map(a.pieces.__getitem__, ids_a[k])) != bytes_:
            ids_a[k], ids_b[k] = [], []
    return Tokens.of(ids_a, a.lengths), Tokens.of(ids_b, b.lengths)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(keys, return_inverse=True)
    return unique, np.bincount(back, weights=weights, minlength=len(unique)).astype(np.int64)


class _Held:
    """Counts of pairs, held up to a number of distinct ones; what comes in is merged in larger parts."""

    def __init__(self, limit: int):
        self.limit, self.parts, self.waiting = limit, [], 0
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> bool:
        """Whether the limit is passed."""
        self.parts.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > self.limit // 2:
            self._merge()
        return len(self.keys) > self.limit

    def _merge(self) -> None:
        self.keys, self.n = _counted(*(np.concatenate(c) for c in zip((self.keys, self.n), *self.parts, strict=True)))
        self.parts, self.waiting = [], 0

    def take(self, block: int = 1 << 14) -> list[tuple[np.ndarray, np.ndarray]]:
        self._merge()
        out = [(self.keys[i : i + block], self.n[i : i + block]) for i in range(0, len(self.keys), block)]
        self.keys, self.n = self.keys[:0], self.n[:0]
        return out


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], type=kind))


def _chunks(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t or "") > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(rows: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """One row per row (row, kept, text): its numbers, groups and distinct pairs with their links. Rows
    without ``kept`` carry counts of pairs over what a task has read since the last such row."""
    schema = T.StructType(
        [rows.schema["row"], T.StructField("kept", rows.schema["kept"].dataType, True)]
        + [T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField("groups_sha256", T.StringType())]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "links", "all_pairs", "all_links")])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def counts(held: _Held, kept: pa.DataType) -> Iterator[pa.RecordBatch]:
        parts = held.take()
        n = len(parts)
        longs = pa.nulls(n, pa.int64())
        lists = pa.nulls(n, pa.list_(pa.int64()))
        if n:
            yield pa.RecordBatch.from_arrays(
                [longs, pa.nulls(n, kept)] + [longs] * 4 + [pa.nulls(n, pa.string()), lists, lists, _lists([k for k, _ in parts], pa.int64()), _lists([c for _, c in parts], pa.int64())],
                names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side_a(path_a), side_b(path_b)
        held, kept = _Held(held_pairs), None
        for batch in batches:
            kept = batch.column(1).type
            texts = batch.column(2).to_pylist()
            for begin, end in _chunks(texts, CHUNK_CHARS):
                left, right = encode_both(texts[begin:end], a, b)
                link_a, link_b, cut_a, cut_b = lockstep(left, right)
                n = end - begin
                owner = np.searchsorted(left.first, link_a, side="right") - 1
                pair = left.ids[link_a] * WIDTH + right.ids[link_b]
                order = np.lexsort((pair, owner))
                owner, pair = owner[order], pair[order]
                new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])]) if len(pair) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.r_[new, len(pair)])
                owner, pair = owner[new], pair[new]
                full = held.add(pair, times)
                at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                of = [np.diff(left.first), np.diff(right.first), np.bincount(np.searchsorted(left.first, cut_a, side="right") - 1, minlength=n),
                      np.bincount(np.searchsorted(left.first, link_a, side="right") - 1, minlength=n)]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(left, right, cut_a, cut_b, len(a.pieces), len(b.pieces))]
                nothing = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(begin, n) for c in batch.columns[:2]] + [pa.array(c.astype(np.int64)) for c in of] + [pa.array(digests)]
                    + [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (pair, times.astype(np.int64))] + [nothing, nothing],
                    names=schema.names)
                if full:
                    yield from counts(held, kept)
        yield from counts(held, kept)

    return rows.select("row", "kept", "text").mapInArrow(run, schema)


def pair_counts(marked: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether no pair of its B id has more."""
    parts = marked.where(F.col("all_pairs").isNotNull()).select(F.explode(F.arrays_zip("all_pairs", "all_links")).alias("p"))
    counts = cut_lineage(parts.groupBy(F.col("p.all_pairs").alias("pair")).agg(F.sum("p.all_links").alias("n")))
    b = F.pmod("pair", F.lit(WIDTH)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    joined = counts.select("pair", "n", b).join(most, "b")
    return cut_lineage(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _head(counts: DataFrame, most: int) -> tuple[list[np.ndarray], int]:
    """Pairs, counts and marks of all pairs of at least a count, at most ``most`` of them, and that count."""
    power = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    held, least = 0, None
    for r in counts.groupBy(power.alias("power")).count().orderBy(F.col("power").desc()).collect():
        held += r["count"]
        if held > most:
            break
        least = r["power"]
    if least is None:
        return [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)], 1 << 30
    table = counts.where(power >= least).toPandas().sort_values("pair")
    return [table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()], least


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          head: int = HEAD, held_pairs: int = HELD_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` its ``keep`` columns, n_a, n_b, n_groups, n_links, n_best (links whose pair no other
    pair of its B id exceeds), count_sum (corpus counts over its links) and groups_sha256; and the corpus
    table (a, b, n, best) of linked id pairs.

    NULL and empty texts, and those that a side does not give back byte for byte, have no tokens: zeros
    and an empty digest. Repeated rows and rows without an id are aligned each. An empty table gives
    empty tables. A kept column called like a result column gives way to it.
    """
    results = (*_COUNTS, "n_best", "count_sum", "groups_sha256")
    kept = F.struct(*[c for c in keep if c not in results]).alias("kept")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), kept, F.col(text).alias("text"))
    marked = cut_lineage(aligned(rows, path_a, path_b, held_pairs))
    counts = pair_counts(marked)
    (top, top_n, top_best), least = _head(counts, head)

    base = marked.where(F.col("row").isNotNull()).select("row", "kept", *_COUNTS, "groups_sha256", "pairs", "links")
    schema = T.StructType([f for f in base.schema.fields if f.name not in ("pairs", "links")] + [
        T.StructField("near_best", T.LongType()), T.StructField("near_sum", T.LongType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.LongType()))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, links = (c.flatten().to_numpy() for c in batch.columns[-2:])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(batch.num_columns - 1).offsets.to_numpy()))
            at = np.minimum(np.searchsorted(top, pairs), max(0, len(top) - 1))
            here = top[at] == pairs if len(top) else np.zeros(len(pairs), dtype=bool)
            best, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(total, owner[here], top_n[at[here]] * links[here])
            np.add.at(best, owner[here], top_best[at[here]] * links[here])
            rest = np.searchsorted(owner[~here], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-2] + [pa.array(best), pa.array(total)] + [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~here])) for v in (pairs, links)],
                names=schema.names)

    known = cut_lineage(base.mapInArrow(look_up, schema))
    power = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    rare = known.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.links")
    met = rare.join(counts.where(power < least), "pair")
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.col("links")).alias("far_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("far_best"))
    zero = F.lit(0).cast("long")
    out = known.drop("pairs", "links").join(sums, "row", "left").select(
        "kept.*", *_COUNTS, (F.col("near_best") + F.coalesce("far_best", zero)).alias("n_best"),
        (F.col("near_sum") + F.coalesce("far_sum", zero)).alias("count_sum"), "groups_sha256")
    pairs = counts.select(F.floor(F.col("pair") / WIDTH).cast("int").alias("a"), F.pmod("pair", F.lit(WIDTH)).cast("int").alias("b"), "n", "best")
    return out, pairs
