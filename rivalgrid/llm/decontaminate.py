"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item is cut into windows of ``window`` words (a shorter item is one window). A window is a set of
shingles of ``SHINGLE`` words, ordered by how rare each is in the documents. A document holds a window
only if it holds all its shingles, so the prefix that must be shared is the rarest shingle alone: the
join is on that token. A pair is kept only if the window fits between the ends of the document when
laid over the shingle (length and position), and then the words are compared one by one. A window one
of whose shingles is in no document is in none and is not joined.

Words and shingles of documents are hashed in numpy; hashes choose candidates and never decide. Which
hashes matter is a bit map of ``2**SLOT_BITS`` bits whatever the benchmark holds, the one thing that
every task gets; the join itself goes by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rivalgrid.llm.common import fresh
from rivalgrid.session import cut_lineage

SHINGLE, SLOT_BITS, CHUNK_BYTES = 5, 24, 1 << 21
# A-Z become a-z; ASCII letters, digits and all beyond ASCII make words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BYTE = np.zeros(256, dtype=np.uint8)
for _c in (LOWER + "0123456789").encode():
    _BYTE[_c] = _c
_BYTE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTE[128:] = np.arange(128, 256)
_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers_up_to(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)], dtype=np.uint64)
    return _powers


class Words:
    """The words of a run of texts: places of their bytes, the first word of each text, a hash each."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        self.chars = _BYTE[data]
        inside = self.chars != 0
        begin, final = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        final[:-1] &= ~inside[1:]
        heads, tails = edges[:-1][edges[:-1] < len(data)], edges[1:][edges[1:] > 0] - 1
        begin[heads], final[tails] = inside[heads], inside[tails]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(final) + 1
        self.first = np.searchsorted(self.start, edges)
        self.owner = np.repeat(np.arange(len(edges) - 1), np.diff(self.first))
        power, inverse = _powers_up_to(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.chars * power[: len(data)], out=sums[1:])
        self.hash = _mixed((sums[self.end] - sums[self.start]) * inverse[self.start])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at which shingles of ``width`` words start, and their hashes as signed numbers."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        total = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            total = total * np.uint64(_ODD) + self.hash[i : i + n]
        at = np.flatnonzero(self.owner[:n] == self.owner[width - 1 :])
        return at, _mixed(total[at]).view(np.int64)

    def phrase(self, begin: int, end: int) -> bytes:
        """Words begin to end, one blank between them."""
        return b" ".join(self.chars[s:e].tobytes() for s, e in zip(self.start[begin:end].tolist(), self.end[begin:end].tolist(), strict=True))


def runs(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, edges) of runs of texts of at most ``limit`` bytes; a longer text is a run of its own."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def _bits(tokens: DataFrame) -> np.ndarray:
    """Bit map of the tokens' slots, as numbers of 64 bits: a table of fixed size."""
    slot = F.shiftrightunsigned("token", 64 - SLOT_BITS)
    rows = tokens.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - SLOT_BITS}) & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << SLOT_BITS - 6, dtype=np.int64)
    bits[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return bits


def _is_set(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    slot = tokens.view(np.uint64) >> np.uint64(64 - SLOT_BITS)
    return (bits.view(np.uint64)[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, phrase, size), and which items hold them (window_id, item)."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(window)), " "))
    held = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    held = cut_lineage(held.select("item", F.explode(F.array_distinct(cut)).alias("phrase")).distinct())
    windows = cut_lineage(held.select("phrase").distinct().select(
        F.monotonically_increasing_id().alias("window_id"), "phrase", F.size(F.split("phrase", " ")).alias("size")))
    return windows, windows.join(held.where(F.col("item").isNotNull()), "phrase").select("window_id", "item")


def window_tokens(windows: DataFrame, shingle: int) -> DataFrame:
    """(window_id, token, offset): the shingles of each window, of ``shingle`` words or of all it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, edges in runs(batch.column(1)):
                words = Words(data, edges)
                sizes = np.diff(words.first)
                for width in range(1, shingle + 1):
                    at, token = words.shingles(width)
                    ok = (sizes[words.owner[at]] == width) if width < shingle else np.ones(len(at), dtype=bool)
                    at, token = at[ok], token[ok]
                    owner = words.owner[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, end - begin).take(pa.array(owner)), pa.array(token), pa.array((at - words.first[owner]).astype(np.int32))],
                        names=["window_id", "token", "offset"])

    return windows.select("window_id", "phrase").mapInArrow(run, "window_id long, token long, offset int")


def token_counts(docs: DataFrame, text: str, tokens: DataFrame, widths: list[int]) -> DataFrame:
    """(token, n): how often the tokens, and few others, occur in all documents."""
    bits = _bits(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, edges in runs(batch.column(0)):
                words = Words(data, edges)
                for width in widths:
                    token = words.shingles(width)[1]
                    token, n = np.unique(token[_is_set(bits, token)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select(text).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def rarest_tokens(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """The rarest token of each window all of whose tokens occur in documents."""
    order = Window.partitionBy("window_id").orderBy(F.col("n").asc_nulls_first(), "token", "offset")
    ranked = tokens.join(counts, "token", "left").withColumn("place", F.row_number().over(order))
    return ranked.where("place = 1 and n is not null").select("window_id", "token", "offset")


def occurrences(docs: DataFrame, tokens: DataFrame, widths: list[int], window: int) -> DataFrame:
    """The rows (row, kept, text) without their text, with n_words and found, the places where tokens stand:
    token, word number, and the words around it (``at`` of them before it) that a window over it can reach."""
    bits = _bits(tokens)
    spot = T.StructType([T.StructField("token", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("context", T.StringType())])
    schema = T.StructType([docs.schema["row"], docs.schema["kept"], T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(spot))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, edges in runs(batch.column(2)):
                words = Words(data, edges)
                first = words.first
                hits = []
                for width in widths:
                    at, token = words.shingles(width)
                    ok = _is_set(bits, token)
                    hits.append((at[ok], token[ok], np.full(int(ok.sum()), width)))
                at, token, width = (np.concatenate(parts) for parts in zip(*hits, strict=True))
                order = np.argsort(at, kind="stable")
                at, token, width = at[order], token[order], width[order]
                owner = words.owner[at]
                low, high = np.maximum(at + width - window, first[owner]), np.minimum(at + window, first[owner + 1])
                context = [words.phrase(a, b).decode("utf-8", "replace") for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                spots = pa.StructArray.from_arrays(
                    [pa.array(token), pa.array((at - first[owner]).astype(np.int64)), pa.array((at - low).astype(np.int32)), pa.array(context, type=pa.string())],
                    names=spot.names)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(end - begin + 1)).astype(np.int32)), spots)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(begin, end - begin) for c in batch.columns[:2]] + [pa.array(np.diff(first).astype(np.int64)), lists],
                    names=schema.names)

    return docs.select("row", "kept", "text").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns of every row of ``docs``, and n_words, n_hit (words inside any occurrence of a
    window), n_items, items (ids as sorted strings), spans (ranges of hit words, end exclusive, that
    neither overlap nor touch) and contaminated (n_hit > 0).

    A NULL or empty text has no words. Items without words have no window. An item whose id is NULL
    marks words but is neither counted nor listed; rows of one item id are one item. Repeated rows and
    rows without an id are judged each. Empty documents give an empty table, an empty benchmark hits
    nothing. A kept column called like a result column gives way to it; others do not matter.
    """
    results = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    windows, held = item_windows(items, window, item_id, item_text)
    tokens = cut_lineage(window_tokens(windows, shingle))
    short = [r["size"] for r in windows.where(F.col("size") < shingle).select("size").distinct().collect()]
    widths = sorted({*short, shingle})
    rarest = cut_lineage(rarest_tokens(tokens, token_counts(docs, text, tokens, widths)))

    kept = F.struct(*[c for c in keep if c not in results]).alias("kept")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), kept, F.col(text).alias("text"))
    marked = cut_lineage(occurrences(numbered, rarest, widths, window))
    spots = marked.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")

    # length and position: the window, laid over the token, lies between the ends of the context
    begins = F.col("at") - F.col("offset")
    fits = (begins >= 0) & (begins + F.col("size") <= F.size("around"))
    same = F.array_join(F.slice("around", begins + 1, F.col("size")), " ") == F.col("phrase")
    spots = spots.withColumn("around", F.split("context", " ")).drop("context")
    joined = spots.join(rarest.join(windows, "window_id"), "token").where(fits).where(same)
    hits = cut_lineage(joined.select("row", "window_id", (F.col("pos") - F.col("offset")).alias("start"), "size"))

    order = Window.partitionBy("row").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = hits.select("row", "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    ranges = ranges.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    islands = ranges.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("stop").alias("end"))
    spans = islands.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("at"))

    # documents with the same windows have the same items: found once for each set of windows
    sets = hits.groupBy("row").agg(F.array_sort(F.collect_set("window_id")).alias("ids"))
    sets = cut_lineage(sets.withColumn("key", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)))
    members = sets.groupBy("key").agg(F.first("ids").alias("ids")).select("key", F.explode("ids").alias("window_id"))
    listed = members.join(held, "window_id").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    per_row = sets.select("row", "key").join(listed, "key", "left").select("row", F.col("ids").alias("of"))

    none = F.array().cast("array<string>")
    out = marked.drop("found").join(spans.join(per_row, "row"), "row", "left")
    return out.select(
        "kept.*", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("of", none)).cast("long").alias("n_items"), F.coalesce("of", none).alias("items"),
        F.coalesce("at", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.col("hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", **names: str) -> DataFrame:
    """Rows of ``docs`` that hold no window of any item; all columns as they are."""
    flag = fresh(docs, "contaminated")[0]
    whole = fresh(docs.withColumn(flag, F.lit(0)), "whole")[0]
    packed = docs.select(F.struct(*docs.columns).alias(whole), F.col(text).alias(text))
    judged = decontaminate(packed, items, window, text, keep=(whole,), **names)
    return judged.where(~F.col("contaminated")).select(f"{whole}.*")
