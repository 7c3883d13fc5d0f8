"""Token counts by rank-synchronous array merging.

The vocabulary is a byte-pair encoding with word ends: text is brought to NFC, lower-cased and cut
into pre-tokens, each pre-token starts as its bytes, and the last byte carries the word end. The
distinct pre-tokens of a batch are held as one flat array of symbols with a sequence number beside
it (a ragged array). In each round every live sequence finds its lowest-rank pair and merges all
its occurrences at once, left to right; sequences without a pair are done, and the symbols that
survive are counted.

Memory is bounded: documents are taken in chunks of ``CHUNK_CHARS`` characters (one longer document
is a chunk of its own), and counts of at most ``MEMO_WORDS`` pre-tokens are remembered per task.
A count never depends on what is remembered.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 1_000_000
MEMO_WORDS = 300_000
_NONE = np.iinfo(np.int64).max
_SPACES = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the split pattern of the vocabulary (matches are kept, the rest is dropped).
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable bytes for themselves, the others
    numbered from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """Start symbols per byte (inside a word, at its end) and the pair table sorted by pair key."""

    inside: np.ndarray
    final: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    width: int
    special: regex.Pattern | None


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    end = spec["model"].get("end_of_word_suffix") or ""
    letters = byte_letters()
    width = max(vocab.values()) + 1
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    specials = [t["content"] for t in spec["added_tokens"]]
    return Merges(
        inside=np.array([vocab[c] for c in letters], dtype=np.int64),
        final=np.array([vocab[c + end] for c in letters], dtype=np.int64),
        keys=keys[order], rank=order.astype(np.int64), made=made[order], width=width,
        special=regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None)


def merged_lengths(words: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols of each non-empty word are left when no pair can be merged."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = sizes.copy()
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols = merges.inside[data]
    last = np.cumsum(sizes) - 1
    symbols[last] = merges.final[data[last]]
    owner = np.repeat(np.arange(len(words)), sizes)
    while len(symbols) > 1:
        key = symbols[:-1] * merges.width + symbols[1:]
        at = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        rank = np.where((merges.keys[at] == key) & (owner[:-1] == owner[1:]), merges.rank[at], _NONE)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(np.r_[rank, _NONE], first)
        length = np.diff(np.r_[first, len(symbols)])
        hit = (rank == np.repeat(lowest, length)[:-1]) & (rank != _NONE)
        where = np.flatnonzero(hit)
        if not len(where):
            break
        # a run of touching hits is one repeated symbol: every other one merges, from the left
        run = np.flatnonzero(np.r_[True, np.diff(where) != 1])
        place = np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))
        where = where[place % 2 == 0]
        symbols[where] = merges.made[at[where]]
        keep = np.repeat(lowest != _NONE, length)
        keep[where + 1] = False
        out -= np.bincount(owner[where], minlength=len(out))
        symbols, owner = symbols[keep], owner[keep]
    return out


def pre_tokens(text: str, merges: Merges) -> tuple[list[str], int]:
    """Pre-tokens of a text, and how many special strings stand in it."""
    parts = merges.special.split(text) if merges.special and "<|" in text else [text]
    words: list[str] = []
    for part in parts:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final form when lower-cased
        words += _SPLIT.findall(part.lower())
    return words, len(parts) - 1


class Counter:
    """Counts tokens of texts, remembering pre-tokens already merged."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.merges, self.memo, self.memo_words = load_merges(path), {}, memo_words

    def count(self, texts: list[str]) -> list[int]:
        cut = [pre_tokens(t, self.merges) for t in texts]
        new = list(set().union(*(w for w, _ in cut)).difference(self.memo))
        known = self.memo
        if new:
            fresh = dict(zip(new, merged_lengths([w.encode("utf-8", "surrogatepass") for w in new], self.merges).tolist(), strict=True))
            if len(known) + len(fresh) > self.memo_words:
                words = set().union(*(w for w, _ in cut))
                known = {w: known[w] for w in words if w in known}
            known = known | fresh if known is not self.memo else known
            if known is self.memo:
                known.update(fresh)
        out = [sum(map(known.__getitem__, w)) + s for w, s in cut]
        if known is not self.memo:
            self.memo = known if len(known) <= self.memo_words else {}
        return out


def chunks(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t) > limit:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def count_tokens(
    df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048
) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens, over_limit, one row per row of ``df``.

    A NULL text counts as empty: no bytes, no tokens. Repeated rows are counted each. An empty table
    gives an empty table. Columns beyond ``keep`` are not read; a kept column may not be called like
    a result column.
    """
    name = "text_to_count"
    while name in keep:
        name = f"_{name}"
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(name))
    schema = T.StructType([rows.schema[c] for c in keep] + [
        T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False),
        T.StructField("over_limit", T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n = np.array([k for part in chunks(texts, CHUNK_CHARS) for k in counter.count(part)], dtype=np.int64)
            size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(size), pa.array(n), pa.array(n > limit)],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)
