"""Secret scans: fixed patterns, and a battery of randomness tests for strings no pattern names.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). Besides them, every
maximal run of key characters that lies outside the base spans is a candidate. A run that no alphabet
holds, since it has '/' or '+' beside '-' or '_', is split both at the former and at the latter, and
every part long enough is a candidate, so parts of the two splits may overlap. The encoding is
inferred from the characters, and three tests ask whether they look drawn at random from its alphabet:

* chi-squared: are the symbols of the alphabet used evenly?
* runs: do values above and below the middle of the alphabet alternate as coin flips do?
* serial correlation: do neighbouring values hang together?

Each gives a p-value, which is large for a random string; the three are combined by the Cauchy rule,
which holds under dependence. Words, names and counters fail the tests. Which candidates fail is
settled for the whole corpus by Benjamini-Hochberg within classes of length: short strings give
small evidence, long ones large, and within each class at most the share ``RATE`` of the strings
called structured is random, as far as the p-values of short strings hold. Candidates not called
structured, and long enough for the tests to have power over their alphabet (``LEAST_BITS``), are
reported.

The thresholds come from counts of p-value bins per length class over the distinct candidates of all
documents, so copies of one string weigh as one. Bins are even in log p, so however small the share
of structured strings is, some bin lies below what it asks for. The counts are a table of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalgrid.session import cut_lineage

# The base patterns.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Parts of a candidate that no alphabet holds.
PARTS = (re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"))
LEAST_BITS, RATE = 80, 0.01
# p-value bins: so many per power of ten, from 10 ** -DECADES up; smaller values are in the first.
PER_DECADE, DECADES = 20, 15
BINS = PER_DECADE * DECADES
# Length classes: up to each bound, then everything longer.
CLASSES = (24, 32, 48, 64, 128)

# Alphabets from the narrowest to the widest; a string has the first that holds all its characters.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]


def infer_encoding(s: str) -> tuple[str, np.ndarray, int] | None:
    """Name of the encoding, the values of the characters and the size of the alphabet. None where no
    alphabet holds all characters."""
    body = s.rstrip("=")
    used = set(body)
    for name, chars, value in _SETS:
        if used <= chars:
            return name, np.fromiter((value[c] for c in body), dtype=np.int64, count=len(body)), len(chars)
    return None


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(values: np.ndarray, size: int) -> float:
    """Upper tail of the chi-squared statistic of evenness (Wilson-Hilferty)."""
    counts = np.bincount(values, minlength=size)
    expected = len(values) / size
    statistic, free = float(((counts - expected) ** 2).sum() / expected), size - 1
    spread = 2 / (9 * free)
    return _upper_normal(((statistic / free) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def runs_p(values: np.ndarray, size: int) -> float:
    """Two-sided Wald-Wolfowitz test on values in the upper half of the alphabet."""
    high = values >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    n = a + b
    if a == 0 or b == 0:
        return 2.0 ** (1 - n)
    runs = 1 + int(np.count_nonzero(high[1:] != high[:-1]))
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return 1.0 if variance <= 0 else 2 * _upper_normal(abs(runs - mean) / math.sqrt(variance))


def serial_p(values: np.ndarray) -> float:
    """Two-sided test of the correlation of each value with the next."""
    x = values - values.mean()
    square = float((x * x).sum())
    if square == 0:
        return 2.0 ** (1 - len(values))
    return 2 * _upper_normal(abs(float((x[1:] * x[:-1]).sum()) / square) * math.sqrt(len(values)))


def combined_p(ps: list[float]) -> float:
    """Cauchy combination. A p-value near 1 counts as 0.99: runs take few values, a p-value of 1 is one
    of them, and would outweigh any evidence of the others."""
    t = sum(1 / math.tan(min(max(p, 1e-15), 0.99) * math.pi) for p in ps) / len(ps)
    return math.atan2(1, t) / math.pi


def randomness(s: str) -> tuple[str, float] | None:
    """Encoding and combined p-value of a candidate; None where it is no candidate or too short for
    its alphabet."""
    found = infer_encoding(s)
    if found is None:
        return None
    name, values, size = found
    if len(values) * math.log2(size) < LEAST_BITS:
        return None
    return name, combined_p([chi_squared_p(values, size), runs_p(values, size), serial_p(values)])


def by_start(a: Column, b: Column) -> Column:
    """Order of spans: by start, then kind as listed."""
    place = lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0))
    return (F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)))


def length_class(n: int) -> int:
    return sum(n > bound for bound in CLASSES)


def p_bin(p: float) -> int:
    return min(max(int((math.log10(max(p, 1e-300)) + DECADES) * PER_DECADE), 0), BINS - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out)


def stretches(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans leave of each run of key characters."""
    covered, i, reach = sorted((a, b) for a, _, b in base), 0, 0
    for m in CANDIDATE.finditer(text):
        at = max(m.start(), reach)
        while i < len(covered) and covered[i][0] < m.end():
            if covered[i][0] > at:
                yield at, covered[i][0]
            reach, i = max(reach, covered[i][1]), i + 1
            at = max(at, reach)
        if at < m.end():
            yield at, m.end()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Candidates, which overlap no base span, with length class, p-value bin and a number for the string."""
    places = []
    for a, b in stretches(text, base):
        for m in CANDIDATE.finditer(text, a, b):
            if infer_encoding(m[0]):
                places.append(m.span())
            else:
                places += sorted(part.span() for pattern in PARTS for part in pattern.finditer(text, a, b))
    out = []
    for a, b in places:
        tested = randomness(text[a:b])
        if tested:
            number = int.from_bytes(hashlib.blake2b(text[a:b].encode(), digest_size=8).digest(), "big", signed=True)
            out.append({"start": a, "end": b, "encoding": tested[0], "p": tested[1],
                        "class": length_class(len(text[a:b].rstrip("="))), "bin": p_bin(tested[1]), "string": number})
    return out


def thresholds(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    """Per length class the number of lowest p-value bins called structured: the largest k with
    edge(k) <= RATE * share of candidates in the first k bins (Benjamini-Hochberg on binned p)."""
    table = np.zeros((len(CLASSES) + 1, BINS))
    for c, b, n in counts:
        table[c, b] += n
    edges = 10.0 ** (np.arange(1, BINS + 1) / PER_DECADE - DECADES)
    out = {}
    for c, row in enumerate(table):
        share = np.cumsum(row) / max(row.sum(), 1)
        ok = np.flatnonzero(edges <= RATE * share)
        out[c] = int(ok[-1]) + 1 if len(ok) else 0
    return out


_CANDIDATES = "array<struct<start:bigint,end:bigint,encoding:string,p:double,class:int,bin:int,string:bigint>>"
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and random, one row per row of ``df``.

    ``base`` holds the spans (kind, start, end; code points, end exclusive) by start, then kind;
    ``random`` holds the added ones (kind ``random-<encoding>``), which overlap no base span. A NULL
    text is an empty one and has no spans; equal texts have equal base spans. Whole texts are read,
    whatever their length. Other columns are not read; an empty table gives an empty table.
    """
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("p", pa.float64()),
                                    ("class", pa.int32()), ("bin", pa.int32()), ("string", pa.int64())]))
        for batch in batches:
            base, more = [], []
            for t in batch.column(1).to_pylist():
                b = base_spans(t)
                base.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in b])
                more.append(candidates(t, b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, type=spans), pa.array(more, type=found)], names=["id", "base", "candidates"])

    scanned = cut_lineage(rows.mapInArrow(find, f"id {kind}, base {_SPANS}, candidates {_CANDIDATES}"))
    counted = (
        scanned.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c"))
        .select("c.class", "c.bin", "c.string").distinct()
        .groupBy("class", "bin").count().collect())  # at most classes times bins rows
    cut = thresholds([(r["class"], r["bin"], r["count"]) for r in counted])
    limit = F.create_map(*[F.lit(v) for kv in cut.items() for v in kv])
    random = F.transform(
        F.filter("candidates", lambda c: c["bin"] >= F.element_at(limit, c["class"])),
        lambda c: F.struct(F.concat(F.lit("random-"), c["encoding"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return scanned.select(F.col("id").alias(doc_id), "base", random.alias("random"))
