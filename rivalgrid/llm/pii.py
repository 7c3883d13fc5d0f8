"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the spans of the base patterns (email, ip, card, phone), which always stay, and those
of looser patterns (other phone numbers, social security numbers, account numbers, short cards,
names, spelled-out addresses). Four labelers vote on each: yes (1), no (-1) or nothing (0).

* format: does the value obey the strict rules of its kind?
* gazetteer: is its domain, prefix, country or name in, or against, a list?
* context: does a cue word (or one that speaks against it) stand before it?
* border: is it glued to other word characters?

Expectation-maximisation (Dawid and Skene) over the counts of vote patterns, a table of fixed size,
estimates how reliable each labeler is and how likely each pattern is personal data. Those
probabilities are the soft labels from which the final classifier learns, naive Bayes over what the
labelers do not see as such: the shape of the value, its length and the word before it. An added span
stays when the classifier finds it likelier than not and it overlaps no base span.

Positions come from cutting the text at the matches: the lengths of pieces and matches add up.
Patterns are written so that Java's matcher neither recurses nor backtracks on long runs.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalgrid.session import cut_lineage

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
_LABEL = r"A-Za-z0-9-"
# The base patterns. The email begins at the left end of its run or where the match before ended.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?=\.[{_LABEL}])(?:(?=[{_LABEL}]|\.[{_LABEL}])[{_LABEL}.])++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?=[0-9]|[\x20-][0-9])[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "shortcard": r"(?<![0-9.-])[0-9]{4}[\x20-]?[0-9]{4,6}[\x20-]?[0-9]{5}(?![0-9.-])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
    "spelled": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{2,63}){1,4}",
}
KINDS = tuple(PATTERNS)
# Cheap conditions that every text with a match meets.
GATES = {"email": ("contains", "@"), "phone": ("contains", "+"), "iban": ("rlike", r"[A-Z]{2}[0-9]{2}"),
         "ip": ("rlike", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": ("rlike", r"[0-9](?:[\x20-]?[0-9]){15}"),
         "spelled": ("rlike", r"(?i)[\[(]at[\])]")}
STRICT = {
    "email": r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$", "ip": r"^(?!0)(?:(?:0|[1-9][0-9]*)\.){3}(?:0|[1-9][0-9]*)$", "card": r"^[2-6]",
    "phone": r"^\+[1-9]", "national": r"^\(?[2-9][0-9]{2}\)?.[2-9]", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^[A-Z]{2}(?!00|01|99)[0-9]{2}", "shortcard": r"^3[0-9]", "name": r"\x20\p{Lu}\p{Ll}{2,}", "spelled": r"(?i)dot[\])]\x20?[a-z]{2,}$"}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", "ip": r"^(?!10\.|127\.|192\.168\.|169\.254\.|0\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|35|62|6011|65)", "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "national": r"^\(?(?:212|202|213|312|415|555|617|646|702|713|800|917)", "iban": r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU|PL|SE|DK|FI|NO)",
    "shortcard": r"^3[47]", "name": r"(?i)\x20(?:smith|jones|brown|miller|davis|garcia|martin|müller|schmidt|schneider|dubois|durand|lopez|perez)",
    "spelled": r"(?i)[\])]\x20?(?:com|org|net|edu|de|fr|es)$"}
CUES = {
    "email": r"(?i)(?:mail|contact|write|from|to|cc)\W*$", "ip": r"(?i)(?:\bip|addr\w*|host|server|client|login)\W*$",
    "card": r"(?i)(?:card|visa|master\w*|credit|pan|pay\w*)\W*$", "phone": r"(?i)(?:tel\w*|phone|call|mobile|fax|cell)\W*$",
    "national": r"(?i)(?:tel\w*|phone|call|mobile|fax|cell)\W*$", "ssn": r"(?i)(?:ssn|social|security|tax)\W*(?:no|number)?\W*$",
    "iban": r"(?i)(?:iban|account|konto|bank)\W*$", "shortcard": r"(?i)(?:card|amex|credit)\W*$", "name": r"(?i)(?:dear|by|with|from|signed)\W*$",
    "spelled": r"(?i)(?:mail|contact|write|reach)\W*$"}
AGAINST = r"(?i)(?:version|\bv|section|chapter|figure|page|price|order|invoice|isbn|release|build|part|[#$€=])\W*$"
SLOTS, BUCKETS, STEPS = 4, 256, 60
LABELERS = 4


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")

    def weigh(c: Column, i: Column) -> Column:
        x = c.cast("int") * (i % 2 + 1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(figures, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The rule by which a match of a base pattern fails or stays."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "shortcard":
        return F.length(digits(value)).between(13, 15) & luhn(digits(value))
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """Spans (start, end, value, before) of one kind, by start; ``before`` is up to 40 characters."""
    pattern = F.lit(PATTERNS[kind])
    how, what = GATES.get(kind, ("rlike", PATTERNS[kind]))
    gate = text.contains(what) if how == "contains" else text.rlike(what)
    none = F.array().cast("array<string>")
    pieces = F.when(gate, F.split(text, PATTERNS[kind], -1)).otherwise(none)
    matches = F.when(gate, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)
    zipped = F.arrays_zip(pieces.alias("piece"), matches.alias("match"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("value"), F.right(x["piece"], F.lit(40)).alias("before"))
        return F.when(x["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    walked = F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step)["spans"]
    return F.filter(walked, lambda s: passes(kind, s["value"]))


def votes(kind: str, s: Column) -> list[Column]:
    value, before = s["value"], s["before"]
    strict = F.when(value.rlike(STRICT[kind]), 1).otherwise(-1)
    listed = F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind in ("ip", "phone") else 0) if kind in GAZETTEER else F.lit(0)
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    border = F.when(before.rlike(r"[\p{L}\p{N}_]$"), -1).otherwise(1)
    return [strict, listed, context, border]


def described(kind: str, s: Column) -> Column:
    """A span with its vote pattern (a number in base 3) and the buckets of its features."""
    pattern = reduce(lambda a, v: a * 3 + v + 1, votes(kind, s), F.lit(0))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["value"], "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    last = F.lower(F.regexp_extract(s["before"], r"(\p{L}+)[^\p{L}]*$", 1))
    bucket = [F.lit(KINDS.index(kind)), F.pmod(F.xxhash64(shape), F.lit(BUCKETS)), F.least(F.length(s["value"]), F.lit(BUCKETS - 1)),
              F.pmod(F.xxhash64(last), F.lit(BUCKETS))]
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), pattern.cast("int").alias("pattern"),
        F.array(*[b.cast("int") for b in bucket]).alias("features"))


def pattern_votes(pattern: int) -> list[int]:
    out = []
    for _ in range(LABELERS):
        out.append(pattern % 3)
        pattern //= 3
    return out[::-1]


def reliabilities(counts: dict[tuple[int, int], int], steps: int = STEPS) -> dict[tuple[int, int], float]:
    """Probability of personal data per (kind, vote pattern), by EM over the counts of patterns.

    Each labeler has a chance of each vote (no, nothing, yes) given the truth, shared by all kinds;
    each kind has a rate of its own. It starts from the mean of the votes; half a count is added to
    every cell, so no chance is ever nought.
    """
    votes_of = {p: pattern_votes(p) for _, p in counts}
    post = {}
    for k, p in counts:
        cast = [v - 1 for v in votes_of[p] if v != 1]
        post[k, p] = 0.5 + 0.4 * (sum(cast) / len(cast)) if cast else 0.5
    for _ in range(steps):
        chance = [[[0.5] * 3, [0.5] * 3] for _ in range(LABELERS)]
        rate: dict[int, list[float]] = {}
        for (k, p), n in counts.items():
            y = post[k, p]
            r = rate.setdefault(k, [1.0, 1.0])
            r[0] += n * (1 - y)
            r[1] += n * y
            for j, v in enumerate(votes_of[p]):
                chance[j][0][v] += n * (1 - y)
                chance[j][1][v] += n * y
        chance = [[[c / sum(row) for c in row] for row in rows] for rows in chance]
        new = {}
        for k, p in counts:
            odds = math.log(rate[k][1]) - math.log(rate[k][0])
            odds += sum(math.log(chance[j][1][v]) - math.log(chance[j][0][v]) for j, v in enumerate(votes_of[p]))
            new[k, p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        done = max((abs(new[x] - post[x]) for x in new), default=0.0) < 1e-9
        post = new
        if done:
            break
    return post


def _lookup(table: dict[int, float], key: Column, missing: float) -> Column:
    """A value from a small literal map."""
    if not table:
        return F.lit(missing)
    literal = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.coalesce(F.try_element_at(literal, key), F.lit(missing))


def classify(spans: DataFrame, column: str) -> Column:
    """The final classifier: a function of a span's features, as a column of the log odds of the
    array elements, learnt from all spans of ``column`` in ``spans``."""
    each = spans.where(F.size(column) > 0).select(F.explode(column).alias("s"))
    counted = each.groupBy("s.kind", "s.pattern").count().collect()  # at most kinds times 3 ** labelers rows
    post = reliabilities({(r["kind"], r["pattern"]): r["count"] for r in counted})
    key = F.col("s.kind") * 3**LABELERS + F.col("s.pattern")
    soft = _lookup({k * 3**LABELERS + p: y for (k, p), y in post.items()}, key, 0.5)
    sums = (
        each.select(soft.alias("y"), F.posexplode("s.features").alias("slot", "bucket")).groupBy("slot", "bucket")
        .agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).collect())  # at most slots times buckets rows
    yes = [1.0 + sum(r["yes"] for r in sums if r["slot"] == s) for s in range(SLOTS)]
    no = [1.0 + sum(r["no"] for r in sums if r["slot"] == s) for s in range(SLOTS)]
    weight = {r["slot"] * BUCKETS + r["bucket"]: math.log((r["yes"] + 0.5) / yes[r["slot"]]) - math.log((r["no"] + 0.5) / no[r["slot"]]) for r in sums}
    start = math.log(yes[0] / no[0])

    def odds(s: Column) -> Column:
        return reduce(lambda a, j: a + _lookup(weight, F.lit(j * BUCKETS) + s["features"][j], 0.0), range(SLOTS), F.lit(start))

    return F.filter(column, lambda s: (s["kind"] >= len(BASE_KINDS)) & (odds(s) > 0))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added, one row per row of ``df``: spans (kind, start, end) in code points, end
    exclusive, by kind as listed, then start.

    A NULL text is an empty one and has no spans; equal texts have equal spans. Whole texts are
    read. Other columns are not read; an empty table gives an empty table.
    """
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    raw = rows.select("id", *[found(F.col("text"), k).alias(k) for k in KINDS])
    spans = cut_lineage(raw.select(
        "id", F.concat(*[F.transform(k, partial(described, k)) for k in KINDS]).alias("spans")))
    added = classify(spans, "spans")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    both = spans.select("id", base.alias("base"), added.alias("added"))
    free = F.filter("added", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(s: Column) -> Column:
        return F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    return both.select(F.col("id").alias(doc_id), F.transform("base", named).alias("base"), F.transform(free, named).alias("added"))
