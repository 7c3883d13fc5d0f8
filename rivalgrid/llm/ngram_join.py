"""Near duplicates by an n-gram Jaccard join with several global token orders.

A document is the set of its distinct word n-grams, each a 63-bit number. Two sets of similarity at
least t share a token among the first floor((1 - t) n) + 1 of each, in any order of all tokens that
both follow. The orders here put tokens of few documents first, and differ in how they break up the
rest: by (documents, number), by (documents, number downwards) and by (power of two of documents,
mixed number). A pair is a candidate only if it shares a prefix token under every one of them; the
sets themselves are compared last.

A first pass takes only a slice. Any global order will do, so it begins with the tokens whose number
lies in the lowest part of the number range, large enough to hold all prefixes; only those tokens are
counted and joined, and a document whose slice is too short adds its next tokens. Longer documents
need a smaller part, so documents are dealt to classes by size, each with its own part; a document
near the upper end of its class joins the next one too, so every pair within the threshold meets in
the class of its smaller set. A token that one document has makes no candidate, and fills that
document's prefix: most documents leave the join there. The second pass counts all tokens of those
that are left and takes their prefixes under the three orders.

No all-pairs. Equal sets are one node. In a first round every node meets one pivot, which settles
tokens that only a group of copies has. The nodes of tokens still open are dealt to finer groups by
their differences from one of them (``_by_difference``). In each further round every group names
pivots among its nodes and the others meet them as one list; nodes are compared with pivots outside
their component, links join components, and pivots leave the group, which is settled when the nodes
left lie in one component. No link between components is missed, as one end of it must become a pivot.

Groups overlap, and near copies share many, so what meets is first held against a sketch: the parity
of the number of tokens in each of some hundred slots. A token in which two sets differ turns one
parity, so sets differ in at least as many tokens as their sketches in parities; a node lists only the
pivots that this leaves, each once. Components are kept as tables; the driver sees counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.session import cut_lineage, cuts, drop_tables, free_shuffles

CLASS_STARTS = (1, 128, 512, 2048)
PIVOTS = 1
#: Pivots that a group names in one round at most; the others wait for the next.
MOST_PIVOTS = 1024
#: Slots of a sketch for each token in which linked sets may differ.
SLOTS = 12
#: Nodes that an open token may have without being dealt out by difference.
FEW = 64
#: Rows up to which a table of (id, node) is sent to all executors (about 10 MB); beyond, it is shuffled.
SMALL_TABLE = 200_000
_TOP = 1 << 63
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct n-grams as sorted 63-bit numbers. ASCII letters are lower-cased, words end at the six
    ASCII white space characters; a text of fewer words is one n-gram, a text of none has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(parts))
    out = np.full(len(parts) - span + 1, span, np.uint64)
    for j in range(span):
        out = _mixed(out * _MIX[2] + h[j:j + len(out)])
    return np.unique((out >> np.uint64(1)).astype(np.int64))


@dataclass(frozen=True)
class Plan:
    """The threshold as an exact ratio, and per size class its bounds and its part of the number range."""

    words: int
    top: int
    bottom: int
    classes: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(words: int, percent: int) -> Plan:
        miss = 1 - percent / 100
        classes = []
        for i, low in enumerate(CLASS_STARTS):
            high = (CLASS_STARTS[i + 1] - 1) * 100 // percent if i + 1 < len(CLASS_STARTS) else 1 << 62
            part = 1.0
            if i:
                # four standard deviations above what the prefixes of the shortest documents need
                part = next(p / 200 for p in range(1, 201) if p / 200 * low - 4 * math.sqrt(low * p / 200 * (1 - p / 200)) >= miss * low + 1 or p == 200)
            classes.append((low, high, int(part * (_TOP - 1))))
        return Plan(words, percent, 100, tuple(classes))

    def spare(self, n: int) -> int:
        """Tokens that a set of n may have alone in a linked pair."""
        return n - -(-n * self.top // self.bottom)

    def sketch(self, tokens: np.ndarray) -> np.ndarray:
        """Whether the number of tokens is odd, for each of a power of two of slots, 64 to a number."""
        most = len(tokens) * (self.bottom - self.top) // self.top
        slots = 64 << max(0, SLOTS * most // 64).bit_length()
        odd = np.bincount(tokens & (slots - 1), minlength=slots).astype(np.uint8) & 1
        return np.packbits(odd, bitorder="little").view("<i8")

    def slices(self, tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n = len(tokens)
        for c, (low, high, limit) in enumerate(self.classes):
            if low <= n <= high:
                inside = int(np.searchsorted(tokens, limit, side="right"))
                yield c, tokens[: max(inside, min(n, self.spare(n) + 1))]


def _slices(docs: DataFrame, plan: Plan) -> DataFrame:
    """id, n, print (of the whole set, NULL if empty), row, and per size class its slice of tokens."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.list_(pa.struct([("c", pa.int32()), ("tokens", pa.list_(pa.int64()))]))
        for batch in batches:
            size, mark, slices = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, plan.words)
                size.append(len(s))
                mark.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                slices.append([{"c": c, "tokens": t} for c, t in plan.slices(s)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(slices, parts)],
                names=["id", "n", "print", "slices"])

    cut_up = docs.mapInArrow(cut, f"id {kind}, n long, print binary, slices array<struct<c:int,tokens:array<bigint>>>")
    return cut_lineage(cut_up.withColumn("row", F.monotonically_increasing_id()))


def spare(n: Column, plan: Plan) -> Column:
    """``Plan.spare`` as a column."""
    return n - F.ceil(n * plan.top / F.lit(plan.bottom))


def _first(met: str, room: str, order: Callable[[Column], tuple[Column, Column]]) -> Column:
    """The first ``room`` tokens of ``met`` (df, token) in an order."""
    keyed = F.transform(met, lambda s: F.struct(*[k.alias(n) for k, n in zip(order(s), ("major", "minor"), strict=True)], s["token"].alias("token")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), F.col(room)), lambda s: s["token"])


def _alive(sliced: DataFrame, plan: Plan) -> DataFrame:
    """node and print of the sets whose prefix within their slice holds a token of another document; one
    node stands for all rows of a print."""
    each = sliced.select("row", F.explode("slices").alias("s")).select("row", F.col("s.c").alias("c"), F.col("s.tokens").alias("tokens"))
    postings = each.select("row", "c", F.explode("tokens").alias("token"))
    shared = cut_lineage(postings.groupBy("token", "c").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token", "c"))
    free_shuffles(sliced.sparkSession)
    met = postings.join(shared, ["token", "c"]).groupBy("row", "c").agg(F.count(F.lit(1)).alias("met"))
    sizes = sliced.select("row", "print", "n", F.explode("slices").alias("s")).select(
        "row", "print", "n", F.col("s.c").alias("c"), F.size("s.tokens").alias("taken"))
    # tokens of this document alone come first in every order and fill the prefix
    rows = met.join(sizes, ["row", "c"]).where(spare(F.col("n"), plan) + 1 > F.col("taken") - F.col("met"))
    alive = cut_lineage(rows.groupBy("print").agg(F.min("row").alias("node")))
    free_shuffles(sliced.sparkSession)
    return alive


def _prefixes(sets: DataFrame, plan: Plan) -> DataFrame:
    """node, n, over, sketch, met (tokens that other nodes have too) and the prefixes p1, p2, p3 under the
    three orders, for nodes whose prefix over the whole set holds a token of another node.

    ``over`` says by how much the tokens that a node has alone exceed its share of what two linked
    sets may differ in: linked sets have D (bottom + top) <= (n + n') (bottom - top) for a difference
    of D, so the sum of their ``over`` is at most 0.
    """
    postings = sets.select("node", F.explode("tokens").alias("token"))
    shared = cut_lineage(postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    met = postings.join(shared, "token").groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("met"))
    ranked = (
        met.join(sets.select("node", F.size("tokens").cast("long").alias("n"), "sketch"), "node").withColumn("alone", F.col("n") - F.size("met"))
        .withColumn("room", (spare(F.col("n"), plan) + 1 - F.col("alone")).cast("int")).where("room > 0"))
    free_shuffles(sets.sparkSession)
    power = lambda s: F.floor(F.log2(s["df"].cast("double")))
    return cut_lineage(ranked.select(
        "node", "n", "sketch", (F.col("alone") * (plan.bottom + plan.top) - F.col("n") * (plan.bottom - plan.top)).alias("over"),
        F.transform("met", lambda s: s["token"]).alias("met"),
        _first("met", "room", lambda s: (s["df"], s["token"])).alias("p1"),
        _first("met", "room", lambda s: (s["df"], -s["token"])).alias("p2"),
        _first("met", "room", lambda s: (power(s), F.xxhash64(s["token"]))).alias("p3")))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SMALL_TABLE else table


def _sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """node, its whole set and its sketch, for the nodes of ``wanted`` (id, print, node)."""
    ids = cut_lineage(wanted.select("id").distinct())
    texts = docs.join(_small(ids, ids.count()), "id", "left_semi").unionByName(docs.where(F.col("id").isNull()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, plan.words) for t in batch.column(1).to_pylist()]
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            sketches = [plan.sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["print", "tokens", "sketch"])

    nodes = wanted.select("print", "node")
    found = texts.mapInArrow(whole, "print binary, tokens array<bigint>, sketch array<bigint>").join(_small(nodes, nodes.count()), "print")
    sets = cut_lineage(found.groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    free_shuffles(docs.sparkSession)
    return sets


def parities_apart(a: Column, b: Column) -> Column:
    """In how many slots two sketches differ; a sketch of twice the slots is folded in two first. 0, which
    rules nothing out, where one has more than that."""
    odd = lambda x, y: x.bitwiseXOR(y)
    halves = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)), odd)
    count = lambda x, y: F.aggregate(F.zip_with(x, y, odd), F.lit(0), lambda n, bits: n + F.bit_count(bits))
    return (
        F.when(F.size(a) == F.size(b), count(a, b)).when(F.size(a) == F.size(b) * 2, count(halves(a), b))
        .when(F.size(a) * 2 == F.size(b), count(a, halves(b))).otherwise(0))


def _verified(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that share prefixes under the other two orders and are similar enough. What two
    nodes have in common is among the tokens that other nodes have too, so those are compared."""
    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    known = nodes.join(_small(asked, asked.count()), "node", "left_semi")

    def side(x: str) -> DataFrame:
        return known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("p2").alias(f"{x}2"), F.col("p3").alias(f"{x}3"), F.col("met").alias(f"met{x}"))

    common = F.size(F.array_intersect("meta", "metb"))
    return cut_lineage(
        pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
        .where(common * (plan.bottom + plan.top) >= (F.col("na") + F.col("nb")) * plan.top).select("a", "b"))


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after joining the components that ``links`` (a, b) connect: every
    component hooks to its smallest neighbour until no link leaves a component."""
    while not links.isEmpty():
        of_a = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        of_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        open_links = links.join(of_a, "a").join(of_b, "b").where("ca <> cb").select("ca", "cb")
        both = open_links.unionByName(open_links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        hooks = cut_lineage(both.groupBy(F.col("ca").alias("comp")).agg(F.min("cb").alias("up")).where("up < comp"))
        if hooks.isEmpty():
            break
        # one step further up where the neighbour hooks too
        above = hooks.select(F.col("comp").alias("up"), F.col("up").alias("upper"))
        ups = hooks.join(above, "up", "left").select("comp", F.coalesce("upper", "up").alias("up"))
        labels = cut_lineage(labels.join(ups, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
    return labels


def _by_difference(members: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The groups of ``members`` (token, node, n, over) cut finer, such that linked nodes of one token still
    share a group.

    Nodes that differ from one of them in a few tokens each all share its tokens, so a prefix cannot tell
    them apart. What they differ in can: of two nodes, the tokens in which they differ from each other are
    those in which exactly one of them differs from a reference set. So per token, nodes are written as
    their differences from the tokens of one reference node. Two nodes whose differences are ``far`` and
    ``far'`` long can be linked only if they have so many differences in common that no more than the
    threshold's D are left: (far + far' - D) / 2. That is an overlap join, and has prefixes again, under
    the order of the differences by how many nodes of the token have them; nodes of similar length meet, in
    classes of length, and those that need nothing in common meet in a group of their own.
    """
    spark, start = nodes.sparkSession, len(cuts(nodes.sparkSession))
    asked = cut_lineage(members.select("node").distinct())
    sets = cut_lineage(nodes.select("node", "met", (F.col("n") - F.size("met")).alias("alone")).join(_small(asked, asked.count()), "node", "left_semi"))
    about = members.join(sets.select("node", "alone"), "node")
    pivot = about.groupBy("token").agg(F.min(F.struct("alone", "over", "node")).alias("p")).select("token", F.col("p.node").alias("node"))
    reference = pivot.join(sets.select("node", F.col("met").alias("ref")), "node").select("token", "ref")
    apart = members.join(sets, "node").join(reference, "token").select(
        "token", "node", "n", "over", "alone", F.concat(F.array_except("met", "ref"), F.array_except("ref", "met")).alias("e"))
    apart = cut_lineage(apart.withColumns({
        "far": F.col("alone") + F.size("e"), "most": F.floor(F.col("n") * (plan.bottom - plan.top) / F.lit(plan.top))}))
    each = apart.select("token", "node", F.explode("e").alias("e"))
    common = cut_lineage(each.groupBy("token", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = each.join(common, ["token", "e"]).groupBy("token", "node").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("shared"))
    width = apart.groupBy("token").agg(F.greatest(F.lit(1), F.floor(F.max("most") / 2)).cast("long").alias("width"))
    rows = apart.drop("e").join(shared, ["token", "node"], "left").join(width, "token")
    rows = rows.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<df:bigint,e:bigint>>")))
    low, high = F.floor(F.greatest(F.lit(0), F.col("far") - F.col("most")) / F.col("width")), F.floor((F.col("far") + F.col("most")) / F.col("width"))
    rows = rows.withColumns({"own": F.floor(F.col("far") / F.col("width")), "other": F.explode(F.sequence(low, high))})
    needed = F.ceil((F.col("far") + F.col("other") * F.col("width") - F.col("most")) / 2)
    room = F.col("far") - F.greatest(needed, F.lit(1)) + 1 - (F.col("far") - F.size("shared"))
    first = F.transform(F.slice("shared", F.lit(1), F.greatest(room, F.lit(0)).cast("int")), lambda s: s["e"])
    keys = F.when(needed <= 0, F.concat(first, F.array(F.lit(-1).cast("long")))).otherwise(first)
    groups = rows.select("node", "n", "over", "token", "own", "other", F.explode(keys).alias("e")).select(
        F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"), "e").alias("token"), "node", "n", "over").distinct()
    many = groups.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("token")
    out = cut_lineage(groups.join(many, "token"))
    drop_tables(spark, cuts(spark)[start:-1])
    return out


def _unsettled(now: DataFrame) -> DataFrame:
    """token and its smallest component, for tokens with nodes of several components."""
    ends = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return ends.where("low < high").drop("high")


def _linked(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Components (node, comp) of the graph of all links between nodes."""
    labels = cut_lineage(nodes.select("node", F.col("node").alias("comp")))
    sketches = nodes.select("node", "sketch")
    listed = nodes.select("n", "over", "node", F.explode("p1").alias("token"))
    # under a token, a node that differs too much from even the best of the others has no partner
    least = listed.groupBy("token").agg(F.min("over").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    members = cut_lineage(listed.join(least, "token").where("over + least <= 0").drop("least"))

    def near(n: Column, over: Column) -> Column:
        small, large = F.least("n", n), F.greatest("n", n)
        return (small * plan.bottom >= large * plan.top) & (F.col("over") + over <= 0)

    def may_link(p: Column) -> Column:
        """Whether a node may have a link to a pivot of another component."""
        apart = parities_apart(F.col("sketch"), p["sketch"])
        return (F.col("comp") != p["comp"]) & near(p["n"], p["over"]) & (
            apart * (plan.bottom + plan.top) <= (F.col("n") + p["n"]) * (plan.bottom - plan.top))

    free_shuffles(nodes.sparkSession)
    # round one: every node meets the one pivot with which it shares most prefix tokens
    first = members.groupBy("token").agg(F.min("node").alias("pivot"))
    about = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("over").alias("pover"))
    met = members.join(first, "token").where("node <> pivot").groupBy("node", "pivot", "n", "over").agg(F.count(F.lit(1)).alias("common"))
    met = met.join(about, "pivot").where(near(F.col("pn"), F.col("pover")))
    best = met.groupBy("node").agg(F.max(F.struct("common", (-F.col("pivot")).alias("p"))).alias("m"))
    pairs = cut_lineage(best.select(F.col("node").alias("a"), (-F.col("m.p")).alias("b")))
    labels = joined_components(labels, _verified(pairs, nodes, plan))
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = members.join(labels, "node")
    still = cut_lineage(now.join(_unsettled(now), "token").select("token", "node", "n", "over"))
    if still.isEmpty():
        return labels
    # tokens of few nodes stay as they are; those of many are dealt out by difference
    wide = cut_lineage(still.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > FEW).select("token"))
    members = still.join(wide, "token", "left_anti")
    if not wide.isEmpty():
        members = members.unionByName(_by_difference(still.join(wide, "token", "left_semi"), nodes, plan))
    most = PIVOTS
    # a node that has little alone comes first, as it is near to many; the smallest component, often the
    # group of copies, waits
    order = Window.partitionBy("token").orderBy(F.col("comp") == F.col("low"), "over", "node")
    while True:
        # what is settled stays settled, so each round keeps the nodes of open tokens alone
        now = members.join(labels, "node")
        now = now.join(_unsettled(now), "token").withColumn("turn", (F.row_number().over(order) <= most) & (F.col("comp") != F.col("low")))
        now = cut_lineage(now)
        if now.isEmpty():
            return labels
        known = now.join(sketches, "node")
        pivots = known.where("turn").groupBy("token").agg(F.collect_list(F.struct("node", "comp", "n", "over", "sketch")).alias("pivots"))
        # the list is cut down where it is met, so that no pair is a row before it may be a link
        met = known.join(pivots, "token").select("node", F.transform(F.filter("pivots", may_link), lambda p: p["node"]).alias("pivots"))
        met = met.where(F.size("pivots") > 0).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("pivots"))).alias("pivots"))
        met = met.select("node", F.explode("pivots").alias("pivot")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        pairs = cut_lineage(met.join(tested, ["a", "b"], "left_anti"))
        free_shuffles(nodes.sparkSession)
        labels = joined_components(labels, _verified(pairs, nodes, plan))
        # what is still open has few links: more pivots at once make the same comparisons in fewer rounds
        most = min(most * 4, MOST_PIVOTS)
        tested = cut_lineage(tested.unionByName(pairs))
        # a pivot has met all nodes of its token
        members = now.where("not turn").select("token", "node", "n", "over")


def components(df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, its own included),
    one row per row of ``df``.

    Two documents link when 100 * common >= percent * union of their n-grams of ``words`` words. NULL,
    empty and blank texts have no n-grams and link with nothing: their component is their own doc_id.
    Texts with equal sets are linked, repeated rows too. A row without a doc_id takes part; the
    smallest doc_id then is that of the others, NULL if there is none. Other columns are not read; an
    empty table gives an empty table.
    """
    plan = Plan.of(words, percent)
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    spark, start = df.sparkSession, len(cuts(df.sparkSession))
    sliced = _slices(docs, plan)
    owner = _alive(sliced, plan)
    before_owner = cuts(spark)[start:-1]
    rows = cut_lineage(sliced.select("id", "n", "print", "row"))
    drop_tables(spark, before_owner)  # the slices, and what was counted of them
    wanted = cut_lineage(owner.join(rows.select(F.col("row").alias("node"), "id"), "node"))
    start = len(cuts(spark))
    nodes = _prefixes(_sets(docs, wanted, plan), plan)
    drop_tables(spark, cuts(spark)[start:-1])  # the whole sets: prefixes and common tokens are in the nodes
    labels = _linked(nodes, plan)

    filled = rows.where("n > 0")
    groups = cut_lineage(filled.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many")))
    comp_of = owner.join(labels, "node").select("print", "comp")
    at_least = comp_of.join(groups, "print").groupBy("comp").agg(F.min("least").alias("least"))
    linked = comp_of.join(at_least, "comp").select("print", "least")
    copies = groups.where("many > 1").select("print", "least").join(linked.select("print"), "print", "left_anti")
    found = cut_lineage(linked.unionByName(copies))
    out = filled.join(found, "print", "left").select("id", "n", F.coalesce("least", "id").alias("component_id"))
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(empty).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the document of the smallest doc_id. A row
    without a doc_id stays."""
    found = components(df, words, percent, doc_id, text)
    losers = cut_lineage(found.where(F.col("component_id") != F.col(doc_id)).select(doc_id).distinct())
    return df.join(_small(losers, losers.count()), doc_id, "left_anti").select(*[F.col(c) for c in df.columns])
