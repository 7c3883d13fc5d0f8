"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut into words by the pattern of the vocabulary. A word that is itself in the vocabulary is
one token. Any other is an array of the ids of its bytes, and a fold merges the neighbours of lowest
rank, leftmost first, until no pair has a rank. Two ids that may merge are one number, and what they
become is looked up in a table of merges.

Words repeat, so the most frequent distinct words of the corpus are folded once, and what they became
goes into a table with the vocabulary, of at most ``KNOWN_WORDS`` words of at most ``KNOWN_BYTES``
bytes each, so its size is bounded whatever the texts are. It saves work only: a word outside it is
folded where it stands. Nothing is shuffled but counts of words and those tables.

A table is one row: an array of small maps, dealt by a hash of the key, since a lookup in a map reads
it from the front. It is written once, and a scalar subquery brings it to the query that looks things
up in it. So it stays in Spark's compact format, and no plan spells it out. A subquery's row passes the
driver, more than once while a task is made of it, so its size counts: only the vocabulary and the
``FREQUENT`` most frequent words are in maps, which take some 64 bytes a word. The others are in an array
of strings, where a word takes its own bytes and the digits of its ids.

Bytes travel as strings of the characters U+0000 to U+00FF, one per byte; ``binary`` turns such a
string into bytes. Decoding looks up the piece of each id and joins the pieces.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalgrid.llm.common import fresh
from rivalgrid.session import cut_lineage, cuts, drop_tables

KNOWN_WORDS, KNOWN_BYTES = 1_048_576, 64
# Of the known words, those in maps.
FREQUENT = 262_144
SLOTS, STRING_SLOTS = 65_536, 262_144
# Of all known words together.
ALL_BYTES = 16 << 20
_LAST = (1 << 31) - 1
# Fixed value: characters that count as white space, as the vocabulary's pattern sees them.
_SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def java_pattern(pattern: str) -> str:
    """The pattern with its white space classes spelled out, which Java reads as ASCII only, and the
    endings after an apostrophe behind one test for the apostrophe."""
    pattern = pattern.replace("'s|'t|'re|'ve|'m|'ll|'d", "'(?:[stmd]|re|ve|ll)")
    return pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"(?!\S)", rf"(?![^{_SPACE}])").replace(r"\s", rf"[{_SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def byte_string(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def binary(byte_text: Column) -> Column:
    return F.encode(byte_text, "ISO-8859-1")


def _slot(key: Column, slots: int = SLOTS) -> Column:
    return F.hash(key).bitwiseAND(F.lit(slots - 1))


def _mark(byte: str) -> Column:
    """A byte that no UTF-8 has, so no word holds it: a pattern gives whole characters only."""
    return F.unhex(F.lit(byte)).cast("string")


class SlotTable:
    """A map as a written table of one row; ``table`` has the columns key, value and turn, each key once, and
    is of bounded size. Of the keys of a slot, those of the lowest turn are tried first."""

    def __init__(self, table: DataFrame):
        entries = table.select(_slot(F.col("key")).alias("slot"), F.struct("turn", "key", "value").alias("entry"))
        every = table.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"))
        slots = entries.unionByName(every).groupBy("slot").agg(F.collect_list("entry").alias("entries"))
        in_order = F.sort_array(F.collect_list(F.struct("slot", "entries")))
        self.row = cut_lineage(slots.agg(F.transform(in_order, lambda s: F.map_from_entries(F.transform(F.sort_array(s["entries"]), lambda e: F.struct(e["key"], e["value"])))).alias("slots")))

    def bound(self) -> Column:
        """The table as a column; Spark lets it stand outside of higher-order functions only."""
        return self.row.scalar()

    def get(self, key: Column) -> Column:
        """The value, or NULL; ``key`` is computed twice, so it should be at hand."""
        return look_up(self.bound(), key)


def look_up(table: Column, key: Column) -> Column:
    """The value of ``key`` in a bound table."""
    return F.element_at(F.get(table, _slot(key)), key)


class StringTable:
    """The ids of words as a written table of one row, an array of strings; ``table`` has the columns key and
    value, each key once, and is of bounded size. A string holds for each of its words a mark, the word,
    another mark and the ids, comma-joined, and ends with the first mark."""

    def __init__(self, table: DataFrame):
        digits = F.array_join(F.col("value").cast("array<string>"), ",")
        entries = table.select(_slot(F.col("key"), STRING_SLOTS).alias("slot"), F.concat(_mark("FF"), "key", _mark("FE"), digits).alias("entry"))
        every = table.sparkSession.range(STRING_SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(None).cast("string").alias("entry"))
        joined = F.concat(F.array_join(F.sort_array(F.collect_list("entry")), ""), _mark("FF"))
        slots = entries.unionByName(every).groupBy("slot").agg(joined.alias("words"))
        in_order = F.sort_array(F.collect_list(F.struct("slot", "words")))
        self.row = cut_lineage(slots.agg(F.transform(in_order, lambda s: s["words"]).alias("slots")))

    def bound(self) -> Column:
        """The table as a column; Spark lets it stand outside of higher-order functions only."""
        return self.row.scalar()

    def get(self, word: Column) -> Column:
        """The ids, or NULL; ``word`` is computed more than once, so it should be at hand."""
        return _ids(look_up_string(self.bound(), word))


def look_up_string(table: Column, word: Column) -> Column:
    """The ids of ``word`` in a bound table of strings, comma-joined. Where the word is not found all of its
    string is left, which begins with a mark, so that nothing stands before the first one."""
    entry = F.concat(_mark("FF"), word, _mark("FE"))
    after = F.call_function("substring_index", F.get(table, _slot(word, STRING_SLOTS)), entry, F.lit(-1))
    return F.call_function("substring_index", after, _mark("FF"), F.lit(1))


def _ids(digits: Column) -> Column:
    return F.when(digits != "", F.split(digits, ",").cast("array<int>"))


class KnownWords:
    """The known words: the vocabulary and the most frequent in maps, the others in strings."""

    def __init__(self, frequent: SlotTable, others: StringTable):
        self.frequent, self.others = frequent, others

    def get(self, word: Column) -> Column:
        """The ids, or NULL; ``word`` is computed more than once, so it should be at hand."""
        return F.coalesce(self.frequent.get(word), self.others.get(word))


def _pair(left: Column, right: Column) -> Column:
    """Two ids as one number."""
    return F.shiftleft(left, 32) + right


def _part(rank: Column, id_: Column) -> Column:
    """A part of a word as one number: the rank of its merge with the next part above its id. Where there
    is none, the rank is beyond all others."""
    return F.shiftleft(F.coalesce(rank, F.lit(_LAST + 1).cast("long")), 31) + id_


def _rank(part: Column) -> Column:
    return F.shiftright(part, 31)


def _id(part: Column) -> Column:
    return part.bitwiseAND(F.lit(_LAST))


class Codec:
    """Encoder and decoder of one vocabulary of ranks, as Column functions."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.pattern = java_pattern(pattern)
        rows = [(token.decode("latin-1"), rank) for token, rank in ranks.items()]
        vocabulary = cut_lineage(spark.createDataFrame(rows, "piece string, id long"))
        # the tokens that can be words: those that are whole characters
        word = F.try_validate_utf8(binary(F.col("piece")).cast("string"))
        self.tokens = vocabulary.select(word.alias("key"), F.array(F.col("id").cast("int")).alias("value"), F.lit(-1 << 62).alias("turn")).where("key IS NOT NULL")
        cut = vocabulary.where(F.length("piece") > 1).select("piece", "id", F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("at"))
        cut = cut.select("id", F.substr("piece", F.lit(1), F.col("at")).alias("l"), F.substr("piece", F.col("at") + 1).alias("r"))
        left, right = (vocabulary.select(F.col("piece").alias(x), F.col("id").alias(f"{x}_id")) for x in "lr")
        merges = cut.join(left, "l").join(right, "r").select(_pair(F.col("l_id"), F.col("r_id")).alias("key"), F.col("id").alias("value"), F.col("id").alias("turn"))
        self.merges = SlotTable(merges)
        self.bytes = [ranks.get(bytes([b])) for b in range(256)]
        pieces = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.decode("latin-1")
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    @staticmethod
    def _merge(merges: Column, state: Column) -> Column:
        """One merge: of the leftmost pair of the lowest rank. Only its two new pairs are looked up."""

        def merged(low: Column) -> Column:
            """The parts at and at + 1, counted from nought, become one, whose id is the rank."""
            at, new = _id(low).cast("int"), _rank(low)
            right = _part(look_up(merges, _pair(new, _id(F.get(state, at + 2)))), new)

            def both(before: Column) -> Column:
                return F.array(_part(look_up(merges, _pair(before, new)), before), right)

            middle = F.when(at > 0, both(_id(F.get(state, at - 1)))).otherwise(F.array(right))
            return F.flatten(F.array(F.slice(state, F.lit(1), F.greatest(at - 1, F.lit(0))), middle, F.slice(state, at + 3, F.size(state))))

        # rank and place in one number; array_position would find the place, but leaves its loop by an exception
        lowest = F.array_min(F.transform(state, lambda part, i: part.bitwiseAND(F.lit(-1 - _LAST)).bitwiseOR(i.cast("long"))))
        return let(lowest, lambda low: F.when(_rank(low) <= _LAST, merged(low)).otherwise(state))

    def fold(self, word: Column, merges: Column) -> Column:
        """Ids of a word that is no token: the merges over its bytes. ``merges`` is bound."""
        one = F.lit(self.bytes).cast("array<bigint>")
        ids = F.transform(F.filter(F.split(byte_string(word), ""), lambda c: c != ""), lambda c: F.element_at(one, F.ascii(c) + 1))

        def merge_all(start: Column) -> Column:
            state = F.transform(start, lambda id_, i: _part(look_up(merges, _pair(id_, F.get(start, i + 1))), id_))
            return F.aggregate(F.slice(start, F.lit(2), F.size(start)), state, lambda s, _: self._merge(merges, s), lambda s: F.transform(s, lambda x: _id(x).cast("int")))

        return let(ids, merge_all)

    def known_words(self, df: DataFrame, text: str, most: int = KNOWN_WORDS) -> KnownWords:
        """The vocabulary and the most frequent words of all texts of at most KNOWN_BYTES bytes, at most
        ``most`` and ALL_BYTES together, with their ids."""
        spark, start = df.sparkSession, len(cuts(df.sparkSession))
        short = df.select(F.explode(self.words(F.col(text))).alias("key")).where(F.octet_length("key") <= KNOWN_BYTES)
        counts = short.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        counts = cut_lineage(counts.where("n > 1").join(self.tokens.select("key"), "key", "left_anti"))
        power = F.floor(F.log2(F.col("n").cast("double")) * 4)
        held, size, least, often = 0, 0, None, None
        sizes = counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("key")).alias("bytes"))
        for row in sizes.orderBy(F.col("power").desc()).collect():
            held, size = held + row["words"], size + row["bytes"]
            if held > most or size > ALL_BYTES:
                break
            least = row["power"]
            often = least if held <= FREQUENT else often
        chosen = counts.where(power >= least) if least is not None else counts.limit(0)
        # a table of short words: dealt out anew, since folding is the work here
        in_maps = power >= often if often is not None else F.lit(False)
        asked = chosen.select("key", (-F.col("n")).alias("turn"), in_maps.alias("in_maps")).repartition("key").withColumn("merges", self.merges.bound())
        ready = cut_lineage(asked.select("key", let(F.col("merges"), lambda merges: self.fold(F.col("key"), merges)).alias("value"), "turn", "in_maps"))
        frequent = SlotTable(ready.where("in_maps").drop("in_maps").unionByName(self.tokens))
        others = StringTable(ready.where("NOT in_maps"))
        drop_tables(spark, cuts(spark)[start:-2])  # the counts and the folded words
        return KnownWords(frequent, others)

    def encode(self, df: DataFrame, text: str, ids: str, known: KnownWords) -> DataFrame:
        """``df`` with the ids of a text column; a NULL is an empty text, which has none."""
        merges_at, frequent_at, others_at = fresh(df.drop(ids), "merges", "frequent", "others")

        def ids_of(word: Column, merges: Column, frequent: Column, others: Column) -> Column:
            return F.coalesce(look_up(frequent, word), let(look_up_string(others, word), _ids), self.fold(word, merges))

        def all_ids(merges: Column, frequent: Column, others: Column) -> Column:
            return F.flatten(F.transform(self.words(F.col(text)), lambda w: ids_of(w, merges, frequent, others)))

        bound = df.withColumns({merges_at: self.merges.bound(), frequent_at: known.frequent.bound(), others_at: known.others.bound()})
        found = let(F.col(merges_at), lambda m: let(F.col(frequent_at), lambda f: let(F.col(others_at), lambda o: all_ids(m, f, o))))
        return bound.withColumn(ids, found).drop(merges_at, frequent_at, others_at)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids."""
        return let(self.pieces, lambda pieces: binary(F.array_join(F.transform(ids, lambda i: pieces[i]), "")))


def encode_texts(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "token_ids", known_words: int = KNOWN_WORDS) -> tuple[DataFrame, Codec]:
    """``df`` with the ids of each text (a column of that name gives way), and the codec to decode them.

    A NULL or empty text has no ids. Rows and other columns stay as they are; an empty table gives an
    empty table. A word of n bytes outside the known words takes n merges over at most n parts, so a
    word of tens of thousands of bytes is slow, but whole.
    """
    codec = Codec(df.sparkSession, read_ranks(ranks), pattern)
    known = codec.known_words(df, text, known_words)
    return codec.encode(df, text, ids, known), codec
