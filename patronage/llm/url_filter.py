"""Exact URL lists as a cascade of Bloom filters.

Level 0 encodes the listed keys; level 1 the keys of the corpus's universe that
pass level 0 without being listed; level 2 the listed keys that pass level 1;
and so on until a level lets nothing wrong through.  The parity of the first
level that a key fails tells whether it is listed, exactly, for every key of
the universe the cascade was built on.

A level is an array of 64-bit words that the plan reads as one scalar value; a
key sets and tests ``HASHES`` bits of one word, so membership is one lookup a
level: no join, no Python.  A level takes ``bits_per_key`` for each of its keys:
the listed ones at level 0, the wrongly passed ones (a few per cent of the
universe) at level 1.  Its words are checked against ``max_words`` before it is
built.  :func:`judge` splits keys by a hash into as many cascades as that asks
for and applies them one after the other, so no list is too long for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

HASHES = 4
#: Most words (8 bytes each) of a level.
MAX_WORDS = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


# -- cascade --------------------------------------------------------------

class TooManyWords(ValueError):
    """A level would need more words than it may have."""


def words_for(count: int, bits_per_key: int) -> int:
    return -(-max(count, 8) * bits_per_key // 64)


class Level:
    """One Bloom filter: its number and the table of its words."""

    def __init__(self, keys: DataFrame, number: int, n_words: int):
        spark = keys.sparkSession
        self.number, self.n_words = number, n_words
        at, mask = self._place(F.col("key"))
        word = keys.select(at.alias("id"), mask.alias("mask")).groupBy("id").agg(F.bit_or("mask").alias("word"))
        self.words = materialize(spark.range(n_words).join(word, "id", "left").select(
            "id", F.coalesce("word", F.lit(0)).alias("word")), "bloom")

    def _place(self, key: Column) -> tuple[Column, Column]:
        """The key's word and its bits there; both from one hash, of other bits."""
        h = F.xxhash64(key, F.lit(self.number))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
                for i in range(HASHES)]
        return F.pmod(F.shiftright(h, 6 * HASHES), F.lit(self.n_words)), reduce(Column.bitwiseOR, bits)

    def passes(self, key: Column) -> Column:
        every = F.transform(F.sort_array(F.collect_list(F.struct("id", "word"))), lambda x: x["word"])
        words = self.words.agg(every.alias("words")).scalar()
        at, mask = self._place(key)
        return F.element_at(words, (at + 1).cast("int")).bitwiseAND(mask) == mask


class Cascade:
    """Exact membership in ``listed`` for the keys of ``universe`` (and for the
    listed keys).  NULL keys are in no list; repeated keys count once; an empty
    list holds nothing."""

    def __init__(self, universe: DataFrame, listed: DataFrame, bits_per_key: int = 10,
                 max_words: int = MAX_WORDS, max_levels: int = 64):
        keys = (universe.select("key", F.lit(0).alias("listed"))
                .union(listed.select("key", F.lit(1).alias("listed")))
                .where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))
        keys = materialize(keys, "universe")
        sides = [keys.where("listed = 1"), keys.where("listed = 0")]
        self.levels: list[Level] = []
        while (count := sides[0].count()) or not self.levels:
            if len(self.levels) >= max_levels:
                raise RuntimeError(f"the cascade has not ended after {max_levels} levels")
            n_words = words_for(count, bits_per_key)
            if n_words > max_words:
                raise TooManyWords(f"{count} keys need {n_words} words, more than max_words={max_words}: "
                                   "split the list by a hash of the key")
            level = Level(sides[0], len(self.levels), n_words)
            self.levels.append(level)
            wrong = materialize(sides[1].where(level.passes(F.col("key"))), "wrong")
            sides = [wrong, sides[0]]

    def contains(self, key: Column) -> Column:
        """Whether ``key``, of the universe, is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.passes(key), out).otherwise(F.lit(level.number % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(F.coalesce(out, F.lit(False)))


# -- URL rules ------------------------------------------------------------

def _rules(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(key, blocked, suffix, labels, chars), one row per rule: its host, the host's number of labels and the
    number of characters of its path."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, rule string")
    host = F.substring_index("key", "/", 1)
    return materialize(
        rules.select(F.col("rule").alias("key"), (F.col("verdict") == "block").alias("blocked")).where("key is not null")
        .groupBy("key").agg(F.coalesce(F.max("blocked"), F.lit(False)).alias("blocked"))
        .select("key", "blocked", host.alias("suffix"), F.size(F.split(host, r"\.")).alias("labels"),
                (F.length("key") - F.length(host)).alias("chars")), "rules")


def _candidates(pages: DataFrame, hosts: Level, labels: list[int], chars: list[int]) -> DataFrame:
    """Each page's row without a key, and one for every key under which a rule may list it: the last ``labels``
    of its host (if a rule may have that host) with the first ``chars`` of its path."""
    host, path = F.col("host"), F.col("path")
    fitting = F.filter(F.lit(labels), lambda n: (n <= F.size(F.split(host, r"\."))) & (host != ""))
    rows = pages.withColumn("n", F.explode(F.array_append(fitting, F.lit(None).cast("int"))))
    rows = rows.withColumn("suffix", F.call_function("substring_index", host, F.lit("."), -F.col("n")))
    rows = rows.where(F.col("n").isNull() | hosts.passes(F.col("suffix")))
    starts = F.filter(F.lit(chars), lambda m: m <= F.length(path))
    rows = rows.withColumn("m", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(None).cast("int"))).otherwise(starts)))
    return rows.withColumn("key", F.concat("suffix", path.substr(F.lit(1), F.col("m")))).drop("suffix", "m")


def _hits(rows: DataFrame, universe: DataFrame, rules: DataFrame, bits_per_key: int, max_words: int) -> DataFrame:
    """``rows`` without the keys that are no rule; ``code`` orders a page's rules: by length, then by the number
    of host labels; its last bit is set for a blocked rule, and it is 0 without a key."""
    listed = Cascade(universe, rules.select("key"), bits_per_key, max_words)
    blocked = Cascade(rules.select("key"), rules.where("blocked").select("key"), bits_per_key, max_words)
    key = F.col("key")
    code = (F.shiftleft(F.length(key).cast("long"), 32).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 1))
            .bitwiseOR(blocked.contains(key).cast("long")))
    return rows.where(key.isNull() | listed.contains(key)).withColumn("code", F.coalesce(code, F.lit(0))).drop("key", "n")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url", bits_per_key: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """(id, host, path, rule, verdict), one row per input row.

    ``rules`` are (verdict, host/path) pairs, or a table of them with columns
    ``verdict`` and ``rule``, of any number and any shapes.  A rule fits its host
    and all subdomains if the path starts with the rule's; the longest rule
    wins, of equally long ones the one whose host has more labels, of two
    verdicts for one rule ``block``.  A URL that no rule lists gets ``default``.
    NULL urls and urls without ``://`` have empty host and path and fit no rule,
    NULL rules fit nothing; NULL ids and repeated rows are kept; other columns
    are ignored; an empty table gives an empty one.

    One cascade serves as long as its levels have at most ``max_words``.  Beyond
    that keys are split by a hash into twice as many cascades until all fit; each
    is applied to its own keys, which are written once, in a job of its own.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    rules = _rules(spark, rules)
    shapes = rules.agg(F.count("key"), F.collect_set("labels"), F.collect_set("chars")).first()
    if not shapes[0]:
        return p.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # only keeps the universe small, so more wrong hosts from a full filter cost time alone
    hosts = Level(rules.select(F.col("suffix").alias("key")), -1, min(words_for(shapes[0], bits_per_key), max_words))
    rows = _candidates(p, hosts, sorted(shapes[1]), sorted(shapes[2]))
    universe = materialize(rows.select("key").where("key is not null").distinct(), "keys")
    parts = -(-words_for(shapes[0], bits_per_key) // max_words)
    while True:
        try:
            hits = _apply(rows, universe, rules, parts, bits_per_key, max_words)
            break
        except TooManyWords:
            parts *= 2
    best = hits.groupBy("row", id_col, "host", "path").agg(F.max("code").alias("code"))
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."),
                             -F.shiftright("code", 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    start = F.col("path").substr(F.lit(1), F.shiftright("code", 32).cast("int") - F.length(suffix))
    return best.select(
        id_col, "host", "path", F.when(F.col("code") > 0, F.concat(suffix, start)).alias("rule"),
        F.when(F.col("code") == 0, F.lit(default)).when(F.col("code").bitwiseAND(F.lit(1)) == 1, F.lit("block"))
        .otherwise(F.lit("allow")).alias("verdict"))


def _apply(rows: DataFrame, universe: DataFrame, rules: DataFrame, parts: int, bits_per_key: int, max_words: int) -> DataFrame:
    """:func:`_hits` of all rows, with ``parts`` cascades one after the other."""
    if parts == 1:
        return _hits(rows, universe, rules, bits_per_key, max_words)

    def split(df: DataFrame, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int")
        return materialize(df.withColumn("part", F.when(F.col("key").isNull(), 0).otherwise(part)), name, partition_by="part")

    rules, universe = split(rules, "rules"), split(universe, "keys")
    rows = split(rows, "candidates")
    found = [materialize(_hits(*(x.where(F.col("part") == i).drop("part") for x in (rows, universe, rules)),
                               bits_per_key, max_words), "hits") for i in range(parts)]
    return reduce(DataFrame.union, found)
