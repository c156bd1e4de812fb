"""Benchmark decontamination with a distributed positional inverted index.

The index stores a posting (term, document, position) for every corpus word
that a test item uses, as a Parquet table.  It is kept by document, as the
tasks that read the documents write it, so building it moves no corpus word
between machines.  A phrase is looked up from its rarest terms: the postings of
the two rarest, each moved back by the term's place in the phrase, are
intersected; the phrase's remaining terms are looked up for the survivors only.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_id", "h"]
#: Rows up to which a table made of test items (terms, windows, candidate
#: documents) is broadcast; it is counted first, beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone (plain ``lower`` does just that on ASCII text)."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for NULL."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAPS)
    return F.array_remove(parts, "")


def _small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (materialised), marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, text): a document is a distinct pair of id and text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"),
                       F.col(text_col).alias("text"))


class PositionalIndex:
    """Postings of the given terms (one column ``term``) in a corpus."""

    def __init__(self, docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        numbered = terms.where("term is not null").distinct().withColumn("term_id", F.monotonically_increasing_id())
        self.terms = materialize(numbered, "terms")
        every = corpus(docs, id_col, text_col).select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))
        self.postings = materialize(every.join(_small(self.terms), "term").select("term_id", *DOC, "pos"), "postings")
        self.frequency = materialize(self.postings.groupBy("term_id").agg(F.count("*").alias("n")), "frequency")

    def phrase_terms(self, phrases: DataFrame) -> DataFrame:
        """``phrases(wid, words)`` as (wid, size, off, term_id, rank), rank 1 the rarest;
        phrases with a term that the corpus lacks are left out."""
        t = phrases.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("off", "term"))
        known = t.join(self.terms, "term").join(self.frequency, "term_id")
        rare_first = Window.partitionBy("wid").orderBy("n", "off")
        full = F.count("*").over(Window.partitionBy("wid")) == F.col("size")
        ranked = known.withColumn("rank", F.row_number().over(rare_first)).withColumn("full", full)
        return materialize(ranked.where("full").select("wid", "size", "off", "term_id", "rank"), "phrase-terms")

    def phrase_matches(self, phrases: DataFrame, rarest: int = 2) -> DataFrame:
        """(doc_id, h, start, wid, size): every place where the words of ``phrases(wid,
        words)`` stand one after another."""
        terms = self.phrase_terms(phrases)
        rare = materialize(terms.where(F.col("rank") <= rarest), "rare-terms")
        start = (F.col("pos") - F.col("off")).alias("start")
        # terms met, not rows: a repeated document has each of its postings several times
        met = (F.when(F.min("off") == F.max("off"), 1).otherwise(2) if rarest <= 2 else F.size(F.collect_set("off")))
        seeds = (self.postings.join(_small(rare), "term_id").where("pos >= off")
                 .select(*DOC, start, "wid", "size", "off")
                 .groupBy(*DOC, "start", "wid", "size").agg(met.alias("n"))
                 .where(F.col("n") == F.least(F.col("size"), F.lit(rarest))).drop("n"))
        seeds = materialize(seeds, "seeds")
        rest = terms.where(F.col("rank") > rarest).select("wid", "off", "term_id")
        wanted = seeds.join(rest, "wid").select(*DOC, "start", "wid", "term_id",
                                                (F.col("start") + F.col("off")).alias("pos"))
        hot = materialize(seeds.select(*DOC).distinct(), "seed-docs")
        near = self.postings.alias("p").join(
            _small(hot).alias("d"), F.expr("p.doc_id <=> d.doc_id and p.h = d.h"), "left_semi")
        checked = (wanted.alias("a").join(
            near.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.h = b.h and a.pos = b.pos and a.term_id = b.term_id"))
            .select("a.doc_id", "a.h", "a.start", "a.wid", "a.pos").distinct()
            .groupBy(*DOC, "start", "wid").agg(F.count("*").alias("n")))
        complete = seeds.where(F.col("size") <= rarest).select(*DOC, "start", "wid", "size")
        longer = seeds.where(F.col("size") > rarest).alias("s").join(checked.alias("c"), F.expr(
            "s.doc_id <=> c.doc_id and s.h = c.h and s.start = c.start and s.wid = c.wid and c.n = s.size - "
            + str(rarest))).select("s.doc_id", "s.h", "s.start", "s.wid", "s.size")
        return complete.union(longer)

    def proximity_matches(self, queries: DataFrame, slop: int) -> DataFrame:
        """(doc_id, h, wid, at): places of a query's rarest term that have every
        other term of ``queries(wid, words)`` at most ``slop`` words away, in any
        order.  Repeated words of a query count once."""
        distinct = queries.select("wid", F.array_distinct("words").alias("words"))
        terms = self.phrase_terms(distinct)
        first = materialize(terms.where("rank = 1"), "anchor-terms")
        anchors = (self.postings.join(_small(first), "term_id").select(*DOC, "wid", "size", F.col("pos").alias("at")))
        other = terms.where("rank > 1").select("wid", "term_id")
        wanted = anchors.join(other, "wid", "left").alias("a")
        hit = wanted.join(self.postings.alias("p"), F.expr(
            f"a.doc_id <=> p.doc_id and a.h = p.h and a.term_id = p.term_id and p.pos between a.at - {slop} and a.at + {slop}"),
            "left").groupBy("a.doc_id", "a.h", "a.wid", "a.at", "a.size").agg(
                F.count_distinct("p.term_id").alias("n"))
        return hit.where("n = size - 1").select("doc_id", "h", "wid", "at")


def windows(items: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words) of ``n`` consecutive item words (all words of a
    shorter item) and the items (wid, item) that have them.  Items without words have
    none; rows with a NULL id are one item, NULL here."""
    t = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    t = t.where("size(w) > 0")
    every = t.select("item", F.explode(F.expr(
        f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n}))")).alias("words"))
    found = every.groupBy("words").agg(F.collect_set(F.struct("item")).alias("items"))
    found = materialize(found.withColumn("wid", F.monotonically_increasing_id()), "windows")
    return found.select("wid", "words"), found.select("wid", F.explode("items.item").alias("item"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    One row per distinct pair of id and text (repeated rows give one; a NULL id
    is an id like others).  NULL or empty text has no words.  ``n_hit`` counts
    the words inside any occurrence of an item's window, ``n_items`` the items
    with an occurring window; items with a NULL id hit like others, count as one and
    have no name in the digest.  Repeated items count once.  Other columns are ignored; without items nothing
    is hit; an empty table gives an empty one.
    """
    win, owners = windows(items, n, item_col, item_text_col)
    index = PositionalIndex(docs, win.select(F.explode("words").alias("term")), id_col, text_col)
    found = materialize(index.phrase_matches(win), "occurrences")
    earlier = (Window.partitionBy(*DOC).orderBy("start")
               .rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    spans = found.select(*DOC, "start", "size").distinct()
    covered = (spans.withColumn("upto", F.coalesce(F.max(end).over(earlier), F.lit(0)))
               .groupBy(*DOC).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "upto"))).alias("n_hit")))
    named = (found.select(*DOC, "wid").distinct().join(owners, "wid").groupBy(*DOC)
             .agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed")))
    base = corpus(docs, id_col, text_col)
    none = F.lit(None)
    count = F.regexp_count(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(_WORD)).cast("long")
    rows = (base.select(*DOC, count.alias("n_words"), none.cast("long").alias("n_hit"),
                        none.cast("long").alias("n_items"), none.cast("string").alias("sha"))
            .union(covered.select(*DOC, none, "n_hit", none, none))
            .union(named.select(*DOC, none, none, (F.size("items") + F.col("unnamed")).cast("long"),
                                F.sha2(F.array_join("items", ","), 256))))
    out = rows.groupBy(*DOC).agg(F.max("n_words").alias("n_words"),
                                 F.coalesce(F.max("n_hit"), F.lit(0)).alias("n_hit"),
                                 F.coalesce(F.max("n_items"), F.lit(0)).alias("n_items"),
                                 F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.drop("h").withColumn("contaminated", F.col("n_hit") > 0)
