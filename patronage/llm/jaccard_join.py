"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct k-word shingles (64-bit hashes).  Shingles
have one global order: frequent ones last, then by hash.  Two sets of Jaccard
similarity t or more share a shingle among the first n - ceil(t n) + 1 of each,
so only documents that share such a prefix shingle are compared.

1. Documents with equal sets become one set; sets of one size with identical
   prefixes become one group.
2. Group pairs are found through shared prefix shingles and filtered by size, by
   the shingles' places (the first shared one must leave room for the overlap) and
   by the number of prefix shingles they share (a link needs at least
   ``needed`` of them, which follows from the sizes).
3. The groups' members are expanded and compared exactly.

Only the components of the links are wanted, so pairs that are already connected
need no comparison.  A few rounds first compare each group with one leader of a
shared shingle and each member with its group's leader: at most one pair a set
and round, however large a group of copies is.  The last step then generates
every pair of sets from different components that passes the filters, so no
link between components is lost.  The order of shingles only changes how many
candidates there are, never the result.

Texts are read whole.  ``HEAVY`` bounds the list of frequent shingles that
orders the prefixes; it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    SPACE_SEPARATORS,
    collect_bounded,
    components,
    distinct,
    keep_ids,
    materialize,
    shingle_hashes,
    word_hashes,
)

HEAVY = 1 << 18
_LOCAL, _LOCAL_COUNT = 4_000_000, 2


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; empty without words."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    return distinct(shingle_hashes(word_hashes(text, SPACE_SEPARATORS), k))


def set_id(s: np.ndarray) -> int:
    """64-bit hash of a set (its size, sum and exclusive or), as a signed integer."""
    x = int(s.sum()) * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(s)) * 0xC2B2AE3D27D4EB4F + len(s)
    x = (x ^ (x >> 67)) & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def prefix_length(n, num: int, den: int):
    """n - ceil(t n) + 1 for t = num / den."""
    return n - (num * n + den - 1) // den + 1


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _scan(k: int):
    """kind 0: (key, set id, size) of each row; kind 1: (hash, count) of shingles that several
    distinct sets of a task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen, size = [], set(), 0

        def frequent():
            tokens, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= _LOCAL_COUNT
            m = int(often.sum())
            return _batch({"kind": pa.array(np.ones(m, np.int32)), "key": pa.nulls(m, pa.int64()),
                           "sid": pa.array(tokens[often].view(np.int64)), "n": pa.array(n[often].astype(np.int64))})

        for batch in batches:
            sids, ns = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                ns.append(len(s))
                sids.append(set_id(s) if len(s) else None)
                if len(s) and sids[-1] not in seen:
                    seen.add(sids[-1])
                    kept.append(s)
                    size += len(s)
            yield _batch({"kind": pa.array(np.zeros(len(ns), np.int32)), "key": batch.column(0),
                          "sid": pa.array(sids, pa.int64()), "n": pa.array(ns, pa.int64())})
            if size > _LOCAL:
                yield frequent()
                kept, seen, size = [], set(), 0
        if kept:
            yield frequent()

    return run


def _prefixes(k: int, num: int, den: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = heavy.value
        for batch in batches:
            sids, ns, parts = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, k)
                if not len(s):
                    continue
                order = s
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = np.where(tokens[at] == s, counts[at], 0)
                    if often.any():
                        order = s[np.argsort(often, kind="stable")]
                parts.append(order[:prefix_length(len(s), num, den)])
                sids.append(set_id(s))
                ns.append(len(s))
            lens = np.array([len(p) for p in parts], dtype=np.int32)
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            yield _batch({"sid": pa.array(sids, pa.int64()), "n": pa.array(ns, pa.int64()),
                          "prefix": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [s for s in (shingle_set(t, k) for t in batch.column(0).to_pylist()) if len(s)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield _batch({"sid": pa.array([set_id(s) for s in parts], pa.int64()),
                          "elements": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return run


class JaccardJoin:
    """The join of one table; ``num / den`` is the least similarity of a link."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text",
                 heavy: int = HEAVY):
        spark = docs.sparkSession
        self.k, self.num, self.den = k, num, den
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key")
        self.docs = docs.select(key, F.col(text_col).alias("text"))
        scan = materialize(self.docs.mapInArrow(_scan(k), "kind int, key long, sid long, n long"), "scan")
        self.rows = scan.where("kind = 0").select("key", "sid", "n")
        top = collect_bounded(scan.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n"))
                              .orderBy(F.desc("n"), "sid").limit(heavy))
        tokens = top["sid"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(tokens)
        shared = spark.sparkContext.broadcast((tokens[order], top["n"].to_numpy(dtype=np.int64)[order]))
        found = self.docs.select("text").mapInArrow(_prefixes(k, num, den, shared), "sid long, n long, prefix array<long>")
        sets = found.dropDuplicates(["sid"]).withColumn("g", F.xxhash64("n", "prefix"))
        sets = materialize(sets, "prefixes")
        first = sets.groupBy("g", "n").agg(F.min("sid").alias("gid"))
        #: (gid, sid, n): every distinct set and its group, named by the group's smallest set
        self.members = materialize(sets.join(first, ["g", "n"]).select("gid", "sid", "n"), "members")
        #: (sid, n, prefix, g) of each group's smallest set
        self.groups = sets.join(self.members.where("gid = sid").select("sid"), "sid", "left_semi")
        entry = self.groups.select(F.posexplode("prefix").alias("pos", "tok"), F.col("sid").alias("gid"), "n")
        often = entry.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
        #: (tok, pos, gid, n): prefix shingles that several groups share and that can lead to a link
        self.entries = self.prune(self.prune(materialize(entry.join(often, "tok"), "entries")))
        reps = self.rows.where("sid is not null").groupBy("sid").agg(F.min("key").alias("key"))
        #: (sid, key): a document of each set
        self.reps = materialize(reps, "reps")
        self.sets = spark.createDataFrame([], "sid long, elements array<long>")
        self.links = spark.createDataFrame([], "a long, b long")
        self.comps = spark.createDataFrame([], "node long, comp long")

    def load_sets(self, sids: DataFrame) -> None:
        """Elements of sets that are compared and not loaded yet, from their texts."""
        new = sids.distinct().join(self.sets.select("sid"), "sid", "left_anti")
        keys = materialize(self.reps.join(new, "sid", "left_semi").select("key").distinct(), "keys")
        texts = keep_ids(self.docs, keys, "key").select("text")
        found = materialize(texts.mapInArrow(_sets(self.k), "sid long, elements array<long>")
                            .dropDuplicates(["sid"]), "sets")
        self.sets = self.sets.union(found)

    # -- pieces of the join

    def fits(self, a: Column, b: Column) -> Column:
        return self.den * F.least(a, b) >= self.num * F.greatest(a, b)

    def overlap(self, a: Column, b: Column) -> Column:
        """Least number of shared shingles of a link between sets of a and b shingles."""
        total = self.num + self.den
        return F.floor(((a + b) * self.num + total - 1) / total)

    def needed(self, a: Column, b: Column) -> Column:
        """Least number of shared prefix shingles of a link: the overlap a link
        needs, less what the longer rest behind the prefixes can hold."""
        rest = [F.floor((self.num * x + self.den - 1) / self.den) - 1 for x in (a, b)]
        return self.overlap(a, b) - F.greatest(*rest)

    def early(self, entries: DataFrame) -> DataFrame:
        """Entries that can be the first shared shingle of a link with the smallest partner of
        the shingle's list."""
        span = entries.groupBy("tok").agg(F.min("n").alias("lo"))
        return (entries.join(span, "tok").where(F.col("pos") <= self.room(F.col("n"), F.col("lo")))
                .select(*entries.columns))

    def prune(self, entries: DataFrame) -> DataFrame:
        """Entries without those that no link can need: a group with fewer shared prefix
        shingles left than a partner of any size in the shingle's list demands."""
        own = entries.groupBy("gid").agg(F.count("*").alias("left"))
        span = entries.groupBy("tok").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c"))
        n = F.col("n")
        lo = F.greatest("lo", F.ceil(n * self.num / self.den))
        hi = F.least("hi", F.floor(n * self.den / self.num))
        # up to n it grows with the partner's size; above n it falls but for its two ceilings: a size
        # below hi can need one less than hi does
        least = F.least(self.needed(n, lo), self.needed(n, hi) - F.when(hi > n, 1).otherwise(0))
        kept = (entries.join(span.where("c > 1").drop("c"), "tok").join(own, "gid")
                .where(F.col("left") >= least).select(*entries.columns))
        return materialize(kept, "entries")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs of sets (a, b)."""
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                            "candidates")
        self.load_sets(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")))
        x = self.sets.select(F.col("sid").alias("a"), F.col("elements").alias("ea"))
        y = self.sets.select(F.col("sid").alias("b"), F.col("elements").alias("eb"))
        both = (pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("ea", "eb"))))
        link = self.den * F.col("common") >= self.num * (F.size("ea") + F.size("eb") - F.col("common"))
        return both.where(link).select("a", "b")

    def labelled(self) -> DataFrame:
        """(gid, sid, n, comp) with the components of the links so far."""
        return (self.members.join(self.comps, F.col("sid") == F.col("node"), "left")
                .select("gid", "sid", "n", F.coalesce("comp", "sid").alias("comp")))

    def add(self, found: DataFrame) -> bool:
        """Verify, keep the links, relabel; whether any link was new."""
        found = materialize(self.verify(found), "links")
        if found.isEmpty():
            return False
        self.links = self.links.union(found)
        self.comps = components(self.links)
        return True

    def linear_round(self) -> DataFrame:
        """At most one candidate a group and one a member, between different components: for a
        group, the leader with which it shares most prefix shingles, if those are enough."""
        lab = materialize(self.labelled(), "labelled")
        lead = lab.groupBy("gid").agg(F.min(F.struct("comp", "sid")).alias("l"))
        inside = (lab.join(lead, "gid").where("comp <> l.comp")
                  .select(F.col("sid").alias("a"), F.col("l.sid").alias("b")))
        band = F.floor(F.log(F.col("n").cast("double")) / np.log(self.den / self.num)).cast("int")
        # the leader shares most of its prefix: the text that the others are copies of, if there is one
        weight = self.entries.groupBy("gid").agg(F.count("*").alias("w"))
        e = (self.entries.join(lab.where("gid = sid").select("gid", "comp").join(weight, "gid"), "gid")
             .withColumn("band", band))
        leaders = e.groupBy("tok", "band").agg(F.min(F.struct(-F.col("w"), "gid", "comp", "n")).alias("l"))
        near = leaders.select("tok", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "l")
        meets = (e.join(near, ["tok", "band"]).where((F.col("comp") != F.col("l.comp")) & self.fits(F.col("n"), F.col("l.n")))
                 .groupBy("gid", "n", F.col("l.gid").alias("b"), F.col("l.n").alias("nb")).agg(F.count("*").alias("c"))
                 .where(F.col("c") >= self.needed(F.col("n"), F.col("nb"))))
        best = meets.groupBy("gid").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        return inside.union(best.select(F.col("gid").alias("a"), "b"))

    @staticmethod
    def mixed(rows: DataFrame, key: str, label: str) -> DataFrame:
        """Rows of the keys that have several labels."""
        span = rows.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(key)
        return materialize(rows.join(span, key, "left_semi"), "mixed")

    def room(self, n: Column, partner: Column) -> Column:
        """Last place at which a set of n shingles can have its first shared one with a partner of
        at least that size: the rest must hold the whole overlap."""
        return n - self.overlap(n, F.greatest(partner, F.ceil(n * self.num / self.den)))

    def across(self, rows: DataFrame, key: str, label: str, item: str) -> DataFrame:
        """(a, b, na, nb) for items of a key with different labels whose sizes and places allow a
        link.  Labels are paired first, with the bounds of their items, so items that share a
        label are never paired and an item meets only labels that can hold a partner."""
        rows = JaccardJoin.mixed(rows, key, label)
        labels = rows.groupBy(key, label).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("first"))

        def side(frame, x, **names):
            return frame.select(key, *[F.col(c).alias(to + x) for c, to in names.items()])

        a, b = (side(labels, x, **{label: "l", "lo": "lo", "hi": "hi", "first": "first"}) for x in "ab")
        col = F.col
        pairs = (a.join(b, key).where("la < lb")
                 .where((self.den * col("hia") >= self.num * col("lob")) & (self.den * col("hib") >= self.num * col("loa")))
                 .where((col("firsta") <= self.room(col("hia"), col("lob")))
                        & (col("firstb") <= self.room(col("hib"), col("loa"))))
                 .select(key, "la", "lb", "lob", "hib"))
        left, right = (side(rows, x, **{label: "l", item: "", "n": "n", "pos": "pos"}) for x in "ab")
        some = (pairs.join(left, [key, "la"])
                .where((self.den * col("na") >= self.num * col("lob")) & (self.den * col("hib") >= self.num * col("na")))
                .where(col("posa") <= self.room(col("na"), col("lob"))))
        return (some.join(right, [key, "lb"]).where(self.fits(col("na"), col("nb")))
                .where((col("posa") <= self.room(col("na"), col("nb"))) & (col("posb") <= self.room(col("nb"), col("na"))))
                .select("a", "b", "na", "nb"))

    def remaining(self) -> DataFrame:
        """Every pair of sets from different components that passes the filters."""
        lab = materialize(self.labelled(), "labelled")
        one = lab.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        # a group of several components has a label of its own, so all its pairs are looked at
        label = one.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.xxhash64("gid")).alias("label"))
        inside = self.across(lab.withColumn("pos", F.lit(0)), "gid", "comp", "sid").select("a", "b")
        e = self.early(self.prune(self.mixed(self.entries.join(label, "gid"), "tok", "label")))
        pairs = materialize(self.across(e, "tok", "label", "gid").distinct(), "pairs")
        px, py = (self.groups.select(F.col("sid").alias(x), F.col("prefix").alias("p" + x)) for x in "ab")
        pairs = (pairs.join(px, "a").join(py, "b")
                 .where(F.size(F.array_intersect("pa", "pb")) >= self.needed(F.col("na"), F.col("nb"))))
        x = lab.select(F.col("gid").alias("a"), F.col("sid").alias("sa"), F.col("comp").alias("ca"))
        y = lab.select(F.col("gid").alias("b"), F.col("sid").alias("sb"), F.col("comp").alias("cb"))
        outside = (pairs.select("a", "b").join(x, "a").join(y, "b").where("ca <> cb")
                   .select(F.col("sa").alias("a"), F.col("sb").alias("b")))
        return inside.union(outside)

    def run(self, rounds: int = 2) -> JaccardJoin:
        for _ in range(rounds):
            if not self.add(self.linear_round()):
                break
        self.add(self.remaining())
        return self


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    ``component_id`` is the smallest id reachable by links of similarity ``num / den`` or more.
    NULL and empty texts and texts without words have no shingle and are linked with nothing;
    a text of fewer than k words has its whole sequence as one.  Rows with a NULL id take part and
    have a NULL component_id where no other id is reachable; repeated rows are copies of each
    other; other columns are ignored; an empty table gives an empty one."""
    join = JaccardJoin(docs, k, num, den, id_col, text_col).run()
    null_key = F.lit(-(1 << 63))
    real = F.when(F.col("key") != null_key, F.col("key"))
    smallest = join.rows.where("sid is not null").groupBy("sid").agg(F.min(real).alias("m"))
    comp = smallest.join(join.comps, F.col("sid") == F.col("node"), "left").select(
        "sid", "m", F.coalesce("comp", "sid").alias("comp"))
    named = comp.groupBy("comp").agg(F.min("m").alias("component_id"))
    label = materialize(comp.join(named, "comp").select("sid", "component_id"), "labels")
    return (join.rows.join(label, "sid", "left")
            .select(real.alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("sid").isNull(), real).otherwise(F.col("component_id")).alias("component_id")))
