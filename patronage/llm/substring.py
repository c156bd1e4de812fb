"""Repeated passages by collinear chaining.

1. Seeds: the minimizers (smallest hash of each ``WINDOW`` successive k-mers) of
   a text's words.  Any run of K + WINDOW - 1 equal words shares one.
2. Each place of a seed is joined with the seed's first document, with the
   document before it in order of id, and with the document that has the longest
   stretch of shared seeds there: three partners a place, so a passage in n
   documents gives about 3 n pairs, not n squared.
3. The matches of two documents are chained in order, with gap costs, by dynamic
   programming over a Fenwick tree.
4. Gaps and ends of a chain are aligned word by word.  Chains of ``min_words``
   or more words with enough equal words are passages; they need not be exact.
5. A repeat whose seeds have no such partner in common is not found by 2 to 4.  Around
   seeds whose following words an earlier document has too and that no passage covers, every
   run of ``min_words`` words is hashed and joined with its first document, so
   no exact repeat is lost, whatever the partners of its seeds are.

Words are runs of ASCII letters and digits (lower case) and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, keep_ids, keyed, materialize, run_hashes, shingle_hashes, word_hashes

K, WINDOW, MAX_GAP = 8, 16, 24
REACH = K + WINDOW
GAP_COST = 0.25
#: Places of a seed beyond which its documents are put in order over several tasks.
SLICE = 4096


# -- on one text or pair --------------------------------------------------

def minimizers(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the smallest k-mer of each window; of equal ones the first."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = shingle_hashes(words, k)
    w = min(window, len(h))
    at = np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(len(h) - w + 1)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return h[at], at


class Fenwick:
    """Largest (value, item) over a prefix."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Over items before ``i``."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray, k: int = K, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Disjoint chains of matches (x, y), as arrays of their indexes, strictly
    increasing in both.  ``x`` is sorted, ties by ``y``."""
    if len(x) == 1 or ((np.diff(x) > 0).all() and (np.diff(y) == np.diff(x)).all()):
        return np.split(np.arange(len(x)), np.flatnonzero(np.diff(x) > k + max_gap) + 1)
    rank = np.searchsorted(np.unique(y), y).tolist()
    tree, score, back = Fenwick(max(rank) + 1), [0.0] * len(x), [-1] * len(x)
    xs, ys = x.tolist(), y.tolist()
    i = 0
    while i < len(xs):
        j = i
        while j < len(xs) and xs[j] == xs[i]:
            value, item = tree.top(rank[j])
            gain = value - GAP_COST * (xs[j] + ys[j])
            score[j], back[j] = (k + gain, item) if gain > 0 else (float(k), -1)
            j += 1
        for m in range(i, j):  # matches at one place do not follow each other
            tree.put(rank[m], (score[m] + GAP_COST * (xs[m] + ys[m]), m))
        i = j
    out, used = [], [False] * len(xs)
    for end in sorted(range(len(xs)), key=lambda m: -score[m]):
        path, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = back[at]
        if path:
            path = np.array(path[::-1])
            wide = (np.diff(x[path]) > k + max_gap) | (np.diff(y[path]) > k + max_gap)
            out += np.split(path, np.flatnonzero(wide) + 1)
    return out


def gaps_of(x: np.ndarray, y: np.ndarray, k: int = K) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(words covered by a chain's matches, unmatched stretches between them)."""
    covered, gaps = k, []
    a, b = int(x[0]) + k, int(y[0]) + k
    for p, q in zip(x[1:].tolist(), y[1:].tolist(), strict=True):
        skip = max(a - p, b - q, 0)
        if skip >= k:
            continue
        p, q = p + skip, q + skip
        if p > a or q > b:
            gaps.append((a, p, b, q))
        covered += k - skip
        a, b = p + k - skip, q + k - skip
    return covered, gaps


def aligned(a, b) -> int:
    """Most equal words of an alignment of two short stretches."""
    if len(a) == len(b) and list(a) == list(b):
        return len(a)
    row = [0] * (len(b) + 1)
    for u in a:
        new = [0]
        for j, v in enumerate(b):
            new.append(row[j] + 1 if u == v else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def extension(a, b) -> tuple[int, int]:
    """(length, equal words) of the best common beginning; a differing word costs two equal ones."""
    best, score, equal = (0, 0), 0, 0
    top = 0
    for n, (u, v) in enumerate(zip(a, b, strict=False), 1):
        equal += u == v
        score += 1 if u == v else -2
        if score > top:
            top, best = score, (n, equal)
        if score < top - 6:
            break
    return best


# -- over tables ----------------------------------------------------------

def _seeds(min_words: int):
    """``ctx``: hash of the words from a seed on that any run of ``min_words`` words shares which has
    the seed among its first ``WINDOW`` k-mers; ``stop``: end of the last such run.  Both are NULL in
    a text that holds none."""
    size = max(min_words - WINDOW + 1, K)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, places, contexts, none, stops = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                words = word_hashes(text, ALNUM_SEPARATORS)
                h, at = minimizers(words)
                ids.append(np.full(len(h), doc_id, dtype=np.int64))
                hashes.append(h.view(np.int64))
                places.append(at.astype(np.int32))
                room = (at + size <= len(words)) & (len(words) >= min_words)
                ctx = run_hashes(words, size)
                contexts.append(ctx[np.minimum(at, len(ctx) - 1)].view(np.int64) if room.any() else np.zeros(len(at), np.int64))
                none.append(~room)
                stops.append(np.minimum(at + min_words, len(words)).astype(np.int32))
            if ids:
                gone = np.concatenate(none)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.concatenate(c)) for c in (hashes, ids, places)],
                     *[pa.array(np.concatenate(c), mask=gone) for c in (contexts, stops)]],
                    names=["seed", "doc", "pos", "ctx", "stop"])
    return run


_CHAIN = "doc long, partner long, s int, e int, ps int, pe int, covered int, gaps array<array<int>>"
_CHAIN_KINDS = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.list_(pa.list_(pa.int32()))]
_CHAIN_NAMES = [c.split()[0] for c in _CHAIN.split(", ")]


def plain_chains(doc: np.ndarray, partner: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray,
                 k: int = K, max_gap: int = MAX_GAP) -> list[pa.Array]:
    """Columns of ``_CHAIN`` for pairs whose matches all keep one distance, for all pairs at once; ``first`` marks
    each pair's first row.  The same chains and gaps as :func:`chains` and :func:`gaps_of` give."""
    step = np.diff(x, prepend=x[:1])
    begin = np.flatnonzero(first | (step > k + max_gap))
    last = np.append(begin[1:], len(x)) - 1
    inner = np.ones(len(x), dtype=bool)
    inner[begin] = False
    covered = k + np.add.reduceat(np.where(inner, np.minimum(step, k), 0), begin)
    gap = inner & (step > k)
    at = np.flatnonzero(gap)
    ranges = np.stack([x[at - 1] + k, x[at], y[at - 1] + k, y[at]], axis=1).astype(np.int32) if len(at) else np.zeros((0, 4), np.int32)
    per_chain = np.concatenate([[0], np.cumsum(np.add.reduceat(gap.astype(np.int64), begin))])
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(at) + 1, 4, dtype=np.int32)), pa.array(ranges.ravel()))
    gaps = pa.ListArray.from_arrays(pa.array(per_chain.astype(np.int32)), pairs)
    numbers = [doc[begin], partner[begin], x[begin], x[last] + k, y[begin], y[last] + k, covered]
    return [*[pa.array(c).cast(t) for c, t in zip(numbers, _CHAIN_KINDS[:-1], strict=True)], gaps]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by document, partner, place; a pair is chained when its last row is in."""

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, partner, pos, ppos = cols
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (partner[1:] != partner[:-1])])
        pair = np.cumsum(first) - 1
        dx, dy = np.diff(pos, prepend=pos[:1]), np.diff(ppos, prepend=ppos[:1])
        odd = np.bincount(pair, ~first & ((dx <= 0) | (dx != dy))) > 0
        plain = ~odd[pair]
        if plain.any():
            yield pa.RecordBatch.from_arrays(plain_chains(doc[plain], partner[plain], pos[plain], ppos[plain], first[plain]),
                                             names=_CHAIN_NAMES)
        begin = np.append(np.flatnonzero(first), len(doc))
        out: list = []
        for i in np.flatnonzero(odd).tolist():
            a, b = begin[i], begin[i + 1]
            x, y = pos[a:b], ppos[a:b]
            for c in chains(x, y):
                covered, gaps = gaps_of(x[c], y[c])
                out.append((int(doc[a]), int(partner[a]), int(x[c[0]]), int(x[c[-1]]) + K, int(y[c[0]]),
                            int(y[c[-1]]) + K, covered, [list(g) for g in gaps]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), _CHAIN_KINDS, strict=True)],
                                             names=_CHAIN_NAMES)

    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [c[last:] for c in cols]
        if last:
            yield from found([c[:last] for c in cols])
    if held is not None and len(held[0]):
        yield from found(held)


_PASSAGE = ("doc_id long, start_word int, end_word int, partner_id long, partner_start int, partner_end int, "
            "n_equal int, identity double")
_PASSAGE_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 3, pa.float64()]


def extensions(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`extension` of the rows of two matrices, each row of ``size`` words."""
    inside = np.arange(a.shape[1])[None, :] < size[:, None]
    equal = (a == b) & inside
    score = np.cumsum(np.where(equal, 1, -2), axis=1)
    top = np.maximum.accumulate(np.maximum(score, 0), axis=1)
    stopped = np.cumsum(score < top - 6, axis=1) > 0
    score = np.where(inside & ~stopped, score, -(1 << 20))
    at = score.argmax(axis=1)
    rows = np.arange(len(a))
    good = score[rows, at] > 0
    return np.where(good, at + 1, 0), np.where(good, np.cumsum(equal, axis=1)[rows, at], 0)


class _Stretches:
    """The word lists of a batch of chains: per chain the words before, in each gap and after."""

    def __init__(self, column: pa.Array):
        self.outer = column.offsets.to_numpy().astype(np.int64)
        inner = column.values
        self.edge = inner.offsets.to_numpy().astype(np.int64)
        self.words = inner.values.to_numpy(zero_copy_only=False)

    def ends(self, at: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(n, REACH) words of the lists ``at``, read from their end or beginning, and their lengths."""
        first, end = self.edge[at], self.edge[at + 1]
        step = np.arange(REACH)
        index = end[:, None] - 1 - step if backwards else first[:, None] + step
        return self.words[np.clip(index, 0, max(len(self.words) - 1, 0))] if len(self.words) else np.zeros(index.shape, np.int32), \
            np.minimum(end - first, REACH)


def _equal_words(a: _Stretches, b: _Stretches, at: np.ndarray) -> np.ndarray:
    """Equal words of an alignment of each pair of lists; equal lists are compared all at once."""
    sa, sb = a.edge[at + 1] - a.edge[at], b.edge[at + 1] - b.edge[at]
    out = np.zeros(len(at), dtype=np.int64)
    same = np.flatnonzero((sa == sb) & (sa > 0))
    differ = np.flatnonzero((sa != sb) & (sa > 0) & (sb > 0)).tolist()
    if len(same):
        n = sa[same]
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        offset = np.arange(int(n.sum())) - np.repeat(start, n)
        unlike = a.words[np.repeat(a.edge[at[same]], n) + offset] != b.words[np.repeat(b.edge[at[same]], n) + offset]
        wrong = np.add.reduceat(unlike.astype(np.int64), start) > 0
        out[same[~wrong]] = n[~wrong]
        differ += same[wrong].tolist()
    for i in differ:
        out[i] = aligned(a.words[a.edge[at[i]]:a.edge[at[i] + 1]].tolist(), b.words[b.edge[at[i]]:b.edge[at[i] + 1]].tolist())
    return out


def _align(min_words: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, partner, s, e, ps, pe, covered = (batch.column(i).to_numpy().astype(np.int64) for i in range(7))
            a, b = _Stretches(batch.column(7)), _Stretches(batch.column(8))
            before, after = a.outer[:-1], a.outer[1:] - 1
            (la, na), (lb, nb) = a.ends(before, True), b.ends(before, True)
            left, left_equal = extensions(la, lb, np.minimum(na, nb))
            (ra, na), (rb, nb) = a.ends(after, False), b.ends(after, False)
            right, right_equal = extensions(ra, rb, np.minimum(na, nb))
            row = np.repeat(np.arange(len(doc)), np.diff(a.outer))
            gap = np.arange(a.outer[0], a.outer[-1])
            mid = (gap != before[row]) & (gap != after[row])
            gaps = np.bincount(row[mid], _equal_words(a, b, gap[mid]), minlength=len(doc)).astype(np.int64)
            equal = covered + left_equal + right_equal + gaps
            start, end, p_start, p_end = s - left, e + right, ps - left, pe + right
            size = np.maximum(end - start, p_end - p_start)
            good = (end - start >= min_words) & (equal >= identity * size)
            cols = [doc, start, end, partner, p_start, p_end, equal, equal / np.maximum(size, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c[good]).cast(t) for c, t in zip(cols, _PASSAGE_KINDS, strict=True)],
                                             names=[c.split()[0] for c in _PASSAGE.split(", ")])
    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [(word_hashes(t, ALNUM_SEPARATORS) >> np.uint64(33)).astype(np.int32) if t else np.zeros(0, np.int32)
                 for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                                         names=["doc", "words"])


_RUN = "run long, doc long, start int"


def _runs(min_words: int):
    """Hash of each run of ``min_words`` words that has one of the given seeds among its first
    ``WINDOW`` k-mers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, starts = [], [], []
            for doc, at, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                h = run_hashes(words.values.to_numpy().astype(np.uint64), min_words)
                near = np.unique(at.values.to_numpy()[:, None] - np.arange(WINDOW))
                near = near[(near >= 0) & (near < len(h))]
                ids.append(np.full(len(near), doc, dtype=np.int64))
                hashes.append(h[near].view(np.int64))
                starts.append(near.astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (hashes, ids, starts)],
                                                 names=["run", "doc", "start"])
    return run


def documents_before(places: DataFrame) -> DataFrame:
    """(doc, partner, pos, ppos, lead): of each seed and document, the document before it in order
    of id.  The documents of a seed with many places are ordered over several tasks."""
    once = places.groupBy("seed", "doc", "lead", (F.col("c") > SLICE).alias("many")).agg(F.min("pos").alias("pos"))
    cols = ["doc", "partner", "pos", "ppos", "lead"]

    def lagged(rows: DataFrame, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy("doc")
        return rows.withColumn("partner", F.lag("doc").over(order)).withColumn("ppos", F.lag("pos").over(order))

    few = lagged(once.where("not many"), "seed").select(cols)
    many = once.where("many").repartitionByRange("seed", "doc").withColumn("part", F.spark_partition_id())
    many = materialize(many, "ordered-places")
    # the first row of a seed in a part follows the seed's last row in an earlier part
    ends = many.groupBy("seed", "part").agg(F.max(F.struct("doc", "pos")).alias("end"))
    ends = ends.select("seed", "part", F.lag("end").over(Window.partitionBy("seed").orderBy("part")).alias("end"))
    inside = lagged(many, "seed", "part").join(ends, ["seed", "part"])
    across = inside.select("doc", F.coalesce("partner", "end.doc").alias("partner"), "pos",
                           F.coalesce("ppos", "end.pos").alias("ppos"), "lead")
    return few.union(across.select(cols)).where("partner is not null and partner <> lead").drop("lead")


def longest_holders(places: DataFrame) -> DataFrame:
    """(doc, partner, pos, ppos): each place of a seed with the document that has the longest stretch of shared
    seeds around the seed, where that is longer than the first document's by more than ``K`` words.

    Where documents hold parts of a passage, a seed's first and previous documents may be such parts; one that
    has all of it has the longest stretch."""
    along = Window.partitionBy("doc").orderBy("pos")
    apart = (F.col("pos") - F.lag("pos").over(along) > K + MAX_GAP).cast("int")
    numbered = places.select("seed", "doc", "pos", "lead", F.sum(F.coalesce(apart, F.lit(0))).over(along).alias("part"))
    part = Window.partitionBy("doc", "part")
    spans = materialize(numbered.withColumn("span", F.max("pos").over(part) - F.min("pos").over(part)).drop("part"), "stretches")
    best = (spans.groupBy("seed")
            .agg(F.max(F.struct("span", (-F.col("doc")).alias("d"), (-F.col("pos")).alias("p"))).alias("best"),
                 F.max(F.when(F.col("doc") == F.col("lead"), F.col("span"))).alias("own"))
            .where(F.col("best.span") > F.col("own") + K)
            .select("seed", (-F.col("best.d")).alias("held"), (-F.col("best.p")).alias("at")))
    met = spans.select("seed", "doc", "pos").join(best, "seed").where("doc <> held")
    later = F.col("doc") > F.col("held")
    return met.select(F.greatest("doc", "held").alias("doc"), F.least("doc", "held").alias("partner"),
                      F.when(later, F.col("pos")).otherwise(F.col("at")).alias("pos"),
                      F.when(later, F.col("at")).otherwise(F.col("pos")).alias("ppos"))


def exact_repeats(d: DataFrame, places: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Passages for every run of ``min_words`` words that an earlier document has too and that no
    passage of ``found`` covers; the partner is the run's first document.

    Both documents have a seed among the run's first ``WINDOW`` k-mers and the same ``ctx`` there, so
    only runs around seeds with a shared, uncovered ``ctx`` are hashed: at most ``WINDOW`` rows a place."""
    places = places.where("ctx is not null")
    spans = materialize(found.groupBy(F.col("doc_id").alias("doc"))
                        .agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans")), "found-spans")

    def uncovered(rows: DataFrame, start, end) -> DataFrame:
        inside = F.exists("spans", lambda s: (s["start_word"] <= start) & (s["end_word"] >= end))
        return rows.join(spans, "doc", "left").where(F.col("spans").isNull() | ~inside).drop("spans")

    shared = (places.groupBy("ctx").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
              .where("first <> last").select("ctx", "first"))
    asking = uncovered(places.select("ctx", "doc", "pos", "stop").join(shared, "ctx").where("doc <> first"),
                       F.greatest(F.col("pos") - WINDOW + 1, F.lit(0)), F.col("stop"))
    asked = materialize(asking.select("ctx").distinct(), "open-contexts")
    at = keep_ids(places.select("ctx", "doc", "pos"), asked, "ctx").groupBy("doc").agg(F.collect_set("pos").alias("at"))
    at = materialize(at, "open-places")
    words = keep_ids(d, at, "doc").mapInArrow(_words, "doc long, words array<int>").groupBy("doc").agg(F.min("words").alias("words"))
    runs = materialize(at.join(words, "doc").select("doc", "at", "words").mapInArrow(_runs(min_words), _RUN), "runs")
    first = (runs.groupBy("run").agg(F.min(F.struct("doc", "start")).alias("first"), F.max("doc").alias("last"))
             .where("first.doc <> last").select("run", "first"))
    hits = runs.join(first, "run").where("doc <> first.doc").select(
        "doc", "start", F.col("first.doc").alias("partner"), (F.col("first.start") - F.col("start")).alias("shift"))
    order = Window.partitionBy("doc", "partner", "shift").orderBy("start")
    joined = (hits.withColumn("island", F.col("start") - F.row_number().over(order))
              .groupBy("doc", "partner", "shift", "island")
              .agg(F.min("start").alias("s"), (F.max("start") + min_words).alias("e")))
    size = F.col("e") - F.col("s")
    return uncovered(joined, F.col("s"), F.col("e")).select(
        F.col("doc").alias("doc_id"), F.col("s").alias("start_word"), F.col("e").alias("end_word"),
        F.col("partner").alias("partner_id"), (F.col("s") + F.col("shift")).alias("partner_start"),
        (F.col("e") + F.col("shift")).alias("partner_end"), size.alias("n_equal"), F.lit(1.0).alias("identity"))


def passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, partner_id, partner_start, partner_end, n_equal, identity, doc_key): words
    of a document that repeat words of a document with a smaller id.

    A document is a distinct pair of id and text, repeated rows are one; ``doc_key`` names it
    (:func:`~.common.keyed`).  Of the texts that share an id one has the id as its key and the others come
    after all ids.  The first document of a passage appears as a partner alone.  NULL and empty texts and texts
    under eight words have no passage; rows with a NULL id cannot be named and take no part; other columns are
    ignored; an empty table gives none."""
    named = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null"), "id")
    d = named.select(F.col("__key").alias("doc"), "text")
    seeds = materialize(d.mapInArrow(_seeds(min_words), "seed long, doc long, pos int, ctx long, stop int"), "seeds")
    shared = (seeds.groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last"),
                                        F.count("*").alias("c"))
              .where("first.doc <> last").select("seed", F.col("first.doc").alias("lead"), F.col("first.pos").alias("lead_pos"), "c"))
    places = materialize(seeds.join(shared, "seed"), "places")
    first = places.where("doc <> lead").select("doc", F.col("lead").alias("partner"), "pos", F.col("lead_pos").alias("ppos"))
    links = first.union(documents_before(places)).union(longest_holders(places))
    # a stated number of partitions, so that they are not merged by size: chaining is work per row, not per byte
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chained = (links.repartition(tasks, "doc", "partner").sortWithinPartitions("doc", "partner", "pos", "ppos")
               .mapInArrow(_chain, _CHAIN))
    chained = materialize(chained.where(F.col("e") - F.col("s") + 2 * REACH >= min_words), "chains")

    # the words of gaps and ends, from both documents of a chain
    wanted = materialize(chained.select("doc").union(chained.select(F.col("partner"))).distinct(), "chained-docs")
    words = (keep_ids(d, wanted, "doc").mapInArrow(_words, "doc long, words array<int>")
             .groupBy("doc").agg(F.min("words").alias("words")))
    words = materialize(words, "words")
    key = ["doc", "partner", "s", "e", "ps", "pe"]

    def stretches(side: str, start: str, end: str, a: int, b: int) -> DataFrame:
        ranges = F.concat(
            F.array(F.array(F.greatest(F.col(start) - REACH, F.lit(0)), F.col(start))),
            F.transform("gaps", lambda g: F.array(F.get(g, a), F.get(g, b))),
            F.array(F.array(F.col(end), F.col(end) + REACH)))
        asked = chained.select(*key, "covered", F.col(side).alias("at"), ranges.alias("ranges"))
        own = words.select(F.col("doc").alias("at"), "words")
        cut = F.transform("ranges", lambda r: F.slice("words", F.get(r, 0) + 1, F.get(r, 1) - F.get(r, 0)))
        return asked.join(own, "at").select(*key, "covered", cut.alias("parts"))

    mine = stretches("doc", "s", "e", 0, 1).withColumnRenamed("parts", "a")
    theirs = stretches("partner", "ps", "pe", 2, 3).drop("covered").withColumnRenamed("parts", "b")
    found = materialize(mine.join(theirs, key).select(*key, "covered", "a", "b").distinct()
                        .mapInArrow(_align(min_words, identity), _PASSAGE), "passages")
    every = found.union(exact_repeats(d, places, found, min_words)).withColumn("doc_key", F.col("doc_id"))
    other = named.where("__key <> id").select("__key", "id").distinct()  # empty but for ids of several texts
    if other.isEmpty():
        return every
    for c in ("doc_id", "partner_id"):
        name = other.select(F.col("__key").alias(c), F.col("id").alias("__id"))
        every = every.join(name, c, "left").withColumn(c, F.coalesce("__id", c)).drop("__id")
    return every.select(*[c.split()[0] for c in _PASSAGE.split(", ")], "doc_key")


def cut_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of their passages (``found`` is :func:`passages` of the same rows), which stay
    in the partner of the smallest id.  Only the text that has a passage is cut, not the other texts of its
    id.  A document that has nothing else is dropped; the others keep their columns."""
    spans = (found.groupBy(F.col("doc_key").alias("__id"))
             .agg(F.collect_set(F.struct("start_word", "end_word")).alias("__spans")))
    spans = materialize(spans, "spans")

    joined = keyed(docs, id_col, text_col).join(spans, F.col("__key") == F.col("__id"), "left")
    text_at = docs.columns.index(text_col)
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(len(docs_names))]
            hit = batch.column(len(cols)).is_valid()
            at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            if len(at):
                new = [cut_words(cols[text_at][i].as_py(), batch.column(len(cols))[i].as_py()) for i in at.tolist()]
                cols[text_at] = pc.replace_with_mask(cols[text_at], hit, pa.array(new, cols[text_at].type))
                if size_at is not None:
                    cols[size_at] = pc.replace_with_mask(cols[size_at], hit, pa.array([len(t) for t in new]).cast(cols[size_at].type))
                left = np.ones(batch.num_rows, dtype=bool)
                left[at] = [t != "" for t in new]
                yield pa.RecordBatch.from_arrays(cols, names=docs_names).filter(pa.array(left))
            else:
                yield pa.RecordBatch.from_arrays(cols, names=docs_names)

    docs_names = docs.columns
    return joined.select(*docs_names, "__spans").mapInArrow(cut, docs.schema)


def cut_words(text: str | None, spans) -> str | None:
    """The text without the given ranges of words; empty if no word is left."""
    if text is None or spans is None:
        return text
    _, begin, end = word_hashes(text, ALNUM_SEPARATORS, with_offsets=True)
    keep = np.ones(len(begin), dtype=bool)
    for s in spans:
        keep[s["start_word"]:s["end_word"]] = False
    if not keep.any():
        return ""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    for a, b in zip(edge[0::2], edge[1::2], strict=True):  # words a .. b-1 go
        out.append(data[at:begin[a]])
        at = int(begin[b]) if b < len(begin) else len(data)
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass").strip()
