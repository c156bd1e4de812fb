"""Spelling variants by k-d trees over letter counts.

A word is a point: how often it has each letter.  One inserted, deleted or replaced
code point moves the point by a Manhattan distance of at most two, so the near words
of a word are found by range searches in the k-d trees of its own length and of the
lengths one below and one above, and the order of the letters is then compared.

The trees have two storeys.  The upper one of a length with many words is fitted on a
bounded sample and cuts that length into cells of some thousand words; every word is
put into its cell and sent to each cell whose box is near enough.  The lower one is built
over all words of a cell by the task that has the cell.  A word gets from each cell
the number of its near words there and the best one; these are added up.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .decontaminate import LOWER, UPPER

#: Words of a cell of the upper trees.
CELL_WORDS = 16_384
#: Sampled words a cell that the upper trees are fitted on, and their largest number in all.
CELL_SAMPLE, MAX_SAMPLE = 32, 1 << 20
#: Words of a leaf of the lower trees.
LEAF = 192
#: Pairs whose letters are compared at a time.
PAIRS = 1 << 18

_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
DIMS = len(_LETTERS)
#: Place of a code point among the letters.
_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[_LETTERS] = range(DIMS)


def spelled_words(docs: DataFrame, min_letters: int = 7, min_count: int = 2, damage: int | None = 31,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the maximal runs of Latin letters, A-Z lower-cased, that have ``min_letters`` code points or
    more and occur ``min_count`` times or more.

    With ``damage`` a run whose crc32 of ``<id>:<run>`` it divides first loses the code point at that crc32
    modulo the run's length.  A NULL id is written as an empty text; NULL text has no runs; every row
    counts, repeated ones too."""
    run = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")),
                               F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_letters},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if damage:
        hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs, word = hashed, F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= min_letters) & (F.col("n") >= min_count))


# -- trees ----------------------------------------------------------------

def letter_counts(words: np.ndarray) -> np.ndarray:
    """(n, DIMS) counts of the letters of ``words``, an (n, length) array of code points."""
    n, length = words.shape
    out = np.zeros((n, DIMS), dtype=np.int32)
    rows = np.arange(n)
    for i in range(length):
        out[rows, _PLACE[words[:, i]]] += 1
    return out


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """The letter with the largest spread and the count up to which points go left; None if all are equal."""
    dim = int(points.var(axis=0).argmax())
    col = points[:, dim]
    low, high = int(col.min()), int(col.max())
    if low == high:
        return None
    return dim, min(max(int(np.median(col)), low), high - 1)


class Upper:
    """A k-d tree whose leaves are numbered cells; nodes are (letter, count, left, right) or a cell's number."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list = []
        self.cells = 0
        self._grow(sample, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        cut = _cut(points) if cells > 1 and len(points) > 1 else None
        if cut is None:
            self.nodes[me] = self.cells
            self.cells += 1
        else:
            left = points[:, cut[0]] <= cut[1]
            share = min(max(round(cells * left.mean()), 1), cells - 1)
            self.nodes[me] = (*cut, self._grow(points[left], share), self._grow(points[~left], cells - share))
        return me

    def reach(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, points that are within ``radius`` of the cell's box); with 0 each point's own cell."""
        todo = [(0, np.arange(len(points)), np.zeros(len(points), np.int32), {})]
        while todo:
            node, at, far, box = todo.pop()
            if not len(at):
                continue
            if isinstance(self.nodes[node], int):
                yield self.nodes[node], at
                continue
            dim, cut, left, right = self.nodes[node]
            low, high = box.get(dim, (-1, 1 << 30))
            x = points[at, dim]
            before = np.maximum(np.maximum(low - x, x - high), 0)
            for child, side in ((left, (low, cut)), (right, (cut + 1, high))):
                now = far - before + np.maximum(np.maximum(side[0] - x, x - side[1]), 0)
                near = now <= radius
                todo.append((child, at[near], now[near], {**box, dim: side}))


class Lower:
    """A k-d tree over points, with the box of each node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        #: Letters folded to 64 bits, each set if the count is odd: one edit changes at most two of them.
        odd = (points & 1).astype(np.uint64)
        self.odd = np.bitwise_xor.reduce(odd << (np.arange(points.shape[1], dtype=np.uint64) % np.uint64(64)), axis=1)
        self.nodes: list = []
        self._grow(np.arange(len(points)), leaf)

    def _grow(self, at: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        mine = self.points[at]
        low, high = mine.min(axis=0), mine.max(axis=0)
        self.nodes.append(None)
        cut = _cut(mine) if len(at) > leaf else None
        if cut is None:
            self.nodes[me] = (low, high, at, None)
        else:
            left = mine[:, cut[0]] <= cut[1]
            self.nodes[me] = (low, high, self._grow(at[left], leaf), self._grow(at[~left], leaf))
        return me

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, point) at a Manhattan distance of exactly ``radius``."""
        odd = (queries & 1).astype(np.uint64)
        odd = np.bitwise_xor.reduce(odd << (np.arange(queries.shape[1], dtype=np.uint64) % np.uint64(64)), axis=1)
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            low, high, left, right = self.nodes[node]
            x = queries[at]
            at = at[np.maximum(np.maximum(low - x, x - high), 0).sum(axis=1) <= radius]
            if not len(at):
                continue
            if right is not None:
                todo += [(left, at), (right, at)]
                continue
            for i in range(0, len(at), step := max(1, PAIRS // len(left))):
                some = at[i:i + step]
                q, p = np.nonzero(np.bitwise_count(odd[some][:, None] ^ self.odd[left][None, :]) <= radius)
                q, p = some[q], left[p]
                same = np.abs(queries[q] - self.points[p]).sum(axis=1) == radius
                yield q[same], p[same]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one edit: of equal length in one place, else ``b`` is one longer
    and has one code point more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int64).sum(axis=1) if a.shape[1] else 0
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int64).sum(axis=1)
    return front + back >= a.shape[1]


# -- searching ------------------------------------------------------------

class Words(NamedTuple):
    """Words of one length: code points, counts of the word, rows of the input."""
    codes: np.ndarray
    n: np.ndarray
    row: np.ndarray


def _by_length(words: list[bytes], n: np.ndarray) -> dict[int, Words]:
    length = np.fromiter(map(len, words), np.int64, len(words))
    out = {}
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        codes = np.frombuffer(b"".join([words[i] for i in at.tolist()]), dtype=np.uint8).reshape(len(at), size)
        out[size] = Words(codes, n[at], at)
    return out


def _best(query: Words, mine: Words, q: np.ndarray, p: np.ndarray, count: np.ndarray, best: list) -> None:
    """Add near pairs (query, point) to the counts and the best words, largest n and then smallest word."""
    np.add.at(count, query.row[q], 1)
    for i, j in zip(query.row[q].tolist(), p.tolist()):
        now = (-int(mine.n[j]), mine.codes[j].tobytes())
        if best[i] is None or now < best[i]:
            best[i] = now


def _large_group(query: Words, mine: Words, q: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, int]]:
    """Near pairs of all of ``q`` with all of ``p``, found by the words with one code point taken out rather than
    pair by pair."""
    gap = query.codes.shape[1] == mine.codes.shape[1]

    def without(word: bytes) -> set[bytes]:
        return {word[:i] + (b"\0" if gap else b"") + word[i + 1:] for i in range(len(word))}

    longer, other = (mine, query) if mine.codes.shape[1] >= query.codes.shape[1] else (query, mine)
    a, b = (p, q) if longer is mine else (q, p)
    held = defaultdict(list)
    for i in a.tolist():
        for key in without(longer.codes[i].tobytes()):
            held[key].append(i)
    for j in b.tolist():
        word = other.codes[j].tobytes()
        for key in without(word) if gap else (word,):
            for i in held.get(key, ()):
                if not gap or longer.codes[i].tobytes() != word:
                    yield (j, i) if longer is mine else (i, j)


def _search(query: Words, mine: Words, tree: Lower, classes: list[np.ndarray], count: np.ndarray, best: list) -> None:
    """All near words of ``query`` among ``mine``; ``tree`` has one point for each class of equal letter counts."""
    radius = 2 if query.codes.shape[1] == mine.codes.shape[1] else 1
    points, group = np.unique(letter_counts(query.codes), axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    members = np.split(order, np.cumsum(np.bincount(group.ravel(), minlength=len(points)))[:-1])
    sizes, own = np.array([len(m) for m in members]), np.array([len(c) for c in classes])
    for qs, ps in tree.within(points, radius):
        both = sizes[qs] * own[ps]
        for i in np.flatnonzero(both > 4096).tolist():
            found = list(_large_group(query, mine, members[qs[i]], classes[ps[i]]))
            if found:
                q, p = (np.array(x) for x in zip(*found))
                _best(query, mine, q, p, count, best)
        few = np.flatnonzero(both <= 4096)
        q = [np.repeat(members[qs[i]], own[ps[i]]) for i in few.tolist()]
        p = [np.tile(classes[ps[i]], sizes[qs[i]]) for i in few.tolist()]
        if not q:
            continue
        q, p = np.concatenate(q), np.concatenate(p)
        for i in range(0, len(q), step := max(1, PAIRS * 16 // max(mine.codes.shape[1], 1))):
            a, b = query.codes[q[i:i + step]], mine.codes[p[i:i + step]]
            near = one_edit(a, b) if a.shape[1] <= b.shape[1] else one_edit(b, a)
            _best(query, mine, q[i:i + step][near], p[i:i + step][near], count, best)


def near_in_cell(words: list[bytes], n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list]:
    """For each word the number of near words among the ``own`` ones and the best (-n, word); words and
    counts are those of one cell, own ones of one length."""
    count, best = np.zeros(len(words), dtype=np.int64), [None] * len(words)
    at = np.flatnonzero(own)
    if not len(at):
        return count, best
    mine = next(iter(_by_length([words[i] for i in at.tolist()], n[at]).values()))
    points, group = np.unique(letter_counts(mine.codes), axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    classes = np.split(order, np.cumsum(np.bincount(group.ravel(), minlength=len(points)))[:-1])
    tree = Lower(points)
    for query in _by_length(words, n).values():
        _search(query, mine, tree, classes, count, best)
    return count, best


def _near(table: pa.Table) -> pa.Table:
    words = table["code"].to_pylist()
    n = table["n"].to_numpy().astype(np.int64)
    count, best = near_in_cell(words, n, table["own"].to_numpy(zero_copy_only=False).astype(bool))
    hit = np.flatnonzero(count)
    some = [best[i] for i in hit.tolist()]
    return pa.table({"code": pa.array([words[i] for i in hit.tolist()], pa.binary()), "n_near": pa.array(count[hit]),
                     "form_n": pa.array([-x[0] for x in some], pa.int64()), "form": pa.array([x[1] for x in some], pa.binary())})


def _deal(trees):
    """mapInArrow function: each word in its own cell and in all cells that may hold near words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, n = b.column("code").to_pylist(), b.column("n").to_numpy()
            for size, words in _by_length(codes, n).items():
                points = letter_counts(words.codes)
                for other in (size - 1, size, size + 1):
                    tree = trees.value.get(other)
                    own = np.full(len(points), -1)
                    if tree and other == size:
                        for cell, at in tree.reach(points, 0):
                            own[at] = cell
                    cells = tree.reach(points, 2 if other == size else 1) if tree else [(-1, np.arange(len(points)))]
                    for cell, at in cells:
                        rows = words.row[at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), other, np.int32)), pa.array(np.full(len(at), cell, np.int32)),
                             pa.array([codes[i] for i in rows.tolist()], pa.binary()), pa.array(n[rows]),
                             pa.array((own[at] == cell) & (other == size))],
                            names=["length", "cell", "code", "n", "own"])

    return run


def upper_trees(words: DataFrame, cell_words: int = CELL_WORDS) -> dict[int, Upper]:
    """The upper tree of each length that has more than ``cell_words`` words, from about ``CELL_SAMPLE`` words
    a cell, the same ones in every run, and at most about ``MAX_SAMPLE`` in all."""
    many = words.groupBy(F.length("code").alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > cell_words)
    sizes = {r["length"]: r["n"] for r in many.collect()}
    if not sizes:
        return {}
    share = min(1.0, CELL_SAMPLE / cell_words, MAX_SAMPLE / sum(sizes.values()))
    picked = (words.where(F.length("code").isin(list(sizes)))
              .where(F.pmod(F.xxhash64("code"), F.lit(1 << 30)) < int(share * (1 << 30))).select("code").toArrow())
    sample = _by_length(picked["code"].to_pylist(), np.zeros(len(picked), np.int64))
    return {size: Upper(letter_counts(w.codes), -(-sizes[size] // cell_words)) for size, w in sample.items()}


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) of every row of ``words(word, n)``, distinct words of a-z and U+00C0 to U+00FF: the number
    of near words, the one with the largest n (ties: the smallest in code-point order) and its n."""
    coded = materialize(words.select(F.encode("word", "ISO-8859-1").alias("code"), "n"), "words")
    trees = coded.sparkSession.sparkContext.broadcast(upper_trees(coded, cell_words))
    dealt = coded.mapInArrow(_deal(trees), "length int, cell int, code binary, n long, own boolean")
    found = dealt.groupBy("length", "cell").applyInArrow(_near, "code binary, n_near long, form_n long, form binary")
    found = found.groupBy("code").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best"))
    both = coded.select("code", "n", F.lit(None).cast("long").alias("n_near"), F.lit(None).cast("struct<m:long,form:binary>").alias("best"))
    both = both.unionByName(found.withColumn("n", F.lit(None).cast("long"))).groupBy("code").agg(
        F.max("n").alias("n"), F.max("n_near").alias("n_near"), F.max("best").alias("best"))

    def text(code: Column) -> Column:
        return F.decode(code, "ISO-8859-1")

    return both.select(text(F.col("code")).alias("word"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       text(F.col("best.form")).alias("best"), (-F.col("best.m")).alias("best_n"))


def spelling_variants(docs: DataFrame, min_letters: int = 7, min_count: int = 2, ratio: int = 10, damage: int | None = 31,
                      cell_words: int = CELL_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of :func:`spelled_words`.

    Words are near if they differ by exactly one inserted, deleted or replaced code point.  ``form`` is the near
    word of largest n (ties: the smallest in code-point order) if that is ``ratio`` times the word's n or more,
    ``root`` the last word that forms lead to, the word itself without one.  Tables without words give an
    empty table; other columns are ignored.  n grows ``ratio``-fold along forms, so paths are short."""
    near = near_words(spelled_words(docs, min_letters, min_count, damage, id_col, text_col), cell_words)
    good = F.col("best_n") >= ratio * F.col("n")
    words = materialize(near.select("word", "n", "n_near", F.when(good, F.col("best")).alias("form"),
                                    F.when(good, F.col("best_n")).alias("form_n")), "forms")
    up = words.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = materialize(up, "roots")
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = up.join(above, "root")
        if moved.isEmpty():
            break
        up = up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"))
    return words.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                 "n", "n_near", "form_n")
