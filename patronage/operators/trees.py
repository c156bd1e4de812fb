"""Regression trees grown by tasks: forests and boosted trees of one table at once.

MLlib grows a tree level by level: a Spark job a level of each boosted tree, and a dense
histogram a node, which a forest of deep trees fills by the gigabyte.  Here the train
rows are cut into bins, one byte a value, and broadcast; a task grows a whole tree of
the forest, or all trees of a boosted model, one after another.  Candidate splits, gains,
stopping rules, residuals and importances are MLlib's.  Grown trees are Parquet rows;
scoring deals blocks of rows and parts of the trees to tasks, so no model passes the driver.

The broadcast holds at most ``LOCAL_ROWS`` train rows; a larger table stays with MLlib.
"""

from __future__ import annotations

import contextvars
import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import materialize

#: Most train rows that are broadcast: 16 bytes each, and one a feature for each number of bins.
LOCAL_ROWS = 1 << 20
#: Rows that a task scores at once, and of one block of them.
CHUNK, BLOCK = 1 << 18, 1 << 14
#: Values a feature that a partition sends for the candidate splits; beyond it every so many ranks.
_VALUES = 1 << 14


# ----------------------------------------------------------------------- candidate splits

def _merge(values: np.ndarray, counts: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts; thinned to ``most`` evenly spaced ranks."""
    found, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, weights=counts, minlength=len(found))
    if most and len(found) > most:
        ranks = np.cumsum(n)
        keep = np.unique(np.searchsorted(ranks, np.linspace(1, ranks[-1], most)))
        found, n = found[keep], np.diff(ranks[keep], prepend=0)
    return found, n


def split_points(values: np.ndarray, counts: np.ndarray, max_bins: int) -> np.ndarray:
    """MLlib's candidate splits of a continuous feature: all midpoints of at most ``max_bins``
    values, or those nearest to equal shares of the rows."""
    mid = (values[:-1] + values[1:]) / 2
    if len(mid) < max_bins:
        return mid
    ranks = np.cumsum(counts)
    pairs, stride = ranks[:-1] + ranks[1:], ranks[-1] / max_bins
    cuts, at = [], 0
    for j in range(1, max_bins):
        at = max(at, int(np.searchsorted(pairs, 2 * j * stride, "right")))
        if at >= len(mid):
            break
        cuts.append(at)
        at += 1
    return mid[cuts]


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (feature, values, counts) of a partition."""
    held: list = []
    for batch in batches:
        x = _matrix(batch)
        if not np.isfinite(x).all():
            raise ValueError("features must not be NaN or infinite")
        for f in range(x.shape[1]):
            v, n = x[:, f], np.ones(len(x))
            if f < len(held):
                v, n = np.concatenate([held[f][0], v]), np.concatenate([held[f][1], n])
                held[f] = _merge(v, n, _VALUES)
            else:
                held.append(_merge(v, n, _VALUES))
    for f, (v, n) in enumerate(held):
        yield pa.RecordBatch.from_pydict({"feature": pa.array([f], pa.int32()), "v": [v], "n": [n]})


def _edges(rows: DataFrame, features: int, bins: Sequence[int]) -> dict[int, list[np.ndarray]]:
    """For each number of bins, every feature's candidate splits."""
    held = [([], []) for _ in range(features)]
    for r in rows.mapInArrow(_count_values, "feature int, v array<double>, n array<double>").toArrow().to_pylist():
        held[r["feature"]][0].append(r["v"])
        held[r["feature"]][1].append(r["n"])
    merged = [_merge(np.concatenate(v), np.concatenate(n)) for v, n in held]
    return {b: [split_points(v, n, b) for v, n in merged] for b in bins}


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of the rows' values, one feature after another: a value goes left of the splits it does not exceed."""
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.uint8)


# ----------------------------------------------------------------------- growth

class Tree(NamedTuple):
    """Nodes in order of level.  ``left`` is the left child (the right one follows), 0 at a leaf; a row goes
    right if its bin exceeds ``cut``."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(x.shape[1], dtype=np.int64)
        rows = np.arange(x.shape[1])
        while len(rows):
            at = node[rows]
            inner = self.left[at] > 0
            rows, at = rows[inner], at[inner]
            node[rows] = self.left[at] + (x[self.feature[at], rows] > self.cut[at])
        return self.value[node]


def _dense_split(key, w, wy, W, S, bins, unit):
    """Best (score, cut) of each node by a histogram of every bin."""
    n = len(W)
    cw = np.bincount(key, weights=None if unit else w, minlength=n * bins).reshape(n, bins).cumsum(axis=1)[:, :-1]
    cs = np.bincount(key, weights=wy, minlength=n * bins).reshape(n, bins).cumsum(axis=1)[:, :-1]
    rest = W[:, None] - cw
    with np.errstate(divide="ignore", invalid="ignore"):
        score = cs * cs / cw + (S[:, None] - cs) ** 2 / rest
    score[(cw == 0) | (rest == 0)] = -np.inf
    cut = score.argmax(axis=1)
    return score[np.arange(n), cut], cut


def _sorted_split(key, w, wy, node, W, S, bins, before_w, before_s):
    """The same by sorting the rows, for many nodes of few rows."""
    n = len(W)
    score, cut = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
    packed = np.sort(key << 32 | np.arange(len(key)))
    key, at = packed >> 32, packed & 0xFFFFFFFF
    of = node[at]
    ends = np.flatnonzero((key[1:] != key[:-1]) & (of[1:] == of[:-1]))
    if not len(ends):
        return score, cut
    mine = of[ends]
    cw, cs = np.cumsum(w[at])[ends] - before_w[mine], np.cumsum(wy[at])[ends] - before_s[mine]
    found = cs * cs / cw + (S[mine] - cs) ** 2 / (W[mine] - cw)
    first = np.flatnonzero(np.diff(mine, prepend=-1))
    best = np.maximum.reduceat(found, first)
    hit = np.flatnonzero(found == np.repeat(best, np.diff(first, append=len(mine))))
    hit = hit[np.diff(mine[hit], prepend=-1) > 0]
    score[mine[hit]], cut[mine[hit]] = found[hit], key[ends[hit]] - mine[hit] * bins
    return score, cut


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: Sequence[int], max_depth: int) -> tuple[Tree, np.ndarray]:
    """A regression tree of the rows (features x rows of bins), and each feature's sum of gains.

    A level is grown at once.  Of equal gains the first feature and the lowest split win."""
    features, gains = len(bins), np.zeros(len(bins))
    unit, wy = bool((w == 1).all()), w * y
    node, depth, size = np.zeros(len(y), dtype=np.int64), 0, 1
    parts: list[list[np.ndarray]] = [[], [], [], []]
    waiting = np.zeros(1, dtype=np.int64)  # the level's nodes that still have rows here, by place in the level
    level_value = np.array([wy.sum() / w.sum()]) if len(y) else np.zeros(1)  # a forest's tree may draw no row
    while True:
        n = len(level_value)
        feature, cut, left = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int32)
        for held, made in zip(parts, (feature, cut, left, level_value)):
            held.append(made)
        if depth == max_depth or not len(y):
            break
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        W, S = np.add.reduceat(w, starts), np.add.reduceat(wy, starts)
        base, k = S * S / W, len(starts)
        before_w, before_s = np.cumsum(W) - W, np.cumsum(S) - S
        best, which, where = base.copy(), np.full(k, -1), np.zeros(k, dtype=np.int64)
        width, start = 0, node
        for f in range(features):
            if bins[f] < 2:
                continue
            if bins[f] != width:
                width, start = bins[f], node * bins[f]
            if k * width <= 2 * len(y):
                score, at = _dense_split(start + x[f], w, wy, W, S, width, unit)
            else:
                score, at = _sorted_split(start + x[f], w, wy, node, W, S, width, before_w, before_s)
            # sums of the same rows in another order are not a better split
            better = score - base > (best - base) * (1 + 1e-9) + 1e-12 * base
            best[better], which[better], where[better] = score[better], f, at[better]
        split = which >= 0
        if not split.any():
            break
        np.add.at(gains, which[split], (best - base)[split])
        place = waiting[split]
        first = size + 2 * np.arange(len(place))  # children are numbered in order
        feature[place], cut[place], left[place] = which[split], where[split], first
        size += 2 * len(place)
        # rows of nodes that are split, in order of their new node
        child = np.full(k, -1)
        child[split] = 2 * np.arange(len(place))
        to, at = child[node], np.arange(len(y))
        to = np.where(to < 0, -1, to + (x[which[node], at] > where[node]))
        # numpy sorts small numbers much faster
        order = np.argsort(to.astype(np.int16) if 2 * len(place) < 1 << 15 else to, kind="stable")
        order = order[np.searchsorted(to[order], 0):]
        to = to[order]
        y, w, wy = y[order], w[order], wy[order]
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        W, S = np.add.reduceat(w, starts), np.add.reduceat(wy, starts)
        level_value = S / W
        mixed = np.minimum.reduceat(y, starts) < np.maximum.reduceat(y, starts)
        waiting = np.flatnonzero(mixed)
        stay = mixed[to]
        order, y, w, wy = order[stay], y[stay], w[stay], wy[stay]
        if depth + 1 < max_depth:
            x = np.take(x, order, axis=1)
        node = (np.cumsum(mixed) - 1)[to[stay]]
        depth += 1
    return Tree(*(np.concatenate(p) for p in parts)), gains


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(key: np.ndarray, seed: int, number: int, rate: float) -> np.ndarray:
    """How often each row is drawn for tree ``number``: Poisson, from a hash of the row, so it depends
    neither on partitioning nor on the rows' order."""
    salt = _mixed(np.array([(seed * 1_000_003 + number) & int(_MASK)], dtype=np.uint64))
    u = (_mixed(key.view(np.uint64) + salt) >> np.uint64(11)) / float(1 << 53)
    p, cdf = np.exp(-rate), []
    for i in itertools.count(1):
        cdf.append((cdf[-1] if cdf else 0.0) + p)
        p *= rate / i
        if 1 - cdf[-1] < 1e-15 or i > 10 * rate + 60:
            return np.searchsorted(np.array(cdf), u, "right").astype(float)


class Unit(NamedTuple):
    """What one task grows: a tree of a forest, or all trees of a boosted model."""
    model: str
    part: int
    number: int
    max_depth: int
    max_bins: int
    seed: int = 0
    rate: float = 0.0
    boost: int = 0
    step: float = 0.0


def _units(name: str, est) -> list[Unit]:
    if isinstance(est, GBTRegressor):
        return [Unit(name, 0, 0, est.getMaxDepth(), est.getMaxBins(), boost=est.getMaxIter(), step=est.getStepSize())]
    from patronage.operators.clv_ml import forest_parts
    return [Unit(name, i, j, p.getMaxDepth(), p.getMaxBins(), p.getSeed(), p.getSubsamplingRate())
            for i, p in enumerate(forest_parts(est)) for j in range(p.getNumTrees())]


def grows(est) -> bool:
    """Whether the estimator's settings are ones that tasks grow."""
    if not isinstance(est, (GBTRegressor, RandomForestRegressor)):
        return False
    if isinstance(est, RandomForestRegressor):
        own = est.getBootstrap()
    else:
        own = est.getSubsamplingRate() == 1.0 and est.getLossType() == "squared" and not est.isSet("validationIndicatorCol")
    return (own and est.getFeatureSubsetStrategy() == "all" and est.getMaxBins() <= 256 and est.getMinInstancesPerNode() == 1
            and est.getMinInfoGain() == 0.0 and est.getMinWeightFractionPerNode() == 0.0 and not est.isSet("weightCol"))


def _grow_unit(unit: Unit, x: np.ndarray, y: np.ndarray, key: np.ndarray, bins: Sequence[int]) -> Iterator[tuple]:
    """(number, weight, tree, gains) of each tree."""
    if not unit.boost:
        w = draws(key, unit.seed, unit.number, unit.rate)
        drawn = np.flatnonzero(w)
        tree, gains = grow(x[:, drawn], y[drawn], w[drawn], bins, unit.max_depth)
        yield unit.number, 1.0, tree, gains
        return
    score, ones = np.zeros(len(y)), np.ones(len(y))
    for i in range(unit.boost):
        # squared loss: its negative gradient is twice the residual; the first tree counts whole
        tree, gains = grow(x, y if i == 0 else 2.0 * (y - score), ones, bins, unit.max_depth)
        weight = 1.0 if i == 0 else unit.step
        score += weight * tree.predict(x)
        yield i, weight, tree, gains


_TREES = ("model string, part int, number int, weight double, nodes long, feature binary, cut binary, left binary, "
          "value binary, gains array<double>")


def _grow_all(units: Sequence[Unit], shared, bins: dict[int, list[int]]):
    """mapInPandas function: the trees of the units whose numbers come in."""
    def grow_units(batches):
        y, key, x = shared.value
        for pdf in batches:
            for i in pdf["id"]:
                u = units[i]
                made = [(u.model, u.part, number, weight, len(t.left), t.feature.tobytes(), t.cut.tobytes(), t.left.tobytes(),
                         t.value.tobytes(), gains.tolist()) for number, weight, t, gains in _grow_unit(u, x[u.max_bins], y, key, bins[u.max_bins])]
                yield pd.DataFrame(made, columns=[c.split()[0] for c in _TREES.split(", ")])
    return grow_units


def _pack(edges: dict[int, list[np.ndarray]]):
    """mapInArrow function: blocks of rows as bytes."""
    def pack(batches):
        for batch in batches:
            x = _matrix(batch)
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([len(x)], pa.int64()), "y": [batch.column("y").to_numpy(zero_copy_only=False).tobytes()],
                "key": [batch.column("key").to_numpy().tobytes()], **{f"x{b}": [_binned(x, e).tobytes()] for b, e in edges.items()}})
    return pack


def grow_models(train: DataFrame, label: str, estimators: dict) -> dict:
    """Fits the forests and boosted trees of ``estimators`` (by name) to ``train`` (CustomerID, features, label)
    in one job, largest work first."""
    units = sorted((u for name, est in estimators.items() for u in _units(name, est)), key=lambda u: -u.boost * u.max_depth)
    rows = train.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), "CustomerID")
    features = rows.select(F.size("x").alias("n")).first()["n"]
    count = train.count()
    wanted = {b: max(min(b, count), 2) for b in sorted({u.max_bins for u in units})}
    found = _edges(rows.select("x"), features, sorted(set(wanted.values())))
    edges = {b: found[n] for b, n in wanted.items()}
    packed = rows.select("x", "y", F.xxhash64("CustomerID", "x", "y").alias("key")).mapInArrow(
        _pack(edges), "n long, y binary, key binary, " + ", ".join(f"x{b} binary" for b in edges)).toArrow().to_pylist()
    y = np.concatenate([np.frombuffer(p["y"]) for p in packed])
    if not np.isfinite(y).all():
        raise ValueError(f"{label} must not be NULL, NaN or infinite")
    key = np.concatenate([np.frombuffer(p["key"], dtype=np.int64) for p in packed])
    order = np.argsort(key, kind="stable")  # one order of the rows, whatever the partitions
    x = {b: np.concatenate([np.frombuffer(p[f"x{b}"], dtype=np.uint8).reshape(features, -1) for p in packed], axis=1)[:, order]
         for b in edges}
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((y[order], key[order], x))
    bins = {b: [len(e) + 1 for e in es] for b, es in edges.items()}
    grown = spark.range(0, len(units), 1, len(units)).mapInPandas(_grow_all(units, shared, bins), _TREES)
    # fitted models outlive the query that made them, and so its scope
    table = contextvars.Context().run(materialize, grown, "trees")
    shared.unpersist()
    gains: dict[str, list] = {}
    for r in table.select("model", "part", "number", "gains").orderBy("model", "part", "number").collect():
        gains.setdefault(r["model"], []).append((r["part"], np.array(r["gains"])))
    return {name: GrownTrees(table.where(F.col("model") == name).drop("gains"), edges[est.getMaxBins()], gains[name],
                             forest=isinstance(est, RandomForestRegressor)) for name, est in estimators.items()}


# ----------------------------------------------------------------------- scoring

def _normalised(total: np.ndarray) -> np.ndarray:
    return total / total.sum() if total.sum() > 0 else total


class GrownTrees:
    """A fitted forest (mean of its trees) or boosted model (weighted sum)."""

    def __init__(self, table: DataFrame, edges: Sequence[np.ndarray], gains: Sequence, forest: bool, output: str = "prediction"):
        self.table, self.edges, self.gains, self.forest, self.output = table, list(edges), list(gains), forest, output

    @property
    def getNumTrees(self) -> int:
        return len(self.gains)

    @property
    def parts(self) -> list[GrownTrees]:
        """The same trees as models of one part each."""
        return [GrownTrees(self.table.where(F.col("part") == p), self.edges, [g for g in self.gains if g[0] == p], self.forest)
                for p in sorted({p for p, _ in self.gains})]

    @property
    def featureImportances(self):
        # a forest's trees count alike, boosted ones by their gains, as in MLlib
        return Vectors.dense(_normalised(sum(_normalised(g) if self.forest else g for _, g in self.gains)))

    def setPredictionCol(self, name: str) -> GrownTrees:
        return GrownTrees(self.table, self.edges, self.gains, self.forest, name)

    def transform(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` (with ``features``) and the prediction.  Its rows are written once with a number that
        their scores are joined by; a part's sums are added in order of the parts."""
        rows = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()), "scored")
        chunks = -(-rows.count() // CHUNK) or 1
        parts = sorted({p for p, _ in self.gains})
        blocks = rows.select("_row", vector_to_array("features").alias("x")).mapInArrow(
            _blocks(self.edges, chunks), "chunk int, row binary, x binary").withColumn("part", F.explode(F.lit(parts)))
        trees = self.table.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        sums = blocks.groupBy("part", "chunk").cogroup(trees.groupBy("part", "chunk")).applyInPandas(
            _score, "_row long, part int, score double")
        total = F.lit(0.0)
        for p in parts:
            total = total + F.max(F.when(F.col("part") == p, F.col("score")))
        scores = sums.groupBy("_row").agg((total / F.lit(float(self.getNumTrees if self.forest else 1))).alias(self.output))
        return rows.join(scores, "_row").drop("_row")


def _blocks(edges: Sequence[np.ndarray], chunks: int):
    """mapInArrow function: rows and their bins as bytes, dealt to ``chunks`` groups."""
    def pack(batches):
        from pyspark import TaskContext
        turn = itertools.count(TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([next(turn) % chunks], pa.int32()), "row": [part.column("_row").to_numpy().tobytes()],
                    "x": [_binned(_matrix(part), edges).tobytes()]})
    return pack


def _score(blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas function: the weighted sum of a part's trees for the rows of a chunk."""
    out = []
    grown = [(t.weight, Tree(np.frombuffer(t.feature, dtype=np.uint8), np.frombuffer(t.cut, dtype=np.uint8),
                             np.frombuffer(t.left, dtype=np.int32), np.frombuffer(t.value)))
             for t in trees.sort_values("number").itertuples()]
    for b in blocks.itertuples():
        row = np.frombuffer(b.row, dtype=np.int64)
        x = np.frombuffer(b.x, dtype=np.uint8).reshape(-1, len(row))
        score = np.zeros(len(row))
        for weight, tree in grown:
            score += weight * tree.predict(x)
        out.append(pd.DataFrame({"_row": row, "part": np.int32(b.part), "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"_row": pd.Series(dtype="int64"), "part": pd.Series(dtype="int32"),
                                                    "score": pd.Series(dtype="float64")})
