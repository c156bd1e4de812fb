"""Toxic passages by maximum-scoring segment search.

* A word's score is its log-odds between toxic and other labelled texts, with
  Dirichlet priors: the background counts of the whole corpus spread the prior
  mass over words, and a word's prior leans on the log-odds of its first
  ``PREFIX`` letters, so rare inflected forms learn from their stem.
* Scores are lowered by ``drift``, so a long harmless text has a negative
  expectation, and one linear scan (Ruzzo and Tompa) finds all maximal-scoring
  segments of a text.
* Segment scores are calibrated by extreme-value theory: the expected number of
  segments of score S in n words is K n exp(-lambda S), with lambda from the
  background distribution and K from the best segments of harmless texts.
* A logistic curve, fitted on labelled texts that were not counted, turns a
  text's segment evidence into a score from 0 to 1.

Bounds: words are hashed to ``2**WORD_BITS`` counters and stems to
``2**STEM_BITS``; at most ``max_labels`` labelled texts (smallest hashes of the
id) are used for fitting.  Background counts cover every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded, materialize

WORD_BITS, STEM_BITS, PREFIX = 20, 18, 5
_WORD = re.compile(r"\w+")
_FLUSH = 200_000
#: A segment is significant if its E-value is below exp(-3), about 0.05.
SIGNIFICANT = 3.0


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_bucket(word: str) -> int:
    return crc32(word.encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)


def stem_bucket(word: str) -> int:
    return crc32(word[:PREFIX].encode("utf-8", "replace"), 77) & ((1 << STEM_BITS) - 1)


# -- segment search -------------------------------------------------------

def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in order, in linear time."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                kept.append((start, i + 1, left, right))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, r - lo) for a, b, lo, r in kept]


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """``maximal_segments`` after runs of one sign are summed (same result,
    far fewer steps, since few words score above zero)."""
    if not len(scores) or scores.max() <= 0:
        return []
    sign = scores > 0
    first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    ends = np.append(first[1:], len(scores))
    return [(int(first[a]), int(ends[b - 1]), s) for a, b, s in maximal_segments(np.add.reduceat(scores, first).tolist())]


# -- model ----------------------------------------------------------------

@dataclass
class ToxicModel:
    toxic: np.ndarray        # word counts in toxic texts
    labelled: np.ndarray     # word counts in all counted labelled texts
    prior: np.ndarray        # prior mass of a word, from the background
    stem_rate: np.ndarray    # toxic share of a stem's words, smoothed
    base: float              # toxic share of all counted words
    drift: float
    lam: float = 1.0
    log_k: float = 0.0
    weights: np.ndarray | None = None

    def word_score(self, word: str) -> float:
        b = word_bucket(word)
        m = self.prior[b]
        rate = (self.toxic[b] + m * self.stem_rate[stem_bucket(word)]) / (self.labelled[b] + m)
        return math.log(rate / (1 - rate)) - math.log(self.base / (1 - self.base)) - self.drift


class Scorer:
    """Scores texts; remembers word scores, up to a bound."""

    def __init__(self, model: ToxicModel, remembered: int = 120_000):
        self.model, self.bound, self.memo = model, remembered, {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.bound:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.model.word_score(w)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """(number of words, maximal segments as start, end, score, lambda times score)."""
        words = words_of(text)
        found = segments_of(self.word_scores(words)) if words else []
        return len(words), [(a, b, s, self.model.lam * s) for a, b, s in found]

    def probability(self, features: list[float]) -> float:
        w = self.model.weights
        z = float(np.dot(w[1:], features) + w[0]) if w is not None else -20.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features_of(n_words: int, raw, log_k: float) -> list[float]:
    """Evidence of a text: the best segment's -log E-value, the sum over significant ones, the best raw score."""
    if not len(raw):
        return [-10.0 if n_words else 0.0, 0.0, 0.0]
    bits = np.asarray(raw) - math.log(n_words) - log_k
    return [float(np.clip(bits.max(), -10, 30)), math.log1p(float(bits[bits > SIGNIFICANT].sum())),
            min(30.0, float(np.max(raw)))]


def _lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """Positive root of sum p exp(lambda s) = 1."""
    p = weights / weights.sum()
    if (p * scores).sum() >= 0 or not (scores[p > 0] > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 300))).sum()) - 1
    while f(hi) < 0:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, class, n): words and stems of every text by class."""
    counts = {-1: Counter(), 0: Counter(), 1: Counter()}

    def flush():
        for cls, c in counts.items():
            if not c:
                continue
            words, n = list(c), np.fromiter(c.values(), dtype=np.float64, count=len(c))
            for kind, size, bucket in ((0, WORD_BITS, word_bucket), (1, STEM_BITS, stem_bucket)):
                if kind and cls < 0:
                    continue
                total = np.bincount([bucket(w) for w in words], n, minlength=1 << size)
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), kind, dtype=np.int32)), pa.array(hit.astype(np.int32)),
                     pa.array(np.full(len(hit), cls, dtype=np.int32)), pa.array(total[hit].astype(np.int64))],
                    names=["kind", "bucket", "class", "n"])
            c.clear()

    for batch in batches:
        for text, cls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[cls].update(words_of(text))
        if sum(map(len, counts.values())) > _FLUSH:
            yield from flush()
    yield from flush()


def _sample(docs: DataFrame, labels: DataFrame, train_ids, max_labels: int) -> DataFrame:
    """(id, toxic, part): a bounded sample of labelled rows; part 0 is counted, 1 (a quarter) calibrates.
    An id with several labels is toxic if any of them is."""
    own = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
           .where("id is not null and toxic is not null").withColumn("doc_id", F.col("id")).where(train_ids)
           .groupBy("id").agg(F.max("toxic").alias("toxic")))
    return (own.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_labels)
            .select("id", "toxic", (F.pmod(F.shiftright("h", 7), F.lit(4)) == 0).cast("int").alias("part")))


def train(docs: DataFrame, labels: DataFrame, train_ids, max_labels: int = 30_000, drift: float = 0.7) -> ToxicModel | None:
    """Fit on ``labels.where(train_ids)``; None if a class is missing.

    ``train_ids`` is a condition on ``doc_id``.  Rows with a NULL id or label
    are not learnt from."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    sample = materialize(_sample(docs, labels, train_ids, max_labels), "labelled")
    marked = d.join(F.broadcast(sample), "id", "left")
    cls = F.when(F.col("part") == 0, F.col("toxic")).otherwise(-1)

    def of(c: int):
        return F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0))

    counts = materialize(
        marked.select("text", cls.alias("class")).mapInArrow(_count_words, "kind int, bucket int, class int, n long")
        .groupBy("kind", "bucket").agg(of(1).alias("toxic"), of(0).alias("clean"), F.sum("n").alias("every")), "counts")
    n_every = counts.where("kind = 0").agg(F.sum("every")).first()[0]
    # a bucket without labelled words scores as its stem does, so only the others are needed here
    rows = collect_bounded(counts.where("toxic + clean > 0").select(
        "kind", "bucket", *[F.col(c).cast("float") for c in ("toxic", "clean", "every")]))

    def vector(kind: int, name: str) -> np.ndarray:
        out = np.zeros(1 << (STEM_BITS if kind else WORD_BITS), dtype=np.float32)
        part = rows[rows["kind"] == kind]
        out[part["bucket"].to_numpy()] = part[name].to_numpy()
        return out

    toxic, clean, every = (vector(0, c) for c in ("toxic", "clean", "every"))
    n_t, n_c = float(toxic.sum(dtype=np.float64)), float(clean.sum(dtype=np.float64))
    if not n_t or not n_c:
        return None
    base = n_t / (n_t + n_c)
    stem_t = vector(1, "toxic")
    stem_all = stem_t + vector(1, "clean")
    stem_mass = 2 + 0.04 * float(stem_all.mean())
    stem_rate = (stem_t + stem_mass * base) / (stem_all + stem_mass)
    prior = 1 + 0.02 * every * ((n_t + n_c) / n_every)
    model = ToxicModel(toxic, toxic + clean, prior.astype(np.float32), stem_rate.astype(np.float32), base, drift)
    # background distribution of scores: words of counted texts that are not toxic
    seen = clean > 0
    rate = ((toxic + prior * base) / (toxic + clean + prior))[seen].astype(np.float64)
    s = np.log(rate / (1 - rate)) - math.log(base / (1 - base)) - drift
    model.lam = _lambda(s, clean[seen].astype(np.float64))
    shared = spark.sparkContext.broadcast(model)
    # one text an id, so that the sample bounds the rows: of several the one with the smallest hash
    calibrating = d.join(F.broadcast(sample.where("part = 1")), "id").withColumn("h", F.xxhash64("text"))
    chosen = calibrating.groupBy("id").agg(F.min("h").alias("h"))
    calibrating = calibrating.join(chosen, ["id", "h"]).dropDuplicates(["id"]).select("id", "toxic", "text")
    kind = calibrating.schema["id"].dataType.simpleString()
    held = collect_bounded(calibrating.mapInArrow(_evidence(shared), f"id {kind}, toxic int, n_words long, raw array<double>"))
    held = held[held["n_words"] > 0].copy()
    held["best"] = [max(r, default=0.0) for r in held["raw"]]
    held = held.sort_values(["id", "n_words", "best"], kind="stable")
    calm = held[held["toxic"] == 0]
    if calm.empty or len(calm) == len(held):
        return None
    # mean of a Gumbel variable: log K + Euler's constant, over lambda
    model.log_k = float(np.mean(calm["best"] - np.log(calm["n_words"])) - np.euler_gamma)
    x = [features_of(n, r, model.log_k) for n, r in zip(held["n_words"], held["raw"], strict=True)]
    model.weights = _logistic(np.array(x), held["toxic"].to_numpy())
    return model


def _evidence(shared):
    """mapInArrow function: (id, toxic, text) -> (id, toxic, n_words, raw)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.segments(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([[x[3] for x in segs] for _, segs in found], pa.list_(pa.float64()))],
                names=["id", "toxic", "n_words", "raw"])

    return run


def without_toxic(docs: DataFrame, model: ToxicModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores less than ``least``, all columns as they are; all of them without a
    model.  The same scores as :func:`score_documents`, for a filter that needs them for nothing else."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                n, found = scorer.segments(text.as_py())
                keep.append(scorer.probability(features_of(n, [x[3] for x in found], scorer.model.log_k)) < least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_udf(spark, model: ToxicModel | None):
    """Arrow UDF text -> struct(score, segments array<struct<first_word, end_word, score, e_value>>)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, segments array<struct<first_word:int,end_word:int,score:double,e_value:double>>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value) if shared.value else None
        for part in parts:
            out, spans = [], []
            for text in part:
                n, found = scorer.segments(text) if scorer else (0, [])
                log_k = scorer.model.log_k if scorer else 0.0
                out.append(scorer.probability(features_of(n, [x[3] for x in found], log_k)) if scorer else 0.0)
                floor = math.log(n) + log_k if n else 0.0
                spans.append([{"first_word": a, "end_word": b, "score": s, "e_value": math.exp(floor - raw)}
                              for a, b, s, raw in found if raw - floor > SIGNIFICANT])
            yield pd.DataFrame({"score": out, "segments": spans})

    return score


def score_documents(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, score, predicted, segments), one row per input row.

    ``segments`` lists the significant passages as word ranges.  NULL or empty
    text has no passage; without a model every score is 0.  Equal texts get
    equal scores; NULL ids and repeated rows are kept; other columns are ignored.
    """
    score = score_udf(docs.sparkSession, model)
    return (docs.select(F.col(id_col), score(F.col(text_col)).alias("__t"))
            .select(id_col, "__t.score", (F.col("__t.score") >= 0.5).cast("int").alias("predicted"), "__t.segments"))
