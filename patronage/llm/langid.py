"""Language identification with a string kernel.

A text is the set of its letter n-grams of 1 to ``n_max`` code points (lower
case, every other character one blank), hashed to ``2**bits`` positions.  The
kernel of two texts is the size of the intersection over the geometric mean of
the sizes.  A Nystroem map built on landmark texts feeds a one-versus-rest
kernel ridge regression; a batch of texts is scored with two matrix products:
presence x landmarks, kernel x weights.

Bounds: training uses at most ``per_lang`` texts of a language and ``max_train``
in all (smallest hashes of the id), of which at most ``landmarks`` are
landmarks.  A training text reaches the driver as 2**bits / 8 bytes, whatever
its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_bounded, mix64

BITS, N_MAX, BLOCK = 14, 3, 1 << 18
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)),
                               dtype=bool, count=0x110000)
    return _letters


def mark_ngrams(text: str, row: np.ndarray, bits: int = BITS, n_max: int = N_MAX) -> bool:
    """Set in ``row`` the positions of the text's n-grams; false if the text has
    no letter.  Blocks overlap by n_max - 1 characters, so memory is bounded."""
    letters, any_letter = _letter_table(), False
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - n_max + 1):at + BLOCK].lower()
        cp = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32)
        is_letter = letters[cp]
        if not is_letter.any():
            continue
        any_letter = True
        cp = np.where(is_letter, cp, 32).astype(np.uint64)
        cp = np.concatenate([[np.uint64(32)], cp, [np.uint64(32)]])
        blank = cp == 32
        cp = cp[~(blank & np.concatenate([[False], blank[:-1]]))]
        h = np.zeros(len(cp), dtype=np.uint64)
        for n in range(1, n_max + 1):
            if len(cp) < n:
                break
            h = h[:len(cp) - n + 1] * np.uint64(0x100000001B3) + cp[n - 1:]
            row[(mix64(h + np.uint64(n << 56)) >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return any_letter


@dataclass
class LanguageModel:
    """Landmark rows (scaled by their size), regression weights and names."""
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        return presence @ self.landmarks.T / size

    def scores(self, presence: np.ndarray) -> np.ndarray:
        return self.kernel(presence) @ self.weights + self.bias


def fit(presence: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    """Nystroem map on evenly dealt landmarks, then ridge regression on +-1."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    nth = np.zeros(len(y), dtype=np.int64)
    for c in range(len(names)):
        nth[y == c] = np.arange((y == c).sum())
    chosen = np.lexsort((y, nth))[:landmarks]
    rows = presence[chosen].astype(np.float32)
    model = LanguageModel(names, rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)), np.zeros(0), np.zeros(0))
    k_mm = model.kernel(rows).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = model.kernel(presence.astype(np.float32)).astype(np.float64) @ whiten
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    n_c = np.bincount(y, minlength=len(names))
    weight = (len(y) / (len(names) * n_c))[y][:, None]
    penalty = ridge * np.eye(phi1.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(phi1.T @ (weight * phi1) / len(y) + penalty / len(names), phi1.T @ (weight * target) / len(y))
    model.weights = (whiten @ beta[:-1]).astype(np.float32)
    model.bias = beta[-1].astype(np.float32)
    return model


def train(docs: DataFrame, train_rows, per_lang: int = 600, max_train: int = 6000, landmarks: int = 256,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on the bounded sample of ``docs.where(train_rows)``; None without any
    usable row (NULL lang, NULL text or no letter)."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                    train_rows.alias("use"))
    labelled = d.where("use and lang is not null and text is not null and id is not null")
    ranked = labelled.select("id", "lang", F.xxhash64("id").alias("h")).withColumn(
        "rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
    sample = ranked.where(F.col("rn") <= per_lang).orderBy("rn", "lang").limit(max_train).select("id").distinct()

    @F.pandas_udf("binary")
    def packed(part: pd.Series) -> pd.Series:
        out = []
        for text in part:
            row = np.zeros(1 << BITS, dtype=np.uint8)
            out.append(np.packbits(row).tobytes() if mark_ngrams(text, row) else None)
        return pd.Series(out, dtype=object)

    rows = collect_bounded(
        labelled.join(F.broadcast(sample), "id").select("id", "lang", packed("text").alias("bits"))
        .where("bits is not null").orderBy("id", "lang", "bits").limit(2 * max_train))
    if rows.empty:
        return None
    order = np.argsort(pd.util.hash_array(rows["id"].to_numpy()), kind="stable")
    presence = np.stack([np.unpackbits(np.frombuffer(b, dtype=np.uint8)) for b in rows["bits"].iloc[order]])
    return fit(presence, list(rows["lang"].iloc[order]), landmarks)


def predict_udf(spark, model: LanguageModel | None, batch: int = 128):
    """Arrow UDF text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        rows = np.zeros((batch, 1 << BITS), dtype=np.float32)
        for part in parts:
            names = np.full(len(part), "und", dtype=object)
            score = np.zeros(len(part))
            texts = part.array
            for at in range(0, len(texts) if m else 0, batch):
                chunk = texts[at:at + batch]
                rows[:] = 0
                known = np.array([isinstance(t, str) and mark_ngrams(t, rows[i]) for i, t in enumerate(chunk)])
                s = m.scores(rows[:len(chunk)])
                best = s.argmax(axis=1)
                top = np.clip((s[np.arange(len(chunk)), best] + 1) / 2, 0, 1)
                names[at:at + len(chunk)] = np.where(known, np.array(m.languages, dtype=object)[best], "und")
                score[at:at + len(chunk)] = np.where(known, top, 0)
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return predict


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per input row.  NULL text, text without a
    letter, or no model: ``und`` with score 0.  Equal texts get equal answers;
    NULL ids and repeated rows are kept; other columns are ignored."""
    predict = predict_udf(docs.sparkSession, model)
    return (docs.select(F.col(id_col), predict(F.col(text_col)).alias("__p"))
            .select(id_col, "__p.lang_pred", "__p.score"))
