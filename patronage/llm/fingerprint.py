"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 phrases: each is the shortest string not yet in the
text's dictionary, which it joins.  The set of phrases of at least two
characters is hashed, and ``SIZE`` minimum hashes form the fingerprint.  The
share of equal minima estimates the Jaccard similarity of the phrase sets, a
similarity like that of compressing one text with the other's dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, mix64

SIZE = 64
_EMPTY = np.full(SIZE, 0xFFFFFFFF, dtype=np.uint32)
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32)


def lz78(text: str, known: set[str] | None = None) -> tuple[list[str], list[int]]:
    """(phrases, their ends) of a whole text.

    Phrases in ``known`` count as seen already; the parse adds its own to it.  Dictionaries are closed under
    prefixes, so the longest known phrase is found by stepping from the length
    of the last one."""
    seen = set() if known is None else known
    phrases: list[str] = []
    ends: list[int] = []
    add, push, end = seen.add, phrases.append, ends.append
    i, n, step = 0, len(text), 1
    while i < n:
        j = i + step
        s = text[i:j]
        if s in seen:
            j = min(j, n)
            while s in seen and j < n:
                j += 1
                s = text[i:j]
            if s in seen:  # the text ends inside a known phrase
                push(s)
                end(n)
                break
        else:
            j = min(j, n)
            s = text[i:j]
            while j - i > 1:
                t = text[i:j - 1]
                if t in seen:
                    break
                j -= 1
                s = t
        add(s)
        push(s)
        end(j)
        step = j - i - 1 or 1
        i = j
    return phrases, ends


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def phrase_hashes(cp: np.ndarray, ends: np.ndarray, size: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hashes, lengths) of the phrases of a parsed text, given its code points and their
    ends, in blocks of about ``size`` code points."""
    i = at = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, at + size, side="right")))
        part = cp[at:ends[j - 1]].astype(np.uint64) + np.uint64(1)
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[:len(part)], out=total[1:])
        end = ends[i:j] - at
        start = np.concatenate([[0], end[:-1]])
        lens = end - start
        yield mix64((total[end] - total[start]) * inverse[start] + lens.astype(np.uint64)), lens
        i, at = j, int(ends[j - 1])


def _least(h: np.ndarray, out: np.ndarray, block: int = 4096) -> None:
    """Lower ``out`` to the minimum hashes of the phrases."""
    h = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), block):
        np.minimum(out, (h[at:at + block, None] * _A + _B).min(axis=0), out=out)


def minima(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum hashes of the phrases of two or more characters, and of the single characters."""
    longer, single = _EMPTY.copy(), _EMPTY.copy()
    for h, lens in phrase_hashes(cp, ends):
        _least(h[lens > 1], longer)
        _least(h[lens == 1], single)
    return longer, single


def _signature(longer: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Single characters count only if there is nothing else."""
    return single if (longer == _EMPTY).all() else longer


def signature(phrases: list[str]) -> np.ndarray:
    """Fingerprint of a set of phrases."""
    ends = np.cumsum(np.fromiter(map(len, phrases), dtype=np.int64, count=len(phrases)))
    return _signature(*minima(code_points("".join(phrases)), ends))


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima; two empty texts are alike, an empty and another text are not."""
    return float((a == b).mean())


class Parsed:
    """A text's fingerprint, with its parse up to ``keep`` kept apart, so that a
    changed ending is parsed from there on."""

    def __init__(self, text: str, keep: int):
        self.text, self.keep = text, keep
        phrases, found = lz78(text)
        ends = np.array(found, dtype=np.int64)
        upto = int(np.searchsorted(ends, keep, side="right"))
        if upto and upto == len(phrases) and phrases[-1] in phrases[:-1]:
            upto -= 1  # the last phrase ended with the text, not by being new
        self.head, self.at = phrases[:upto], found[upto - 1] if upto else 0
        cp = code_points(text)
        self.head_minima = minima(cp[:self.at], ends[:upto])
        self.sig = self._with(minima(cp[self.at:], ends[upto:] - self.at))

    def _with(self, tail: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return _signature(*(np.minimum(a, b) for a, b in zip(self.head_minima, tail, strict=True)))

    def with_ending(self, ending: str) -> np.ndarray:
        """Fingerprint of ``text[:keep] + ending``, equal to one from scratch."""
        tail = self.text[self.at:self.keep] + ending
        _, ends = lz78(tail, set(self.head))
        return self._with(minima(code_points(tail), np.array(ends, dtype=np.int64)))


# -- over a table ---------------------------------------------------------

def _sha(text: str) -> str:
    from hashlib import sha256
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and place; a bucket ends with a copy of the next bucket's first row."""
    before = None

    def row(now, nxt) -> tuple:
        (doc_id, text, p), (_, next_text, q) = now, nxt
        third = len(text) // 3
        ending = next_text[:third]
        edited = p.with_ending(ending)
        return (doc_id, len(text), _sha(text[:p.keep] + ending), to_hex(p.sig), to_hex(edited),
                likeness(p.sig, edited), likeness(p.sig, q.sig))

    for batch in batches:
        rows = []
        for bucket, doc_id, text, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            now = (doc_id, text, Parsed(text, len(text) - len(text) // 3))
            if before is not None and before[0] == bucket:
                rows.append(row(before[1], now))
            before = None if copy else (bucket, now)
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
                                         names=[c.split()[0] for c in _OUT.split(", ")])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), one row per input row; NULL text counts as empty."""

    @F.pandas_udf("string")
    def finger(part):
        return part.map(lambda t: to_hex(signature(lz78(t or "")[0])))

    return docs.select(F.col(id_col), finger(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, rows_per_bucket: int = 2000, max_buckets: int = 4096,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of the text with its last third replaced by the start of
    the next document (descending id; the first follows the last), and their likeness.

    Ids are cut at approximate quantiles into buckets of about ``rows_per_bucket`` rows, ``max_buckets`` at
    most (a larger bucket is sorted on disk and streamed); each text is shuffled once, to its bucket, and the
    first row of each bucket also to the bucket before.  NULL text counts as empty; rows with a NULL id come after all others;
    rows of equal id are ordered by their text's hash; a sole row follows itself; an empty
    table gives none; other columns are ignored."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    low = F.lit(-(1 << 63))
    ids = d.select(F.coalesce("doc_id", low).alias("k"))
    n = ids.count()
    parts = min(max_buckets, max(1, round(n / rows_per_bucket)))
    cuts = sorted(set(ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    # bucket 0 has the largest ids
    key = F.coalesce("doc_id", low)
    bucket = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>"),
                                                lambda c: c <= key)) if cuts else F.lit(0)
    d = d.withColumn("bucket", bucket.cast("int")).withColumn("k", key)
    heads = d.groupBy("bucket").agg(F.max("k").alias("k")).collect()  # one row a bucket
    order = sorted(r["bucket"] for r in heads)
    first = {r["bucket"]: r["k"] for r in heads}
    if not order:
        return docs.sparkSession.createDataFrame([], _OUT)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    at = docs.sparkSession.createDataFrame([(b, first[b], before[b]) for b in order], "bucket int, k long, to int")
    # rows of equal id as the first: the one with the smallest hash leads
    lead = (d.join(F.broadcast(at), ["bucket", "k"]).withColumn("h", F.xxhash64("text"))
            .groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), F.struct("h")).alias("r")))
    own = d.select("bucket", "doc_id", "text", F.lit(False).alias("copy"))
    sent = lead.select(F.col("to").alias("bucket"), "r.doc_id", "r.text", F.lit(True).alias("copy"))
    return (own.union(sent).repartition(max(len(order), 1), "bucket")
            .sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
            .mapInArrow(_compare, _OUT))
