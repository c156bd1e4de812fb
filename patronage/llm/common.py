"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.ordering import global_row_number
from patronage.session import materialize

__all__ = ["bounded_batches", "collect_bounded", "components", "crc_mod", "keep_ids", "keyed", "load", "materialize", "word_hashes", "mix64",
           "ALNUM_SEPARATORS", "SPACE_SEPARATORS"]

#: Most rows of an id table that are broadcast (8 bytes each); beyond it the
#: same join shuffles.
BROADCAST_ROWS = 1_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let this session send at most about ``limit`` bytes (and one more row) to a Python worker at a time.
    Rows are whole texts here, so a batch counted in rows has no useful bound."""
    held = spark.conf.get(_BATCH)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > limit:
        spark.conf.set(_BATCH, str(limit))


def collect_bounded(df: DataFrame):
    """A table of bounded size as pandas, sent as Arrow whatever the session's settings."""
    return df.toArrow().to_pandas()


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n (NULL for a NULL id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def keep_ids(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the materialised, distinct table
    ``ids``.  The table is counted first: up to ``bound`` rows it is broadcast,
    beyond it both sides are shuffled."""
    ids = ids.select(key)
    if ids.limit(bound + 1).count() <= bound:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "__key") -> DataFrame:
    """``docs`` with a key that names a row's id and text: the id itself, or, for all but one of the texts
    that share an id, a number above all ids.  NULL for a NULL id; the same in every call on the same rows.

    Ids of several texts are looked for among (id, hash) pairs; where there are none, no text moves."""
    number = F.col(id_col).cast("long")
    pairs = docs.select(number.alias("id"), F.xxhash64(text_col).alias("h")).where("id is not null")
    several = materialize(pairs.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most"))
                          .where("least <> most"), "shared-ids")
    if several.isEmpty():
        return docs.withColumn(key, number)
    top = pairs.agg(F.max("id")).first()[0]
    others = pairs.join(several, "id").where("h <> least").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    others = global_row_number(others, ["__id", "__h"], "__rank")
    same = (number == F.col("__id")) & (F.xxhash64(text_col) == F.col("__h"))
    return (docs.join(others, same, "left").withColumn(key, F.coalesce(F.col("__rank") + F.lit(top), number))
            .drop("__id", "__h", "__rank"))


# -- word hashing ---------------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(is_separator) -> bytes:
    """Byte translation: separators become blanks, A-Z lower case."""
    return bytes(32 if is_separator(b) else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Words are runs of bytes other than space and \x09-\x0D.
SPACE_SEPARATORS = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and all non-ASCII characters.
ALNUM_SEPARATORS = _table(lambda b: b < 0x80 and not chr(b).isalnum())


_BASE = 0x9E3779B97F4A7C15
_tables = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    global _tables
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        _tables = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, dtype=_U)]))
                   for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables


def _blocks(data: bytes, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, bytes) of blocks of about ``size`` bytes, cut at blanks, so that a very
    long text needs no more temporary memory than a block."""
    at = 0
    while len(data) - at > size and (cut := data.find(b" ", at + size)) >= 0:
        yield at, np.frombuffer(data, dtype=np.uint8, count=cut - at, offset=at)
        at = cut
    yield at, np.frombuffer(data, dtype=np.uint8, offset=at)


def word_hashes(text: str, table: bytes, with_offsets: bool = False, size: int = 1 << 18):
    """64-bit hashes of the words of a whole text; with ``with_offsets`` also each
    word's first and end byte."""
    data = text.encode("utf-8", "surrogatepass").translate(table)
    hashes, begins, ends = [], [], []
    for at, part in _blocks(data, size):
        inside = np.zeros(len(part) + 2, dtype=bool)
        np.not_equal(part, 32, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edge[0::2], edge[1::2]
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum((part.astype(_U) + _U(1)) * power[:len(part)], out=total[1:])
        hashes.append(mix64((total[end] - total[first]) * inverse[first] + (end - first).astype(_U)))
        if with_offsets:
            begins.append(first + at)
            ends.append(end + at)
    out = hashes[0] if len(hashes) == 1 else np.concatenate(hashes)
    return (out, np.concatenate(begins), np.concatenate(ends)) if with_offsets else out


_ROW = [_U(0x8CB92BA72F3D8DD7), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9),
        _U(0xD6E8FEB86659FD93)]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; a shorter, non-empty sequence gives one."""
    n = len(words)
    if n == 0:
        return words
    k_used = min(n, k)
    acc = np.full(n - k_used + 1, k_used, dtype=_U) * _ROW[3]
    for i in range(k_used):
        acc = acc * _ROW[i % 3] + words[i:n - k_used + 1 + i]
        acc ^= acc >> _U(29)
    return mix64(acc)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by prefix sums; none in a shorter sequence."""
    if len(words) < n:
        return np.zeros(0, _U)
    power, inverse = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * power[:len(words)], out=total[1:])
    return mix64((total[n:] - total[:-n]) * inverse[:len(words) - n + 1])


# -- connected components -------------------------------------------------

def components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, comp) for the nodes of ``edges(a, b)``; comp is the smallest node
    of the component.

    Each round every component hooks to its smallest neighbour, pointers are
    followed ``jumps`` times (a chain shrinks by 2**jumps) and the edges are
    contracted; every table is one row per node or edge and is written, so a
    lost executor costs its own tasks only."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    nodes = materialize(nodes.select("node", F.col("node").alias("comp")), "nodes")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        parent = materialize(parent, "parent")
        for _ in range(jumps):
            above = parent.select(F.col("a").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        parent = materialize(parent, "parent")
        nodes = materialize(
            nodes.join(parent.select(F.col("a").alias("comp"), "up"), "comp", "left")
            .select("node", F.coalesce("up", "comp").alias("comp")), "nodes")
        to_a = parent.select("a", F.col("up").alias("ua"))
        to_b = parent.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        edges = materialize(
            edges.join(to_a, "a").join(to_b, "b").where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    return nodes
