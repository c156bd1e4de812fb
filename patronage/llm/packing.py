"""Harmonic packing of token sequences.

Class k of capacity C holds pieces of more than C/(k+1) and at most C/k tokens;
a bin of class k takes exactly k of them.  A document is cut into full
sequences and a rest.  A rest that fills its share C/k of a bin but for a
``slack`` of it goes to class k as it is; a shorter one gives a piece of
exactly C/(k+1) tokens to class k+1 and is treated again (a rest in class k
leaves one in class k(k+1) or beyond, so there are few cuts).

Every task numbers its own pieces of a class; adding the number of pieces in
earlier tasks (one row per task and class) gives each piece its bin and place
without moving documents.  At most k - 1 pieces of each class, so a number that
depends on C alone, do not fill a bin: they are packed first-fit decreasing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

END_ID = 1


def tiktoken_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of the byte_bpe_50k vocabulary, as the .json file's library gives them.

    The ranks file holds the same vocabulary and gives the same ids (see tests),
    several times faster; special strings in a text become their id in both.  Its
    splitting pattern tracks back over runs of white space and gives up on very long
    ones, so texts with a run of ``RUN`` white-space characters, and any text on which it gives up,
    go through the .json library."""

    RUN = 100_000

    def __init__(self, path: str, special: dict[str, int]):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=special)

        self.long_run = re.compile(r"\s{%d}" % self.RUN)
        self.library = None

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < self.RUN or not self.long_run.search(text):
            try:
                return self.encoding.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the pattern gave up
                pass
        if self.library is None:
            import public_tokenizers
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, capacity: int, slack: float = 1 / 128, least: int = 32) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces, in order; full sequences are class 1."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if rest >= share * (1 - slack) or rest <= least:
            pieces.append((rest, k))
            break
        size = capacity // (k + 1)
        pieces.append((size, k + 1))
        rest -= size
    return pieces


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length."""
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((b for b, u in enumerate(used) if u + lengths[i] <= capacity), len(used))
        if b == len(used):
            used.append(0)
        out[i] = (b, used[b])
        used[b] += lengths[i]
    return out


_PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, "
          "nth long, ids array<int>")


def _pieces(path: str, special: dict[str, int], end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        encode = Encoder(path, special)
        seen = np.zeros(capacity + 2, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), end_id).astype("<u4")
                at = 0
                for length, k in cut(len(ids), capacity):
                    part = ids[at:at + length]
                    rows.append((doc_id, at, length, crc32(part.tobytes()), len(ids), k, task, int(seen[k]),
                                 part.astype(np.int32) if with_ids else None))
                    seen[k] += 1
                    at += length
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
                                                    "task", "nth", "ids"])
    return run


def _pack_rest(capacity: int):
    def run(rows):
        rows = rows.sort_values(["length", "class", "nth", "task"], ascending=[False, True, True, True], kind="stable")
        at = first_fit_decreasing(rows["length"].tolist(), capacity)
        rows["bin"] = [b for b, _ in at]
        rows["offset"] = [o for _, o in at]
        return rows[["class", "task", "nth", "bin", "offset"]]
    return run


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, special: dict[str, int] | None = None,
         end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    NULL and empty texts are documents of the end id alone.  Rows with a NULL or
    repeated id are documents of their own.  Every id of every document lies in
    exactly one piece; other columns are ignored; an empty table gives none."""
    special = {"<|endoftext|>": 50256} if special is None else special
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = d.mapInArrow(_pieces(path or tiktoken_path(), special, end_id, capacity, with_ids), _PIECE)
    pieces = materialize(made if with_ids else made.drop("ids"), "pieces")

    per_task = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = (per_task
              .withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n"))
              .withColumn("total", F.sum("n").over(Window.partitionBy("class"))))
    # bins of the classes are numbered one class after another; at most `capacity` rows
    bins = per_task.groupBy("class").agg(F.expr("sum(n) div class").alias("bins"))
    first_bin = bins.withColumn("first_bin", F.coalesce(
        F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = bins.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("v")).scalar()
    offsets = materialize(before.join(first_bin, "class").select("class", "task", "before", "total", "first_bin"),
                          "offsets")
    placed = (pieces.join(offsets, ["class", "task"])
              .withColumn("g", F.col("before") + F.col("nth"))
              .withColumn("full", F.expr("g < total div class * class")))
    out = [c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    tail = ["ids"] if with_ids else []
    # a piece of class k starts at its place times the largest length of the class, made gapless below
    slot = Window.partitionBy("sequence_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    full = (placed.where("full").withColumn("sequence_id", F.expr("first_bin + g div class"))
            .withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0))))
    rest = placed.where("not full").withColumn("one", F.lit(0))
    spots = rest.groupBy("one").applyInPandas(_pack_rest(capacity), "class int, task int, nth long, bin long, offset long")
    tail_rows = (rest.join(spots, ["class", "task", "nth"])
                 .withColumn("sequence_id", F.col("bin") + last))
    cols = [*out, "sequence_id", "offset", *tail]
    return full.select(cols).union(tail_rows.select(cols))
