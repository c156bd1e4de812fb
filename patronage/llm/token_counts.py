"""Token counts by a public byte-pair vocabulary.

Whole texts are encoded in an Arrow UDF that returns lengths only.  Each Arrow
batch is dealt anew into encoding batches of about ``batch_bytes`` bytes; a
longer text is cut where a non-space character meets a space.  The vocabulary's
word pattern lets white space only begin a word there, and special strings hold
no space, so the pieces' counts add up to the text's.  For the same reason a
piece is the sum of its words, cut at every such place: the library encodes each
distinct word, and its count is remembered while the task has room for it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SAFE = re.compile(r"[!-~](?= )")
_CUT = re.compile(r"(?<=[!-~])(?= )")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def safe_pieces(text: str, max_chars: int) -> list[str]:
    """Cut a text at safe boundaries into pieces of at least ``max_chars``
    characters (a stretch without any boundary stays whole)."""
    pieces, at = [], 0
    while len(text) - at > max_chars:
        hit = _SAFE.search(text, at + max_chars - 1)
        if hit is None:
            break
        pieces.append(text[at:hit.end()])
        at = hit.end()
    pieces.append(text[at:])
    return pieces


def balanced_batches(texts, batch_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, pieces) whose sizes sum to about ``batch_bytes``."""
    rows, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for piece in safe_pieces(text, batch_bytes):
            rows.append(i)
            pieces.append(piece)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= batch_bytes:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if rows:
        yield rows, pieces


#: About the bytes that remembered counts take in a task, and those of one word beside its characters.
HELD_BYTES = 64 << 20
_WORD_BYTES = 160


class WordCounts:
    """Numbers of tokens of texts, by a library's batch encoding of their distinct words."""

    def __init__(self, encode_batch, held_bytes: int = HELD_BYTES):
        self.encode_batch, self.held_bytes = encode_batch, held_bytes
        self.known: dict[str, int] = {}
        self.held = 0

    def __call__(self, pieces: list[str]) -> list[int]:
        if self.held > self.held_bytes:
            self.known, self.held = {}, 0
        words = [_CUT.split(piece) for piece in pieces]
        new = list(set().union(*words).difference(self.known))
        self.known.update(zip(new, map(len, self.encode_batch(new)), strict=True))
        self.held += sum(map(len, new)) + _WORD_BYTES * len(new)
        return [sum(map(self.known.__getitem__, w)) for w in words]


def count_udf(path: str, batch_bytes: int = 1 << 19):
    """Arrow UDF text -> number of tokens (NULL text counts as empty)."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task uses its own core only
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        counts = WordCounts(lambda words: tokenizer.encode_batch_fast(words, add_special_tokens=False))
        for part in parts:
            out = np.zeros(len(part), dtype=np.int64)
            for rows, pieces in balanced_batches(part.array, batch_bytes):
                np.add.at(out, rows, counts(pieces))
            yield pd.Series(out)

    return count


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", batch_bytes: int = 1 << 19) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row.

    NULL or empty text: 0 bytes, 0 tokens.  NULL ids and repeated rows are kept
    as they are; other columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = count_udf(path or vocabulary_path(), batch_bytes)
    return (docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                        count(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
