"""A training corpus from ``documents``: five stages, each on all that its predecessor kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import decontaminate, jaccard_join, packing, substring, toxicity
from patronage.llm.common import bounded_batches, keyed, load, materialize
from patronage.session import scope


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of a ``keyed`` table whose key is not in ``keys`` (rows without a key stay)."""
    gone = materialize(keys.select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct(), name)
    if gone.limit(1_000_001).count() <= 1_000_000:  # 8 bytes a row; beyond it the join shuffles
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("__key") == F.col("__gone"), "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text the segment search predicts as toxic; learnt from all labels.  Each row is
    judged by its own text: NULL and empty texts are not toxic, repeated rows and rows that share an id stand or
    fall by themselves, and without labels of both classes none goes."""
    all_docs = load(spark, sf_dir, "documents")
    model = toxicity.train(all_docs, load(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component at Jaccard 0.8 on 5-word shingles, keep the document with the smallest id.

    A document is an id and a text: of the texts that share an id only the copies go.  Rows equal in both
    give one; NULL and empty texts are no copies of each other; rows with a NULL id cannot be named and stay."""
    rows = keyed(docs)
    found = materialize(jaccard_join.jaccard_components(rows, k=5, num=80, den=100, id_col="__key"), "components")
    kept = _without(rows, found.where("doc_id <> component_id"), "copies")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = kept.where("__key is not null").dropDuplicates(["__key"])
        kept = named.union(kept.where("__key is null"))
    return kept.select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that an earlier document has, from the text that has them alone.
    NULL, empty and short texts and rows with a NULL id stay as they are; a text of which nothing is left goes."""
    return substring.cut_repeats(docs, substring.passages(docs, min_words=50))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents (id and text) that hold 10 consecutive words of a benchmark item.  NULL and empty
    texts hold none; rows with a NULL id cannot be named and stay; without items none goes."""
    rows = keyed(docs)
    found = decontaminate.contamination(rows, load(spark, sf_dir, "benchmark"), n=10, id_col="__key")
    return _without(rows, found.where("contaminated"), "contaminated").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece; every row is a document of its own, NULL and empty
    texts give the end id alone."""
    return packing.pack(docs, capacity=2048)


def _stage(function):
    """A stage whose texts reach the Python workers in batches of bounded size."""
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return function(spark, docs, sf_dir)
    return run


STAGES = [("toxicity", _stage(toxic)), ("near_duplicates", _stage(near_duplicates)),
          ("substring_dedup", _stage(repeated_passages)), ("decontamination", _stage(contaminated)),
          ("packing", _stage(packed))]

#: Model scores, shingle components and tokenizers are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read again, and its intermediate
    tables are deleted then."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
