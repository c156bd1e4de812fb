"""License scans by diagonal voting.

Every run of ``k`` words of a text is hashed and joined to the places where the
templates have that run.  A hit at text word ``pos`` and template word ``off``
votes for the diagonal ``pos - off``: the place where the template would begin.
The votes of one diagonal are gathered, neighbouring diagonals (a word inserted
or dropped) become one span, and a span counts if enough of its template's runs
were found in it.  A diagonal on which every run voted is a place where the
template's words stand consecutively.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .decontaminate import corpus, words


class Template(NamedTuple):
    label: str
    text: str
    #: A phrase counts only where its words stand consecutively.
    phrase: bool = False


# The contract's phrases with their labels.
PHRASES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]

# The customary wording of licence notices.
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright"),
    Template("gnu-gpl", "licensed under the gnu general public license version"),
    Template("gnu-gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
]

DOC = ["doc_id", "h"]
#: Rows of the template table up to which it is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 100_000


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(template, label, phrase, t): one row per template, its words in order."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"),
                     F.lit(t.text).alias("text")) for i, t in enumerate(templates)]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.select("template", "label", "phrase", words(F.col("text")).alias("t"))


def _run(array: str, at: Column, k: int) -> list[Column]:
    return [F.get(F.col(array), at + i) for i in range(k)]


def template_runs(table: DataFrame, k: int) -> DataFrame:
    """(run, r0.., template, off): the hash, the words and the place of every run of ``k`` template words."""
    each = table.where(F.size("t") >= k).select(
        "template", "t", F.explode(F.sequence(F.lit(0), F.size("t") - k)).alias("off"))
    run = _run("t", F.col("off"), k)
    return each.select(F.xxhash64(*run).alias("run"), *[c.alias(f"r{i}") for i, c in enumerate(run)], "template", "off")


def votes(docs: DataFrame, table: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_words, pos, template, off): the hits of every run of ``k`` words of every
    text, and one row without a template for each text, in one pass over the texts."""
    runs = template_runs(table, k)
    if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    texts = corpus(docs, id_col, text_col).select(*DOC, words(F.col("text")).alias("w"))
    every = texts.select(*DOC, F.size("w").cast("long").alias("n_words"), "w",
                         F.posexplode_outer("w").alias("pos", "word"))
    here = _run("w", F.col("pos"), k)
    same = [F.col(f"r{i}") == c for i, c in enumerate(here)]
    hit = every.join(runs, [F.xxhash64(*here) == F.col("run"), *same], "left")
    return hit.where("template is not null or pos is null or pos = 0").select(
        *DOC, "n_words", "pos", "template", "off")


def spans(hits: DataFrame, table: DataFrame, k: int, gap: int = 2, min_share: float = 0.7) -> DataFrame:
    """(doc_id, h, template, label, phrase, begin, end, share, places, first, last, found): the spans
    of the ``hits`` of :func:`votes`.

    ``share`` is the part of the template's runs that voted for the span, on its best diagonal or on
    neighbouring ones (at most ``gap`` apart) that stay within twice the template's length; ``places``
    counts the diagonals on which every run voted, ``first`` and ``last`` are the smallest and largest
    of them.  A span is ``found`` if it has such a place or, for a template that is not a phrase, a share
    of ``min_share`` or more.  Of a repeated row the votes count once."""
    diagonal = (hits.where("template is not null")
                .groupBy(*DOC, "template", (F.col("pos") - F.col("off")).alias("diagonal"))
                .agg(F.collect_set("off").alias("offs")))
    known = diagonal.join(F.broadcast(table.select("template", "label", "phrase", F.size("t").alias("m"))), "template")
    known = known.withColumn("runs", F.col("m") - (k - 1)).withColumn("exact", F.size("offs") == F.col("runs"))
    along = Window.partitionBy(*DOC, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("phrase"), 0).otherwise(gap),
                       F.lit(False))
    part = known.withColumn("apart", apart.cast("int")).withColumn("part", F.sum("apart").over(along))
    place = F.when(F.col("exact"), F.col("diagonal"))
    one = part.groupBy(*DOC, "template", "label", "phrase", "m", "runs", "part").agg(
        F.min(F.col("diagonal") + F.array_min("offs")).alias("begin"),
        F.max(F.col("diagonal") + F.array_max("offs") + k).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("offs")))).alias("merged"),
        F.max(F.size("offs")).alias("best"), F.count_if("exact").alias("places"),
        F.min(place).alias("first"), F.max(place).alias("last"))
    fits = (F.col("end") - F.col("begin")) <= 2 * F.col("m")
    share = F.when(fits & ~F.col("phrase"), F.col("merged")).otherwise(F.col("best")) / F.col("runs")
    found = (F.col("places") > 0) | (~F.col("phrase") & (F.col("share") >= min_share))
    return one.withColumn("share", share.cast("double")).select(
        *DOC, "template", "label", "phrase", "begin", "end", "share", "places", "first", "last", found.alias("found"))


def scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), k: int = 2, gap: int = 2,
         min_share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, h, n_words) and their spans.

    A text is a distinct pair of id and text, ``h`` the text's hash; repeated rows give one, a NULL id
    is an id like others.  NULL or empty text has no words and no spans; other columns are ignored; an
    empty table gives empty ones.  ``k`` must not exceed the words of the shortest template, which
    would never be found."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    hits = materialize(votes(docs, table, k, id_col, text_col), "votes")
    texts = hits.groupBy(*DOC).agg(F.max("n_words").alias("n_words"))
    return texts, spans(hits, table, k, gap, min_share)


def license_scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), k: int = 2, gap: int = 2,
                 min_share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per text of
    :func:`scan`.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are the smallest and
    largest of them (NULL without any); labels are distinct, sorted and comma-joined, ``score`` is the
    largest share of a span, found or not, and 0 without any."""
    texts, found = scan(docs, templates, k, gap, min_share, id_col, text_col)
    base = F.col("phrase") & (F.col("places") > 0)
    none = F.lit(None)
    long, labels = none.cast("long"), none.cast("array<string>")
    per_doc = found.groupBy(*DOC).agg(
        F.sum(F.when(base, F.col("places"))).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_set"),
        F.collect_set(F.when(F.col("found"), F.col("label"))).alias("set"), F.max("share").alias("score"))
    rows = (texts.select(*DOC, "n_words", long.alias("n_base"), long.alias("first_word"), long.alias("last_word"),
                         labels.alias("base_set"), labels.alias("set"), none.cast("double").alias("score"))
            .unionByName(per_doc.withColumn("n_words", long)))
    both = rows.groupBy(*DOC).agg(*[F.max(c).alias(c) for c in (
        "n_words", "n_base", "first_word", "last_word", "base_set", "set", "score")])

    def joined(name: str) -> Column:
        return F.array_join(F.array_sort(F.coalesce(name, F.array().cast("array<string>"))), ",")

    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word",
                       "last_word", joined("base_set").alias("base_labels"), joined("set").alias("labels"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))
