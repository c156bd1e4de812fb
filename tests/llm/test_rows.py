"""Decisions by row (id and text), inexact passages, and inputs that once ended a job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import decontaminate, packing, substring, toxicity
from patronage.llm.common import keyed
from patronage.llm.queries import ORACLE

RNG = random.Random(23)


def prose(n, tag):
    return " ".join(f"{tag}{RNG.randint(0, 10 ** 6)}" for _ in range(n))


def test_keys_name_id_and_text(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "c"), (None, "d"), (3, None), (3, ""), (4, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in keyed(df).collect():
        got.setdefault((r["doc_id"], r["text"]), set()).add(r["__key"])
    assert all(len(k) == 1 for k in got.values()) and got[None, "d"] == {None}
    keys = [k for k, in got.values() if k is not None]
    assert len(set(keys)) == len(keys) == 6
    assert got[2, "c"] == {2} and got[4, "a"] == {4} and {1, 3} <= set(keys)
    assert sorted(keyed(df).collect(), key=str) == sorted(keyed(df.repartition(5)).collect(), key=str)


def test_only_the_text_that_repeats_is_cut(spark):
    """One id has a copied passage in one text and clean words in another."""
    passage, clean = prose(63, "p"), prose(80, "c")
    texts = [(1, passage), (2, prose(20, "x") + " " + passage), (2, clean), (2, prose(9, "y"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = substring.passages(docs)
    assert {(r["doc_id"], r["partner_id"]) for r in found.collect()} <= {(2, 1), (1, 2)} and found.count() == 1
    kept = [(r["doc_id"], len(r["text"].split())) for r in substring.cut_repeats(docs, found).collect()]
    assert (2, 80) in kept and (2, 9) in kept
    assert sorted(kept) in ([(1, 63), (2, 9), (2, 20), (2, 80)], [(2, 9), (2, 80), (2, 83)])


def test_clean_text_of_a_shared_id_survives_the_pipeline(spark, tmp_path):
    import corpus_pipeline as p
    base, passage, leak = prose(120, "b"), prose(60, "p"), "the quick brown fox jumps over a lazy dog near the bank"
    clean = prose(90, "c")
    texts = [(1, base), (7, base), (7, clean), (7, prose(30, "x") + " " + passage), (2, passage + " " + prose(30, "y")),
             (7, prose(15, "z") + " " + leak), (7, clean), (None, base)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts],
                              "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = d
    for i, (_, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, out, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
    rows = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(r["text"].split())) for r in out.collect())
    # 7 keeps its clean text once, whole, and the text whose passage goes; its copy and its leak go; a NULL id stays
    assert (7, 90) in rows and rows.count((7, 90)) == 1
    assert rows == sorted([(-1, 120), (1, 120), (2, 90), (7, 90), (7, 30)]) or rows == sorted([(-1, 120), (1, 120), (2, 30), (7, 90), (7, 90)])
    with_pack = p.STAGES[-1][1](spark, out, str(tmp_path))
    assert with_pack.select("doc_id").distinct().count() == 4


def test_empty_tables_go_through_every_stage(spark, tmp_path):
    import corpus_pipeline as p
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_partly_quoted_passages_meet_their_whole(spark):
    """Documents hold words 0-34, 25-59, all 60, 0-34, 25-59, and all 60 with one word changed."""
    texts, want = {}, {}
    for t in range(20):
        rng, base = random.Random(t), 100 * t
        words = [f"p{t}x{i}" for i in range(60)]
        changed = list(words)
        changed[rng.randrange(60)] = f"changed{t}"
        for i, part in enumerate([words[:35], words[25:], words, words[:35], words[25:], changed], 1):
            a, b = ([f"f{base + i}{side}{j}" for j in range(rng.randint(5, 40))] for side in "ab")
            texts[base + i] = " ".join([*a, *part, *b])
        want[base + 6] = base + 3
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["partner_id"]) for r in substring.passages(frame).collect() if r["end_word"] - r["start_word"] >= 50}
    assert len(got & set(want.items())) >= 18


@pytest.mark.parametrize("identity,least", [(0.95, 0.95), (0.9, 0.85)])
def test_inexact_passages(spark, identity, least):
    """Planted passages of 100 words with random words replaced; what is found lies on what was planted."""
    texts, want = {}, {}
    for t in range(60):
        rng = random.Random(1000 * t + int(100 * identity))
        words = [f"q{t}x{i}" for i in range(100)]
        other = list(words)
        for i in rng.sample(range(100), round(100 * (1 - identity))):
            other[i] = f"r{t}y{i}"
        a, b = ([f"g{t}{s}{j}" for j in range(20)] for s in "ab")
        texts[2 * t], texts[2 * t + 1] = " ".join([*a, *words]), " ".join([*other, *b])
        want[2 * t + 1] = 2 * t
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [r for r in substring.passages(frame).collect()]
    assert all(want.get(r["doc_id"]) == r["partner_id"] and r["end_word"] <= 100 and 0.8 <= r["identity"] <= 1 for r in got)
    assert len({r["doc_id"] for r in got}) >= least * len(want)


def test_chains_and_ends_of_batches_equal_those_of_rows():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        x = np.cumsum(rng.integers(1, 45, n))
        y = x + int(rng.integers(0, 50))
        cols = substring.plain_chains(np.full(n, 3), np.full(n, 2), x, y, np.arange(n) == 0)
        want = []
        for c in substring.chains(x, y):
            covered, gaps = substring.gaps_of(x[c], y[c])
            want.append((3, 2, int(x[c[0]]), int(x[c[-1]]) + substring.K, int(y[c[0]]), int(y[c[-1]]) + substring.K, covered,
                         [list(g) for g in gaps]))
        assert list(zip(*(c.to_pylist() for c in cols))) == want
    a, b = rng.integers(0, 2, (300, substring.REACH)), rng.integers(0, 2, (300, substring.REACH))
    b[:150] = np.where(rng.random((150, substring.REACH)) < 0.85, a[:150], b[:150])
    size = rng.integers(0, substring.REACH + 1, 300)
    length, equal = substring.extensions(a, b, size)
    for i in range(300):
        assert substring.extension(a[i, :size[i]], b[i, :size[i]]) == (length[i], equal[i])


def test_very_long_white_space_is_packed(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer
    texts = {1: " " * 1_500_000, 2: "a" + "\n" * 1_500_000 + "b", 3: "x y " * 10, 4: " " * 200_000 + "<|endoftext|>"}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = packing.pack(docs, with_ids=True).orderBy("doc_id", "start").collect()
    for i, text in texts.items():
        mine = [x for r in got if r["doc_id"] == i for x in r["ids"]]
        assert mine == [*t.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got if r["doc_id"] == i)


def test_items_without_a_name_hit_like_others(spark):
    """The query equals its twin where items repeat, have NULL ids and more columns."""
    import duckdb
    leak = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "x " + leak + " y", 5), (2, "clean words only", 6), (3, None, 7), (4, leak, 8)]
    items = [(None, leak, 1), (7, "two three four five six seven eight nine ten eleven", 2), (7, "two three four five six seven eight nine ten eleven", 2),
             (8, None, 3), (None, None, 4), (9, "", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, h long")
    b = spark.createDataFrame(items, "item_id long, text string, wid long")
    got = sorted(tuple(r) for r in decontaminate.contamination(d, b).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("benchmark", b.toPandas().astype({"item_id": "Int64"}))
    assert got == sorted(con.execute(ORACLE["op1_decontamination"]).fetchall())
    assert got[0][2] == 11 and got[0][3] == 2


def test_repeated_ids_are_one_calibration_row(spark):
    """A labelled id that many rows share gives one row of evidence, whichever way the rows lie."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["vile", "nasty", "awful"] if i % 2 else ["kind", "calm", "nice"]) for _ in range(12))) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    a = toxicity.train(once, labels, F.lit(True))
    again = once.unionByName(once.where("doc_id < 20").crossJoin(spark.range(30)).drop("id"))
    held = toxicity._sample(again, labels, F.lit(True), 30_000).where("part = 1")
    assert a is not None and held.count() == held.select("id").distinct().count()
    b = toxicity.train(again, labels, F.lit(True))
    assert b is not None and np.isfinite(b.weights).all()


def test_filter_by_score_equals_the_scores(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["vile", "nasty", "awful"] if i % 2 else ["kind", "calm", "nice"]) for _ in range(12)), i) for i in range(200)]
    docs = spark.createDataFrame([*rows, (200, None, 1), (None, "", 2), (3, rows[3][1], 3)], "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    scored = toxicity.score_documents(docs, model)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in scored.where("score < 0.5").collect())
    assert 0 < kept.count() < 203 and toxicity.without_toxic(docs, None).count() == 203
