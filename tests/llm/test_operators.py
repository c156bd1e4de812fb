"""The operators on a small table with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from patronage.llm import archive, decontaminate, fingerprint, jaccard_join, langid, packing, substring, token_counts
from patronage.llm import toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n_words long, words string, score double"
RNG = random.Random(5)


def prose(n, words="alpha beta gamma delta the of and to in", rng=RNG):
    pool = words.split()
    return " ".join(rng.choice(pool) + (str(rng.randint(0, 99)) if rng.random() < 0.6 else "") for _ in range(n))


BASE, PASSAGE, LONG = prose(200), prose(70), prose(9_000)
TEXTS = {0: BASE, 1: BASE, 2: BASE.replace("gamma", "Gamma", 1) + " end", 3: prose(40) + " " + PASSAGE + " " + prose(30),
         4: prose(25) + ". " + PASSAGE.upper() + "! " + prose(60), 5: None, 6: "", 7: "!!! ...", 8: "one two", 9: "One  two",
         10: LONG, 11: "é ü漢字 🙂 <|endoftext|>", 12: prose(20) + " quick brown fox jumps over a lazy dog near the river bank today",
         13: "tie tie " * 40}
ITEMS = [(1, "The quick brown fox jumps over a lazy dog near the river bank"), (2, "one two"), (None, "alpha"), (3, None), (4, "")]


def rows():
    out = [(i, t, "en", "s", 0, 1, 1, "x", 0.5) for i, t in TEXTS.items()]
    return [*out, out[3], out[3], (None, BASE, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(docs, items).collect()}
    assert len(got) == len(TEXTS) + 1  # repeated rows give one; the NULL id is an id
    for i, t in [*TEXTS.items(), (None, BASE)]:
        w, hit, found = words(t), set(), set()
        for item, text in ITEMS:
            v = words(text)
            for g in {tuple(v[j:j + 10]) for j in range(max(len(v) - 9, 1))} if v else ():
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s:s + len(g)]) == g:
                        hit.update(range(s, s + len(g)))
                        found.add(item)
        r = got[i, len(w)]
        assert (r["n_hit"], r["n_items"], r["contaminated"]) == (len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest()
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_proximity(spark, docs):
    q = spark.createDataFrame([(1, ["fox", "dog", "lazy"]), (2, ["fox", "today"])], "wid long, words array<string>")
    index = decontaminate.PositionalIndex(docs, q.select(F.explode("words").alias("term")))
    assert {(r["doc_id"], r["wid"]) for r in index.proximity_matches(q, 6).collect()} == {(12, 1)}
    assert {(r["doc_id"], r["wid"]) for r in index.proximity_matches(q, 10).collect()} == {(12, 1), (12, 2)}


def test_token_counts_and_packing(spark, docs, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_counts.vocabulary_path())
    want = {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in TEXTS.items()}
    got = token_counts.token_counts(docs, batch_bytes=500).collect()
    assert len(got) == len(rows())
    for r in got:
        x = TEXTS.get(r["doc_id"], BASE) or ""
        assert r["n_tokens"] == want.get(r["doc_id"], want[0]) and r["n_bytes"] == len(x.encode())
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.token_counts(empty).count() == 0
    pieces = packing.pack(docs, with_ids=True).collect()
    full = sorted(tuple(x["ids"]) for x in pieces)
    assert all(crc32(b"".join(v.to_bytes(4, "little") for v in x["ids"])) == x["ids_crc32"] for x in pieces)
    named = {}
    for x in sorted(pieces, key=lambda x: x["start"]):
        if x["doc_id"] not in (None, 3):  # ids that several rows have
            named.setdefault(x["doc_id"], []).extend(x["ids"])
    assert named == {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in TEXTS.items() if i != 3}
    assert sum(len(x) for x in full) == sum(want[i] + 1 for i in TEXTS) + 2 * (want[3] + 1) + want[0] + 1
    bins = {}
    for x in pieces:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_jaccard_components(spark, docs, empty):
    got = {}
    for r in jaccard_join.jaccard_components(docs, k=4, num=85, den=100).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    sets = {}
    for i, t in TEXTS.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[i] = {tuple(w[j:j + 4]) for j in range(max(len(w) - 3, 1))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                x = len(sets[a] & sets[b])
                if sets[a] and 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: {(len(sets[i]), comp[i])} for i in sets} == {i: v for i, v in got.items() if i is not None}
    assert got[None] == {(len(sets[0]), 0)}
    assert jaccard_join.jaccard_components(empty).count() == 0


def brute_components(texts, k, num, den):
    """{id: smallest id of its component} by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(len(w) - k + 1, 1))}
    comp = {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {i: new if c == old else c for i, c in comp.items()}
    return comp


def near_threshold_families(rng, n, num, den):
    """Texts that grow out of one another at their ends, about as much as a link allows."""
    texts, at = {}, 0
    for f in range(n):
        size = rng.randint(20, 60)
        base = [f"w{f}_{i}" for i in range(size)]
        most = size * (den - num) // den
        for _ in range(4):
            cut, tail = rng.randint(0, most // 2), rng.randint(0, most)
            texts[at] = " ".join(base[:size - cut] + [f"t{f}_{i}" if rng.random() < 0.7 else f"o{at}_{i}" for i in range(tail)])
            at += 1
    return texts


def needed(n, m, num, den):
    """Least shared prefix shingles of a link between sets of n and m shingles."""
    return -(-(n + m) * num // (num + den)) - max(-(-num * x // den) - 1 for x in (n, m))


@pytest.mark.parametrize("num", [80, 85])
def test_jaccard_prune_keeps_every_entry_of_a_link(spark, num):
    """A single pass of prune over lists of two or three sizes: an entry that one partner of its list needs stays."""
    cases = [(n, m, hi) for n in range(20, 120) for hi in range(n + 2, min(n * 100 // num, n + 20) + 1)
             for m in range(n + 1, hi) if needed(n, m, num, 100) < needed(n, hi, num, 100)][:300]
    assert cases
    entries = [(tok, 0, 10_000 * tok + j, size) for tok, (n, m, hi) in enumerate(cases) for j, size in enumerate((n, m, hi))]
    frame = spark.createDataFrame(entries, "tok long, pos int, gid long, n long")
    join = object.__new__(jaccard_join.JaccardJoin)
    join.num, join.den = num, 100
    kept = {(r["tok"], r["gid"] % 10_000) for r in join.prune(frame).collect()}
    for tok, (n, m, _) in enumerate(cases):
        if needed(n, m, num, 100) <= 1:
            assert {(tok, 0), (tok, 1)} <= kept


def test_jaccard_links_at_the_threshold(spark):
    common = [f"c{i}" for i in range(26)]
    texts = {1: " ".join([*common, "own"]), 2: " ".join([*common, "p", "q", "r"]), 3: " ".join([*common, "p", "q", "r", "t"])}
    texts.update((i + 10, t) for i, t in near_threshold_families(random.Random(3), 60, 85, 100).items())
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame, k=4, num=85, den=100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_passages(spark, docs, empty):
    got = substring.passages(docs, min_words=50).collect()
    pairs = {(r["doc_id"], r["partner_id"]): r for r in got}
    assert set(pairs) == {(1, 0), (2, 0), (2, 1), (4, 3)}
    r = pairs[4, 3]
    assert (r["start_word"], r["end_word"], r["partner_start"], r["identity"]) == (25, 95, 40, 1.0)
    kept = {r["doc_id"]: r["text"] for r in substring.cut_repeats(docs, substring.passages(docs)).collect()}
    assert 1 not in kept and words(kept[4]) == words(TEXTS[4])[:25] + words(TEXTS[4])[95:] and kept[10] == LONG
    assert {5, 6, 7, 8} <= set(kept)
    assert substring.passages(empty).count() == 0


def test_passages_whose_seeds_meet_other_partners(spark, monkeypatch):
    """Every place of documents 3, 6 and 9 has a first document and a document before that hold a part alone."""
    texts, whole = {}, {}
    for t in range(12):
        rng, base = random.Random(t), 100 * t
        words = [f"p{t}x{i}" for i in range(60)]
        for i in range(1, 10):
            part = (words[:35], words[25:], words)[(i - 1) % 3]
            a, b = ([f"f{base + i}{side}{j}" for j in range(rng.randint(5, 40))] for side in "ab")
            texts[base + i] = " ".join([*a, *part, *b])
            if i in (6, 9):
                whole[base + i] = (len(a), len(a) + 60)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(substring, "SLICE", 2)  # the documents of a seed are ordered over several tasks
    got = substring.passages(frame, min_words=50).collect()
    for i, (start, end) in whole.items():
        assert any(r["doc_id"] == i and r["start_word"] <= start and r["end_word"] >= end for r in got), i
    for r in got:
        assert r["partner_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50


def test_fingerprints(spark, docs, empty):
    got = fingerprint.edited_fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), rows_per_bucket=3).collect()
    by, order = {r["doc_id"]: r for r in got}, sorted(TEXTS, reverse=True)
    assert len(got) == len(TEXTS)
    for i, n in zip(order, [*order[1:], order[0]], strict=True):
        t, u = TEXTS[i] or "", TEXTS[n] or ""
        edited = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        assert by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sig = fingerprint.signature(fingerprint.lz78(edited)[0])
        assert by[i]["edited_fingerprint"] == fingerprint.to_hex(sig) and by[i]["n_chars"] == len(t)
    assert by[0]["fingerprint"] == by[1]["fingerprint"] and by[5]["fingerprint"] == by[6]["fingerprint"]
    assert fingerprint.edited_fingerprints(docs).count() == len(rows())
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_archives(spark):
    big, pages = "<p>é</p>" * 30, []
    pages = [(1, "http://a.org/1", big), (2, None, big), (3, "http://a.org/ x", "s"), (4, "u", "s"), (5, "v", None), (None, "w", big),
             (1, "http://a.org/1", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, kind int").repartition(2)
    got = archive.archive_pages(df).collect()
    assert len(got) == len(pages)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (None, "revisit", 1), (3, "response", None),
                     (4, "response", None), (5, "response", None)}
    assert all(r["payload_digest"] == hashlib.sha256((dict((p[0], p[2]) for p in pages)[r["page_id"]] or "").encode()).hexdigest()
               and r["payload_bytes"] == len((dict((p[0], p[2]) for p in pages)[r["page_id"]] or "").encode()) for r in got)
    assert archive.archive_pages(df.limit(0)).count() == 0


def test_url_rules_and_cascade(spark):
    from patronage.llm.queries import URL_RULES
    urls = ["http://A.example.org/es/1", "https://example.org/en/12?x", "http://x.org", "http://x.org/", "ftp://b.com/fr/", "http://b.com/fr",
            "http://com/de/#f", "noscheme", None, "http://notexample.org/es/", "http:///p", "a://b://c.org/x"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    want = ["example.org/es/", "example.org/en/1", None, "org/", "com/fr/", None, "com/de/", None, None, "org/", None, None]
    got = sorted(url_filter.judge(df, URL_RULES).collect(), key=lambda r: r["page_id"])
    assert [r["rule"] for r in got] == want
    verdict = {r: v for v, r in URL_RULES}
    assert [r["verdict"] for r in got] == [verdict.get(r, "allow") for r in want]
    assert (got[0]["host"], got[0]["path"], got[7]["host"], got[11]["host"]) == ("a.example.org", "/es/1", "", "b:")
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.Cascade(universe, universe.where("key % 7 = 0"))
    assert universe.where(cascade.contains(F.col("key")) != F.expr("key % 7 = 0")).count() == 0
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.Cascade(universe, universe, max_words=3)


def _judged(url, rules, default="allow"):
    """(rule, verdict) by trying every rule."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        own = rule.partition("/")[0]
        if host and (host == own or host.endswith("." + own)) and path.startswith(rule[len(own):]):
            fits.append((len(rule), own.count("."), verdict == "block", rule))
    return (max(fits)[3], "block" if max(fits)[2] else "allow") if fits else (None, default)


@pytest.mark.parametrize("max_words", [1 << 20, 40])
def test_url_rules_of_many_shapes(spark, max_words):
    rng = random.Random(7)
    names = ["a", "bb", "c-c", "é", "org", "com", "x"]

    def some(least, most):
        host = ".".join(rng.choice(names) for _ in range(rng.randint(least, most)))
        return host, "/" * rng.randint(0, 1) + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 30)))
    rules = []
    for _ in range(300):
        host, path = some(1, 5)
        rules.append((rng.choice(["allow", "block"]), host + ("/" + path if path else "")))
    rules += [("allow", "com/ab"), ("block", "a.com/"), ("allow", "x.org/t"), ("block", "x.org/t"), ("block", "")]
    assert len({(r.partition("/")[0].count("."), len(r.partition("/")[2])) for _, r in rules}) > 64
    urls = [None, "", "://", "http://a.com/abz", "http://x.org/tt", "http://.", "http://a..com/", "http://" + "a." * 40000 + "com/" + "ab" * 40000]
    for _ in range(400):
        host, path = some(1, 6)
        rule = rng.choice(rules)[1]
        urls.append("http://" + rng.choice([host + path, "x." + rule + rng.choice("ab/"), rule, rule.upper(), rule + "?q"]))
    df = spark.createDataFrame([(i % 300 if i else None, u, "k") for i, u in enumerate(urls)], "page_id long, url string, row string")
    got = url_filter.judge(df.repartition(3), rules, default="none", max_words=max_words)
    want = [(i % 300 if i else None, *_judged(u, rules, "none")) for i, u in enumerate(urls)]
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got.collect()) == Counter(want)
    if max_words > 40:
        table = spark.createDataFrame([*rules, ("block", None)], "verdict string, rule string")
        assert url_filter.judge(df, table, default="none").exceptAll(got).isEmpty()
        assert {r["verdict"] for r in url_filter.judge(df, [], default="none").collect()} == {"none"}


def test_language_and_toxicity(spark, docs, empty):
    rng = random.Random(9)
    en, fr = "the and house dog with river", "être chien avec maison où rivière"
    train = [(i, prose(40, en if i % 2 else fr, rng), "en" if i % 2 else "fr") for i in range(60)]
    train += [(100, None, "en"), (101, "text", None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") < 40)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in train[40:60]) and got[100] == "und"
    few = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert few[5] == few[6] == few[7] == "und" and len(few) == len(TEXTS) + 1
    assert langid.train(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}

    texts = [(i, prose(60, rng=rng) + (" scum trash moron " * 2 if i % 4 == 0 else " ") + prose(60, rng=rng)) for i in range(200)]
    labels = spark.createDataFrame([*[(i, int(i % 4 == 0)) for i, _ in texts], (None, 1), (7, None)], "doc_id long, toxic int")
    td = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(td, labels, F.col("doc_id") < 150)
    out = {r["doc_id"]: r for r in toxicity.score_documents(td, model).collect()}
    assert sum(out[i]["predicted"] == (i % 4 == 0) for i in range(150, 200)) >= 48
    s = out[152]["segments"][0]
    assert 55 <= s["first_word"] <= 60 and 66 <= s["end_word"] <= 71
    calm = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert calm[5]["score"] == calm[6]["score"] and not calm[5]["segments"] and calm[5]["predicted"] == 0
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.train(td, labels.limit(0), F.lit(True)) is None
    assert toxicity.score_documents(docs, None).where("score <> 0").count() == 0


def test_pipeline_stages_follow_each_other(spark, docs, tmp_path):
    import corpus_pipeline as p
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = d
    ids = []
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{len(ids)}")
        out = spark.read.parquet(f"{tmp_path}/{len(ids)}")
        ids.append(sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect()))
    every = sorted([*TEXTS, 3, 3, -1])
    assert ids[0] == every  # no toxic label, nothing goes
    assert ids[1] == [-1, *[i for i in sorted(TEXTS) if i not in (1, 2, 9)]]  # a NULL id cannot be named
    assert ids[2] == ids[1]  # 4 loses its passage and stays
    assert ids[3] == [i for i in ids[2] if i != 12]
    packed = p.STAGES[-1][1](spark, out, str(tmp_path))
    assert sorted(-1 if r[0] is None else r[0] for r in packed.select("doc_id").distinct().collect()) == ids[3]
