"""Spelling variants, licence scans and collocations against brute force on small tables with nulls, empty and
long texts, ties, repeated rows and clashing columns."""

import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from patronage.llm import collocations, license_scan, spelling

SCHEMA = ("doc_id long, text string, lang string, n long, word string, h long, term string, rank int, score double, "
          "key long, shard int, label string, template int, w1 string")
TAIL = (7, "x", 7, "x", 7, 0.5, 7, 7, "x", 7, "x")
RNG = random.Random(11)


def table(spark, rows):
    return spark.createDataFrame([(*r, *TAIL) for r in rows], SCHEMA).repartition(3)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- spelling -------------------------------------------------------------

STEMS = ["gardening", "gardenings", "gardeming", "gradening", "gardèning", "hardening", "ÀÉÎÕÜßÿ", "àéîõüßÿ", "aaaaaaaa", "aaaaaaaaa",
         "aaaaaaab", "baaaaaaa", "abcdefg", "gfedcba", "abcdefgh", "abcdeefg"]


def spelling_rows():
    rows = []
    for i in range(40):
        n = RNG.randint(0, 60)
        rows.append((i, " ".join(RNG.choice(STEMS) + RNG.choice(["", "!", " x9", "-Gardening"]) for _ in range(n)), "en"))
    rows += [(100, None, "en"), (101, "", None), (None, "Gardening gardening GARDENING", None),
             (102, " ".join(["gardening"] * 3000), "en"), (103, "q" * 3000 + " " + "q" * 2999 + " " + "q" * 3000, "en"),
             (103, "q" * 2999, "en")]
    return [*rows, rows[0], rows[0]]


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(rows, damage=31):
    out = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def variants(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if edits(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("damage,cells", [(31, 16_384), (3, 2), (None, 5)])
def test_spelling_variants(spark, damage, cells):
    rows = spelling_rows()
    got = spelling.spelling_variants(table(spark, rows), damage=damage, cell_words=cells).collect()
    want = variants(spelled(rows, damage))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want)


def test_spelling_of_no_words(spark):
    assert spelling.spelling_variants(table(spark, [(1, None, "en"), (2, "too short", None)])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, "", "en")]).limit(0)).count() == 0


@pytest.mark.parametrize("letters,length", [("ab", 9), ("abc", 7), ("abcdefghijklmnopqrstuvwxyzàéîÿ×", 8)])
def test_trees_find_all_near_words(spark, letters, length):
    """Few letters make large classes of equal counts, which are compared without listing their pairs."""
    words = {"".join(RNG.choice(letters) for _ in range(RNG.choice([length, length, length + 1]))) for _ in range(900)}
    words |= {w[:3] + w[4:] for w in list(words)[:200] if len(w) > 7}
    counts = {w: RNG.randint(2, 300) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(df, cell_words=100).collect()}
    for w, (_, _, _, n_near, _) in variants(counts).items():
        best = min((x for x in counts if edits(w, x)), key=lambda x: (-counts[x], x), default=None)
        assert got[w] == (n_near, best, counts.get(best))


def test_large_groups_equal_pairs():
    words = ["".join(RNG.choice("ab") for _ in range(9)) for _ in range(200)]
    other = ["".join(RNG.choice("ab") for _ in range(8)) for _ in range(100)]
    mine = next(iter(spelling._by_length([w.encode() for w in sorted(set(words))], np.ones(len(set(words)), int)).values()))
    for queries in (sorted(set(words)), sorted(set(other))):
        q = next(iter(spelling._by_length([w.encode() for w in queries], np.ones(len(queries), int)).values()))
        got = sorted(spelling._large_group(q, mine, np.arange(len(queries)), np.arange(len(mine.n))))
        assert got == [(i, j) for i, a in enumerate(queries) for j, b in enumerate(sorted(set(words))) if edits(a, b)]


# -- licences -------------------------------------------------------------

NOTICE = "This file is Licensed under the Apache License, Version 2.0!"
DAMAGED = "licensed under the old apache license version 2 0"


def license_rows():
    rows = [(1, "cc by cc by CC-BY nc", "en"), (2, "The GNU General Public License; general public licence", "en"),
            (3, "All rights\nreserved. all rights reserved", None), (4, NOTICE, "en"), (5, DAMAGED, "en"), (6, None, "en"),
            (7, "", "en"), (8, "...!", "en"), (9, "cc", "en"), (10, "under the by rights", "en"),
            (11, "word " * 20_000 + "cc by " + "word " * 5000 + "cc by", "en"), (None, "cc by", None), (1, "another text", "en"),
            (12, "cc by " * 3000, "en"), (13, "licensed under " * 400, "en"), (14, "è cc by é", "fr")]
    return [*rows, rows[0], rows[3]]


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))


def test_license_places(spark):
    rows = license_rows()
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_scan(table(spark, rows)).collect()}
    distinct = {(i, t) for i, t, _ in rows}
    assert len(got) == len(distinct)
    for i, t in distinct:
        w = words_of(t)
        places = [(p, x.label) for x in license_scan.PHRASES for p in range(len(w))
                  if w[p:p + len(x.text.split())] == x.text.split()]
        r = got[i, len(w)]
        at = [p for p, _ in places]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert not places or r["score"] == 1


def test_license_notices(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_scan(table(spark, license_rows())).collect()}
    exact, damaged = got[4, len(words_of(NOTICE))], got[5, 9]
    assert (exact["labels"], exact["score"]) == ("apache-2.0", 1.0)
    assert damaged["labels"] == "apache-2.0" and 0.7 <= damaged["score"] < 1  # two diagonals, one word apart
    assert got[10, 4]["labels"] == "" and got[10, 4]["score"] < 0.7
    assert got[13, 800]["labels"] == ""
    assert license_scan.license_scan(table(spark, [(1, "a", "b")]).limit(0)).count() == 0


def test_license_spans_against_brute_force(spark):
    """Diagonals, their merging and shares on random texts over the templates' own words."""
    templates = [license_scan.Template("a", "one two three four five"), license_scan.Template("b", "two three two three one"),
                 license_scan.Template("c", "one two", True)]
    rows = [(i, " ".join(RNG.choice("one two three four five".split()) for _ in range(RNG.randint(0, 40))), "en") for i in range(60)]
    _, found = license_scan.scan(table(spark, rows), templates, k=2, gap=2, min_share=0.7)
    got = {(r["doc_id"], r["template"], r["begin"], r["end"], round(r["share"], 9), r["places"], r["found"]) for r in found.collect()}
    want = set()
    for i, t, _ in rows:
        w = t.split()
        for k, x in enumerate(templates):
            v = x.text.split()
            diagonals = {}
            for p in range(len(w) - 1):
                for o in range(len(v) - 1):
                    if w[p:p + 2] == v[o:o + 2]:
                        diagonals.setdefault(p - o, set()).add(o)
            group = []
            for g in [*sorted(diagonals), None]:
                if group and (g is None or g - group[-1] > (0 if x.phrase else 2)):
                    begin, end = min(d + min(diagonals[d]) for d in group), max(d + max(diagonals[d]) + 2 for d in group)
                    best = max(len(diagonals[d]) for d in group)
                    if end - begin <= 2 * len(v) and not x.phrase:
                        best = len(set().union(*(diagonals[d] for d in group)))
                    share, places = best / (len(v) - 1), sum(len(diagonals[d]) == len(v) - 1 for d in group)
                    want.add((i, k, begin, end, round(share, 9), places, places > 0 or (not x.phrase and share >= 0.7)))
                    group = []
                group.append(g)
    assert got == want


# -- collocations ---------------------------------------------------------

def collocation_rows():
    pool = ["new", "york", "city", "the", "of", "ünder", "漢字", "a\x00b", "tie", "New", "x"]
    rows = []
    for i in range(60):
        text = "".join(RNG.choice(pool) + RNG.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ";", "\r\n", "\xa0"]) for _ in range(40))
        rows.append((i, text, RNG.choice(["en", "en", "de", None, "und"])))
    rows += [(100, None, "en"), (101, "", "en"), (102, "new york " * 4000, "en"), (103, ".,;:!?", "de"), (None, "tie tie tie tie", "fr"),
             (104, "p q " * 12, "xx"), (105, "r s " * 12, "xx")]
    return [*rows, rows[0], rows[0]]


def mined(rows, top=2000, least=10):
    f = {}
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.setdefault(lang or "und", Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        often = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        kept = []
        for k, a in often.items():
            if any(len(x) > len(k) and k in {x[:2], x[1:]} and 100 * v >= 50 * a for x, v in often.items()):
                continue
            score, cut = min((10**6 * a * a // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
            kept.append((-score, -a, " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,top", [(1_000_000, 2000), (7, 3)])
def test_collocations(spark, shard, top):
    rows = collocation_rows()
    got = collocations.collocations(table(spark, rows), max_candidates=shard, top=top).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == mined(rows, top)


def test_collocations_of_no_text(spark):
    assert collocations.collocations(table(spark, [(1, None, "en"), (2, "", None)])).count() == 0
    assert collocations.collocations(table(spark, [(1, "a", "en")]).limit(0)).count() == 0


def test_blocks_do_not_change_words():
    data = ("One two.three\tfour " * 50 + "é!").encode()
    whole = [w for part in collocations.tokens(data) for w in part]
    assert [w for part in collocations.tokens(data, size=7) for w in part] == whole
    assert whole[:5] == [b"one", b"two", collocations.GAP, b"three", b"four"]


@pytest.mark.parametrize("digits,n,length", [(2, 9, 4), (5, 300, 4), (40, 2000, 6), (300, 3000, 4)])
def test_double_array(digits, n, length):
    rng = np.random.default_rng(n)
    seqs = np.unique(np.minimum(rng.integers(0, digits, (n, length)), rng.integers(0, digits, (n, length))), axis=0).astype(np.int32)
    base, check, final = collocations.double_array(seqs, digits)
    assert len(set(final.tolist())) == len(seqs)
    known = set(map(tuple, seqs.tolist()))
    tries = [*known, *map(tuple, rng.integers(0, digits, (2000, length)).tolist())]
    reached = {}
    for row in tries:
        s = 0
        for d in row:
            t = int(base[s]) + d
            if not 0 <= t < len(check) or check[t] != s:
                s = None
                break
            s = t
        assert (s is not None) == (row in known)
        reached[row] = s
    assert [reached[tuple(r)] for r in seqs.tolist()] == final.tolist()
