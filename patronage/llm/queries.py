"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    archive,
    collocations,
    decontaminate,
    fingerprint,
    jaccard_join,
    langid,
    license_scan,
    packing,
    spelling,
    substring,
    token_counts,
    toxicity,
    url_filter,
)
from .common import crc_mod, load

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in documents through the positional index."""
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), n=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learnt where crc32(doc_id) mod 5 is not 0."""
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored = toxicity.score_documents(docs, model)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(load(spark, sf_dir, "documents"), limit=512)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt where crc32(doc_id) mod 4 is not 2."""
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs, crc_mod("doc_id", 4) != 2)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.jaccard_components(load(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(load(spark, sf_dir, "documents"), capacity=2048)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, with few changes, that repeat words of an earlier document."""
    return substring.passages(load(spark, sf_dir, "documents"), min_words=50, identity=0.8)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every text and of its edited text."""
    return fingerprint.edited_fingerprints(load(spark, sf_dir, "documents"))


def op9_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through legacy archives to WARC and back."""
    return archive.archive_pages(load(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL under the rules."""
    return url_filter.judge(load(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 letters or more, the words one edit away from them and the form that these lead to."""
    return spelling.spelling_variants(load(spark, sf_dir, "documents"), min_letters=7, min_count=2, ratio=10, damage=31)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the licence phrases, and the labels of all licence notices found by their diagonals."""
    return license_scan.license_scan(load(spark, sf_dir, "documents"), k=2, gap=2, min_share=0.7)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two and three words of each language."""
    return collocations.collocations(load(spark, sf_dir, "documents"), top=2000, min_count=10, inside=50)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_toxicity, op3_token_counts, op4_language_id, op5_jaccard_join, op6_packing, op7_substring_dedup,
    op8_fingerprints, op9_archives, op10_url_filter, op11_spelling_variants, op12_license_scan, op13_collocations)}

#: The twin's own copy of the templates of op12 (label, words, phrase).
_TEMPLATES = """
 ('cc-by', 'cc by', true), ('gpl', 'general public license', true), ('reserved', 'all rights reserved', true),
 ('apache-2.0', 'licensed under the apache license version 2 0', false),
 ('apache-2.0', 'you may not use this file except in compliance with the license', false),
 ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted', false),
 ('cc-by-nc', 'licensed under cc by nc 4 0', false), ('cc-by-sa', 'licensed under cc by sa 4 0', false),
 ('cc0', 'to the extent possible under law the author has waived all copyright', false),
 ('gnu-gpl', 'licensed under the gnu general public license version', false),
 ('gnu-gpl', 'under the terms of the gnu general public license as published by the free software foundation', false),
 ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee', false),
 ('mit', 'released under the mit license', false),
 ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software', false),
 ('mpl-2.0', 'subject to the terms of the mozilla public license v 2 0', false)"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 iw AS (SELECT item_id, least(len(w), 10) AS n,
          unnest([array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ')
                  for i in range(1, greatest(len(w) - 9, 1) + 1)]) AS g
        FROM b WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n),
 dg AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM dw),
 occ AS (SELECT DISTINCT doc_id, dg.n, s, item_id FROM dg JOIN iw ON dg.g = iw.g AND dg.n = iw.n),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest([array_to_string(list_slice(w, i, i + 3), ' ')
         for i in range(1, greatest(len(w) - 3, 1) + 1)]) AS g FROM d WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
       GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
       WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op9_archives": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
            sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)""",
    "op10_url_filter": """
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
 u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
         THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 m AS (SELECT page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id
         ORDER BY length(r.host || r.path) DESC) AS k
       FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
   CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tbl
   FROM (SELECT unnest(range(256)) AS i)),
 runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
 per AS (SELECT run, id || ':' || run AS s, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
 hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, strlen(s) + 1),
    lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i - 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, tbl[1 + (xor(a, b) & 255)]))) AS h FROM per, crc),
 damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, c FROM hashed),
 w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
 cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
 near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      AND length(a.word) = length(b.word)
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
 best AS (SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS k FROM near),
 forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form,
    CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best ON w.word = best.word AND k = 1),
 r(word, root) AS (SELECT word, word FROM forms
    UNION ALL SELECT r.word, forms.form FROM r JOIN forms ON r.root = forms.word WHERE forms.form IS NOT NULL),
 last AS (SELECT r.word, r.root FROM r JOIN forms ON r.root = forms.word WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN last ON forms.word = last.word""",
    "op12_license_scan": f"""
WITH t AS (SELECT row_number() OVER () AS t, label, phrase, string_split(x, ' ') AS w FROM (VALUES {_TEMPLATES}) v(label, x, phrase)),
 tr AS (SELECT t, label, phrase, len(w) AS m, o, w[o] AS a, w[o + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS o FROM t)),
 d AS (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents),
 dr AS (SELECT doc_id, text, p, w[p] AS a, w[p + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS p FROM d)),
 hit AS (SELECT doc_id, md5(coalesce(text, '')) AS x, t, label, phrase, m, p - o AS g, o FROM dr JOIN tr USING (a, b)),
 dia AS (SELECT doc_id, x, t, label, phrase, m, g, count(*) AS v, list(o) AS os, min(o) + g AS lo, max(o) + g + 2 AS hi
   FROM hit GROUP BY doc_id, x, t, label, phrase, m, g),
 brk AS (SELECT *, CASE WHEN g - lag(g) OVER q > CASE WHEN phrase THEN 0 ELSE 2 END THEN 1 ELSE 0 END AS z FROM dia
   WINDOW q AS (PARTITION BY doc_id, x, t ORDER BY g)),
 num AS (SELECT *, sum(z) OVER (PARTITION BY doc_id, x, t ORDER BY g) AS part FROM brk),
 sp AS (SELECT doc_id, x, label, phrase, m, len(list_distinct(flatten(list(os)))) AS merged, max(v) AS best, max(hi) - min(lo) AS span,
   count(*) FILTER (v = m - 1) AS places, min(g) FILTER (v = m - 1) AS f, max(g) FILTER (v = m - 1) AS l FROM num GROUP BY doc_id, x, t, label, phrase, m, part),
 sc AS (SELECT *, CASE WHEN span <= 2 * m AND NOT phrase THEN merged ELSE best END / (m - 1) AS share FROM sp),
 per AS (SELECT doc_id, x, sum(places) FILTER (phrase AND places > 0) AS n_base, min(f) FILTER (phrase) AS f, max(l) FILTER (phrase) AS l,
   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase AND places > 0) AS base_labels,
   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR NOT phrase AND share >= 0.7) AS labels, max(share) AS score
   FROM sc GROUP BY doc_id, x)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word,
 CAST(l AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN per ON d.doc_id IS NOT DISTINCT FROM per.doc_id AND md5(coalesce(d.text, '')) = per.x""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
 w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, len(w) - i + 1 AS room FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
 f1 AS (SELECT lang, a, count(*) AS n FROM g GROUP BY ALL),
 f2 AS (SELECT lang, a, b, count(*) AS n FROM g WHERE room >= 2 GROUP BY ALL HAVING n >= 10),
 f3 AS (SELECT lang, a, b, c, count(*) AS n FROM g WHERE room >= 3 GROUP BY ALL HAVING n >= 10),
 tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f1 GROUP BY lang),
 inside AS (SELECT lang, a, b, max(n) AS longer FROM (SELECT lang, a, b, n FROM f3 UNION ALL SELECT lang, b, c, n FROM f3) GROUP BY ALL),
 two AS (SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.n AS x, l.n AS l, r.n AS r,
    CAST(1000000 AS HUGEINT) * f2.n * f2.n // (CAST(l.n AS HUGEINT) * r.n) AS score
   FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.a = f2.a JOIN f1 r ON r.lang = f2.lang AND r.a = f2.b
   LEFT JOIN inside i ON i.lang = f2.lang AND i.a = f2.a AND i.b = f2.b
   WHERE i.longer IS NULL OR 100 * i.longer < 50 * f2.n),
 cuts AS (SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.n AS x, k, CASE k WHEN 1 THEN l1.n ELSE l2.n END AS l,
    CASE k WHEN 1 THEN r2.n ELSE r1.n END AS r
   FROM f3 JOIN f1 l1 ON l1.lang = f3.lang AND l1.a = f3.a JOIN f1 r1 ON r1.lang = f3.lang AND r1.a = f3.c
   JOIN f2 l2 ON l2.lang = f3.lang AND l2.a = f3.a AND l2.b = f3.b JOIN f2 r2 ON r2.lang = f3.lang AND r2.a = f3.b AND r2.b = f3.c,
   (VALUES (1), (2)) v(k)),
 scored AS (SELECT *, CAST(1000000 AS HUGEINT) * x * x // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
 three AS (SELECT lang, phrase, x, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, x DESC, encode(phrase)) AS rank
   FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(x AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, tot.n,
 CAST(score AS BIGINT) AS score FROM ranked JOIN tot ON tot.lang = ranked.lang WHERE rank <= 2000""",
}
