"""Phrase collocations counted through broadcast double-array tries.

Level by level: the words are counted, then candidate pairs are proposed and
counted, then candidate triples.

* Proposing.  A phrase can be frequent only if its parts are, so positions whose
  parts are not in a bit map of the frequent parts (fixed size, no false
  negatives) are passed over.  The others are summed under 64-bit word hashes, and
  a hash sequence that reaches the least count becomes a candidate.  Hashes that
  collide only add candidates.
* Counting.  Candidates are dealt into tries of bounded size by a hash of the
  phrase.  A task builds each trie as a double array, which is broadcast; every
  task then moves the states of all its text positions one digit further at a time,
  counts the accepting states, and the counts of the tasks are summed.  One trie is
  in memory at a time; more candidates mean more passes over the texts, not
  larger broadcasts.  Counts compare the words themselves and are exact.

A word is two digits of a base near the square root of the trie's vocabulary, which
keeps the children of a state close together and the arrays dense.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix64

_U = np.uint64
#: A-Z lower case, tabs blank, separators of pieces a line feed.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b
               for b in range(256))
#: Stands between pieces; no UTF-8 text holds this byte.
GAP = b"\xff"
#: Bits of the maps of frequent words and pairs (8 MB each).
MAP_BITS = 1 << 26
#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 22


def tokens(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, ``GAP`` between its pieces, in blocks of about ``size`` bytes cut at blanks."""
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + size) if len(data) - at > size else -1
        part = data[at:cut] if cut >= 0 else data[at:]
        yield part.translate(_TABLE).replace(b"\n", b" " + GAP + b" ").split()
        at = cut if cut >= 0 else len(data)


def _chunks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[str, bytes]]:
    """(lang, texts) of about ``size`` bytes or one longer text; texts are separate pieces."""
    held: dict[str, list[bytes]] = {}
    filled: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            data = text.as_buffer()
            if data is None or not data.size:
                continue
            held.setdefault(lang, []).append(data.to_pybytes())
            filled[lang] = filled.get(lang, 0) + data.size
            if filled[lang] >= size:
                yield lang, b"\n".join(held.pop(lang))
                del filled[lang]
            elif sum(filled.values()) >= 4 * size:
                for x in list(held):
                    yield x, b"\n".join(held.pop(x))
                filled.clear()
    for x in list(held):
        yield x, b"\n".join(held.pop(x))


def _encoded(part: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words."""
    d = pa.array(part, pa.large_binary()).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def _keys(lang: str, distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of a language's words."""
    seed = xxhash.xxh32_intdigest(lang.encode("utf-8"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct.to_pylist()), _U, len(distinct))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, data in _chunks(batches):
        for part in tokens(data):
            if not part:
                continue
            codes, distinct = _encoded(part)
            keys = _keys(lang, distinct)
            n = np.bincount(codes, minlength=len(distinct))
            real = pc.not_equal(distinct, pa.scalar(GAP, pa.large_binary()))
            words = distinct.cast(pa.binary())
            table = pa.table({"lang": pa.array([lang] * len(distinct), pa.string()), "word": words,
                              "key": keys.view(np.int64), "n": n.astype(np.int64)}).filter(real)
            yield from table.combine_chunks().to_batches()


# -- bit maps -------------------------------------------------------------

def bit_map(keys: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """The map of the keys modulo ``bits``, built in Spark and collected as blocks of 4 KB."""
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for b, block in zip(blocks["b"].to_pylist(), blocks["bits"].to_pylist()):
        out[(b - 1) * 4096:(b - 1) * 4096 + len(block)] = np.frombuffer(block, dtype=np.uint8)
    return out


def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys (as unsigned) are in a map; the place is the signed key's positive remainder."""
    at = (keys & _U(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(31))))


# -- proposing ------------------------------------------------------------

def _summed(parts: list[np.ndarray], key: np.ndarray) -> list[np.ndarray]:
    """Distinct hash sequences (told apart by ``key``) and their counts."""
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [p[first].view(np.int64) for p in parts] + [key[first].view(np.int64), n.astype(np.int64)]


def _propose(size: int, word_map, pair_map=None) -> Callable:
    """mapInArrow function: (h1..hsize, key, n) of the runs of ``size`` words whose parts may be frequent."""
    names = [f"h{i + 1}" for i in range(size)] + ["key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _chunks(batches):
            keys, known = [], []
            for part in tokens(data):
                if not part:
                    continue
                codes, distinct = _encoded(part)
                k = _keys(lang, distinct)
                may = _in_map(word_map.value, k) & pc.not_equal(distinct, pa.scalar(GAP, pa.large_binary())).to_numpy(
                    zero_copy_only=False)
                keys.append(k[codes])
                known.append(may[codes])
            if not keys:
                continue
            h, ok = np.concatenate(keys), np.concatenate(known)
            if size == 2:
                at = np.flatnonzero(ok[:-1] & ok[1:])
                parts = [h[at], h[at + 1]]
                key = pair_key(*parts)
            else:
                at = np.flatnonzero(ok[:-2] & ok[1:-1] & ok[2:])
                parts = [h[at], h[at + 1], h[at + 2]]
                left, right = pair_key(parts[0], parts[1]), pair_key(parts[1], parts[2])
                both = _in_map(pair_map.value, left) & _in_map(pair_map.value, right)
                parts, key = [p[both] for p in parts], pair_key(left, right)[both]
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(parts, key)], names=names)

    return run


# -- double-array tries ---------------------------------------------------

def double_array(seqs: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, final) of the trie of ``seqs`` (distinct rows of ``digits``-ary digits, sorted, of one length).

    State 0 is the root; from state s digit d leads to t = base[s] + d if check[t] == s.  ``final`` is the last
    state of each row.  Of each level, states with several children take the first gap that holds all of them;
    the others then fill the free cells one by one."""
    size = 2 * len(seqs) + 4 * digits + 2048
    used, base, check = np.zeros(size, bool), np.zeros(size, np.int32), np.full(size, -1, np.int32)

    def grow(least: int) -> None:
        nonlocal used, base, check
        more = max(least, len(used) // 2)
        used = np.concatenate([used, np.zeros(more, bool)])
        base = np.concatenate([base, np.zeros(more, np.int32)])
        check = np.concatenate([check, np.full(more, -1, np.int32)])

    used[0] = True
    state = np.zeros(len(seqs), dtype=np.int64)
    high = 1
    for level in range(seqs.shape[1]):
        d = seqs[:, level]
        new = np.concatenate([[True], (state[1:] != state[:-1]) | (d[1:] != d[:-1])])
        child = np.flatnonzero(new)
        parents, digit = state[child], d[child]
        begin = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        count = np.diff(np.append(begin, len(parents)))
        cells = np.empty(len(parents), dtype=np.int64)
        at: dict[int, int] = {}
        several = np.flatnonzero(count > 1)
        for g in several[np.argsort(-count[several], kind="stable")].tolist():
            b0, n = int(begin[g]), int(count[g])
            ch = digit[b0:b0 + n]
            rel = ch - ch[0]
            kind = n.bit_length()
            pos = at.get(kind, 1)
            while True:
                if pos + 512 + digits >= len(used):
                    grow(512 + digits)
                free = ~used[pos:pos + 256]
                for r in rel[1:].tolist():
                    free &= ~used[pos + r:pos + r + 256]
                i = int(free.argmax())
                if free[i]:
                    break
                pos += 256
            at[kind] = pos
            put = pos + i + rel
            used[put] = True
            cells[b0:b0 + n] = put
            high = max(high, int(put[-1]))
        single = np.flatnonzero(count == 1)
        if len(single):
            spare = np.flatnonzero(~used[:high + 1])[:len(single)]
            more = len(single) - len(spare)
            if high + more + 2 >= len(used):
                grow(more + 2)
            spare = np.concatenate([spare, np.arange(high + 1, high + 1 + more)])
            cells[begin[single]] = spare
            used[spare] = True
            high = max(high, int(spare[-1]))
        base[parents] = cells - digit
        check[cells] = parents
        state = cells[np.cumsum(new) - 1]
    return base[:high + 2].copy(), check[:high + 2].copy(), state


class Trie:
    """A double array over the words of several languages."""

    def __init__(self, vocabulary: dict[str, pa.Array], digits: int, length: int, base: np.ndarray, check: np.ndarray):
        self.vocabulary, self.digits, self.length, self.base, self.check = vocabulary, digits, length, base, check
        starts = np.cumsum([0, *(len(v) for v in vocabulary.values())])
        self.first = dict(zip(vocabulary, starts.tolist()))

    def ids(self, lang: str, words: pa.Array) -> np.ndarray:
        """Number of each word, -1 for a word that no phrase has."""
        known = self.vocabulary.get(lang)
        if known is None:
            return np.full(len(words), -1, dtype=np.int64)
        found = pc.fill_null(pc.index_in(words.cast(pa.binary()), value_set=known), -1).to_numpy(
            zero_copy_only=False).astype(np.int64)
        return np.where(found >= 0, found + self.first[lang], -1)

    def accepted(self, ids: np.ndarray) -> np.ndarray:
        """The accepting states that the runs of ``length`` words reach, all positions one digit at a time."""
        at = np.flatnonzero(ids[:max(len(ids) - self.length + 1, 0)] >= 0)
        state = np.zeros(len(at), dtype=np.int32)
        for word in range(self.length):
            now = ids[at + word]
            at, state, now = (x[now >= 0] for x in (at, state, now))
            for high in (True, False):
                digit = now // self.digits if high else now % self.digits
                to = np.clip(self.base[state] + digit, 0, len(self.check) - 1)
                alive = self.check[to] == state
                at, state, now = at[alive], to[alive], now[alive]
        return state


def _build(length: int):
    """applyInArrow function: the trie of one shard's candidates, and the accepting state of each."""
    names = [f"w{i + 1}" for i in range(length)]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        langs = table["lang"].to_numpy(zero_copy_only=False)
        shard = table["shard"][0].as_py()
        vocabulary, ids = {}, np.zeros((len(table), length), dtype=np.int64)
        at = 0
        for lang in sorted(set(langs)):
            rows = np.flatnonzero(langs == lang)
            cols = [table[c].take(pa.array(rows)).combine_chunks() for c in names]
            known = pc.unique(pa.concat_arrays(cols))
            for i, c in enumerate(cols):
                ids[rows, i] = pc.index_in(c, value_set=known).to_numpy(zero_copy_only=False) + at
            vocabulary[lang], at = known, at + len(known)
        digits = int(np.ceil(np.sqrt(at))) + 1
        seqs = np.stack([ids // digits, ids % digits], axis=2).reshape(len(table), 2 * length).astype(np.int32)
        order = np.lexsort(seqs.T[::-1])
        base, check, final = double_array(seqs[order], digits)
        state = np.empty(len(table), dtype=np.int32)
        state[order] = final
        trie = pickle.dumps(Trie(vocabulary, digits, length, base, check))
        out = {"shard": pa.array([shard] * (len(table) + 1), pa.int32()),
               "state": pa.array(np.append(state, -1), pa.int32()),
               "trie": pa.array([None] * len(table) + [trie], pa.binary())}
        for c in ["lang", *names, "key"]:
            col = table[c].combine_chunks()
            out[c] = pa.concat_arrays([col, pa.nulls(1, col.type)])
        return pa.table({c: out[c] for c in ["shard", "state", "lang", *names, "key", "trie"]})

    return run


#: Accepting states whose counts travel in one row.
STATES = 4096
_COUNTS = "block int, state array<int>, n array<long>"


def _count(shared):
    """mapInArrow function: how often a task's texts reach the accepting states of a broadcast trie, as rows of
    the states above zero of a block of ``STATES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        total = np.zeros(len(trie.check), dtype=np.int64)
        for lang, data in _chunks(batches):
            ids = []
            for part in tokens(data):
                if part:
                    codes, distinct = _encoded(part)
                    ids.append(trie.ids(lang, distinct)[codes])
            if ids:
                total += np.bincount(trie.accepted(np.concatenate(ids)), minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            blocks, first = np.unique(at // STATES, return_index=True)
            ends = pa.array(np.append(first, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array((at % STATES).astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(total[at]))], names=["block", "state", "n"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum rows of :func:`_count` that are dealt by block; memory follows the trie, not the number of tasks."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, state, n in zip(b.column("block").to_pylist(), b.column("state"), b.column("n")):
            total = sums.setdefault(block, np.zeros(STATES, dtype=np.int64))
            total[state.values.to_numpy()] += n.values.to_numpy()
    for block, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at + block * STATES).astype(np.int32)), pa.array(total[at])],
                                         names=["state", "n"])


def counted(texts: DataFrame, candidates: DataFrame, length: int, max_candidates: int) -> DataFrame:
    """(lang, w1.., key, n) of the ``candidates`` (lang, w1.., key): their occurrences in ``texts``.  At most about
    ``max_candidates`` phrases are in a trie; the texts are read once for each trie."""
    spark = texts.sparkSession
    names = [f"w{i + 1}" for i in range(length)]
    shards = -(-candidates.count() // max_candidates)
    dealt = candidates.withColumn("shard", F.pmod(F.xxhash64("lang", *names), F.lit(max(shards, 1))).cast("int"))
    kinds = ", ".join(f"{c} binary" for c in names)
    built = materialize(dealt.select("shard", "lang", *names, "key").groupBy("shard").applyInArrow(
        _build(length), f"shard int, state int, lang string, {kinds}, key long, trie binary"), "tries")
    found = []
    for shard in range(shards):
        blob = built.where((F.col("shard") == shard) & (F.col("state") == -1)).select("trie").first()
        if blob is not None:
            shared = spark.sparkContext.broadcast(pickle.loads(bytes(blob["trie"])))
            sums = texts.mapInArrow(_count(shared), _COUNTS).repartition("block").mapInArrow(_sum, "state int, n long")
            found.append(materialize(sums.select(F.lit(shard).alias("shard"), "state", "n"), "phrase-counts"))
            shared.unpersist()
    sums = found[0] if found else spark.createDataFrame([], "shard int, state int, n long")
    for more in found[1:]:
        sums = sums.unionByName(more)
    return built.where("state >= 0").join(sums, ["shard", "state"]).select("lang", *names, "key", "n")


def phrases(docs: DataFrame, min_count: int = 10, max_candidates: int = 1_000_000, map_bits: int = MAP_BITS,
            lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words (lang, w1, key, n) and the phrases of two (lang, w1, w2, key, n) and three words that occur
    ``min_count`` times or more in the texts of their language (binary words, exact counts).

    Every row counts, repeated ones too; NULL text is empty, a NULL language is ``und``; phrases do not reach
    across ``. , ; : ! ?`` and line ends; other columns are ignored; an empty table gives empty ones."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("binary").alias("text")).where("text is not null")
    words = materialize(texts.mapInArrow(_count_words, "lang string, word binary, key long, n long")
                        .groupBy("lang", F.col("word").alias("w1"), "key").agg(F.sum("n").alias("n")), "words")
    frequent = materialize(words.where(F.col("n") >= min_count).select("lang", "w1", "key"), "frequent-words")
    word_map = spark.sparkContext.broadcast(bit_map(frequent, "key", map_bits))

    def proposed(length: int, pair_map=None) -> DataFrame:
        hashes = [f"h{i + 1}" for i in range(length)]
        schema = ", ".join(f"{c} long" for c in [*hashes, "key", "n"])
        heavy = (texts.mapInArrow(_propose(length, word_map, pair_map), schema)
                 .groupBy(*hashes, "key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).drop("n"))
        for i, c in enumerate(hashes):
            word = frequent.select(F.col("key").alias(c), F.col("w1").alias(f"w{i + 1}"), F.col("lang").alias(f"lang{i}"))
            heavy = heavy.join(word, c)
        same = " and ".join(f"lang0 = lang{i}" for i in range(1, length))
        kept = heavy.where(same).select(F.col("lang0").alias("lang"), *[f"w{i + 1}" for i in range(length)], "key")
        return materialize(kept, "candidates")

    def often(length: int, candidates: DataFrame) -> DataFrame:
        return materialize(counted(texts, candidates, length, max_candidates).where(F.col("n") >= min_count), "phrases")

    pairs = often(2, proposed(2))
    pair_map = spark.sparkContext.broadcast(bit_map(pairs, "key", map_bits))
    triples = often(3, proposed(3, pair_map))
    word_map.unpersist()
    pair_map.unpersist()
    return words, pairs, triples


#: Parts in which a language's phrases are ranked before the last ranking, which gets their first ``top`` only.
RANK_PARTS = 64


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 10, inside: int = 50,
                 max_candidates: int = 1_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of :func:`phrases` by score.

    ``a`` counts the phrase, ``l`` and ``r`` its first part and rest at the cut with the lowest score, ``n`` all
    words of the language; score = floor(1000000 * a * a / (l * r)).  Ties of cuts go to the shorter first part,
    ties of phrases to the larger ``a``, then to the smaller phrase in UTF-8 order.  A pair inside a triple
    that has at least ``inside`` percent of its occurrences is left out.  Counts up to 10**15 are exact."""
    words, pairs, triples = phrases(docs, min_count, max_candidates, lang_col=lang_col, text_col=text_col)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    one = words.where(F.col("n") >= min_count)
    first = one.select("lang", "w1", F.col("n").alias("l1"))

    def last(col: str) -> DataFrame:
        return one.select("lang", F.col("w1").alias(col), F.col("n").alias("r1"))

    def score(l: str, r: str):
        big = "cast({} as decimal(15, 0))".format
        return F.expr(f"({big('a')} * {big('a')} * cast(1000000 as decimal(7, 0))) div ({big(l)} * {big(r)})")

    two = (pairs.select("lang", "w1", "w2", F.col("n").alias("a")).join(first, ["lang", "w1"]).join(last("w2"), ["lang", "w2"])
           .select("lang", "w1", "w2", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), score("l1", "r1").alias("score")))
    parts = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
                           .alias("p"), F.col("n").alias("longer")).select("lang", "p.*", "longer")
    parts = parts.groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    two = two.join(parts, ["lang", "w1", "w2"], "left").where(
        F.coalesce(F.col("longer") * 100 < F.col("a") * inside, F.lit(True)))
    head = pairs.select("lang", "w1", "w2", F.col("n").alias("l2"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("r2"))
    cuts = (triples.select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
            .join(first, ["lang", "w1"]).join(last("w3"), ["lang", "w3"])
            .join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
            .withColumn("s1", score("l1", "r2")).withColumn("s2", score("l2", "r1")))
    second = F.col("s2") < F.col("s1")
    three = cuts.select("lang", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("w1", "w2", "w3")]).alias("phrase"), "a",
                        F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                        F.when(second, F.col("r1")).otherwise(F.col("r2")).alias("r"),
                        F.least("s1", "s2").alias("score"))
    both = two.select("lang", F.concat_ws(" ", F.col("w1").cast("string"), F.col("w2").cast("string")).alias("phrase"),
                      "a", "l", "r", "score").unionByName(three)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    first = both.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                              F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
