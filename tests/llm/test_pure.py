"""Parts of the operators that need no session, against brute force."""

import io
import random

import numpy as np
import pytest

from patronage.llm import archive, fingerprint, packing, substring, token_counts, toxicity
from patronage.llm.common import ALNUM_SEPARATORS, SPACE_SEPARATORS, word_hashes


def test_word_hashes_equal_for_equal_words_in_any_place_and_block():
    text = "The the THE é É x" * 3 + " \t\n tail"
    h = word_hashes(text, SPACE_SEPARATORS)
    words = text.encode().lower().split()
    assert len(h) == len(words)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    assert (word_hashes(text, SPACE_SEPARATORS, size=5) == h).all()
    assert len(word_hashes("", SPACE_SEPARATORS)) == 0 and len(word_hashes(" .,", ALNUM_SEPARATORS)) == 0
    _, a, b = word_hashes(text, ALNUM_SEPARATORS, with_offsets=True)
    assert [text.encode()[i:j] for i, j in zip(a, b, strict=True)][:3] == [b"The", b"the", b"THE"]


def test_maximal_segments_match_the_definition():
    """Recursive definition: the best segment, then the same left and right of it."""
    def brute(s, at=0):
        best = max(((sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)),
                   key=lambda x: (x[0], -(x[2] - x[1])), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        _, i, j = best
        return [*brute(s[:i], at), (at + i, at + j), *brute(s[j:], at + j)]

    rng = random.Random(3)
    for _ in range(200):
        s = [rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 14))]
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(s)]
        assert got == brute(s)
        assert [(a, b) for a, b, _ in toxicity.segments_of(np.array(s))] == got


def test_lz78_and_edited_ending_match_a_plain_parse():
    def plain(t):
        seen, out, i = set(), [], 0
        while i < len(t):
            j = i + 1
            while j < len(t) and t[i:j] in seen:
                j += 1
            out.append(t[i:j])
            seen.add(t[i:j])
            i = j
        return out

    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))
        u = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 20)))
        k = rng.randint(0, len(t))
        assert fingerprint.lz78(t)[0] == plain(t)
        p = fingerprint.Parsed(t, k)
        assert (p.sig == fingerprint.signature(plain(t))).all()
        assert (p.with_ending(u) == fingerprint.signature(plain(t[:k] + u))).all()


def test_cut_covers_a_document_with_little_padding():
    padding = 0
    for n in range(1, 2049):
        pieces = packing.cut(n, 2048)
        assert sum(x for x, _ in pieces) == n and all(0 < x <= 2048 // k for x, k in pieces)
        padding += sum(2048 / k - x for x, k in pieces) / n
    assert padding / 2048 < 0.02
    assert packing.cut(5000, 2048)[:2] == [(2048, 1), (2048, 1)]


def test_first_fit_decreasing_is_gapless():
    at = packing.first_fit_decreasing([5, 9, 3, 3], 10)
    assert at == [(1, 0), (0, 0), (1, 5), (2, 0)]


def test_encoder_gives_the_ids_of_the_json_library():
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(token_counts.vocabulary_path())
    encode = packing.Encoder(packing.tiktoken_path(), {"<|endoftext|>": 50256})
    texts = ["", " ", "it's  <|endoftext|> 12ab\n\n  x\u00a0\u200b\u3000é 漢字 🙂", "'s" * 50, "ab" * 3000, "\x1c\x85\ufeff<|endof"]
    texts += ["".join(chr(c) for c in range(a, a + 64)) for a in range(0x20, 0xD000, 1999)]
    for t in texts:
        assert encode(t).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_safe_pieces_keep_the_token_count():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_counts.vocabulary_path())
    text = "it's a  test \n of 12 things, <|endoftext|> and more  é " * 20
    whole = len(t.encode(text, add_special_tokens=False))
    for size in (1, 7, 50):
        pieces = token_counts.safe_pieces(text, size)
        assert "".join(pieces) == text and len(pieces) > 3
        assert sum(len(t.encode(p, add_special_tokens=False)) for p in pieces) == whole


def test_arc_versions_round_trip_and_bad_lengths_fail():
    for version in (1, 2):
        data = archive.arc_version_block("a.arc", version, "20200101000000")
        data += archive.arc_record(version, "http://a.org/x y", "1.2.3.4", "20200102030405", "text/html",
                                   b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n<p>\nWARC/1.1\n", "a.arc")
        data += archive.arc_record(version, "dns:a.org", "1.2.3.4", "2020", "text/dns", b"", "a.arc")
        got = [archive.convert(r, "a.arc") for r in archive.parse_arc(io.BytesIO(data))]
        assert [c.kind for c in got] == ["warcinfo", "response", "resource"]
        assert got[1].page_id == 7 and got[1].payload == b"<p>\nWARC/1.1\n" and got[1].uri == "http://a.org/x%20y"
        assert got[1].date == "2020-01-02T03:04:05Z" and got[2].date == "2020-01-01T00:00:00Z"
        assert len({c.record_id for c in got}) == 3
        with pytest.raises(ValueError):
            list(archive.parse_arc(io.BytesIO(data[:-20])))
        with pytest.raises(ValueError):
            list(archive.parse_arc(io.BytesIO(data[5:])))


def test_chains_find_collinear_matches():
    x, y = np.array([0, 10, 20, 30, 30]), np.array([100, 110, 121, 131, 5])
    assert [c.tolist() for c in substring.chains(x, y)] == [[0, 1, 2, 3], [4]]
    covered, gaps = substring.gaps_of(x[:4], y[:4])
    assert covered == 32 and gaps == [(8, 10, 108, 110), (18, 20, 118, 121), (28, 30, 129, 131)]
    assert substring.aligned([1, 2, 3], [1, 9, 3]) == 2 and substring.extension([1, 1, 2], [1, 1, 3]) == (2, 2)


def test_cut_words():
    assert substring.cut_words("Aa, bb cc dd!", [{"start_word": 1, "end_word": 3}]) == "Aa, dd!"
    assert substring.cut_words("aa bb", [{"start_word": 0, "end_word": 2}]) == ""
    assert substring.cut_words(None, []) is None


def test_distinct_words_are_encoded_once_and_add_up():
    from tokenizers import Tokenizer

    from patronage.llm.token_counts import WordCounts, vocabulary_path
    tokenizer = Tokenizer.from_file(vocabulary_path())
    texts = ["the cat  the cat the  cat", " lead", "tail ", "", "a\n b\t c   d", "don't I'll we 've x  <|endoftext|> y<|endoftext|>",
             "été d'été é", "漢字 漢字", "   ", "1 22 333 , . !? 　 z", "the cat the dog"] * 3
    encoded = []

    def encode(words):
        encoded.extend(words)
        return tokenizer.encode_batch_fast(words, add_special_tokens=False)

    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    counts = WordCounts(encode)
    assert counts(texts) == want and counts(texts) == want
    assert len(encoded) == len(set(encoded))
    tight = WordCounts(encode, held_bytes=0)
    assert [tight([t])[0] for t in texts] == want and len(tight.known) < 10
