import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from driftlens.llm import bpe
from driftlens.llm.pretokens import pieces

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def test_same_ids_as_the_library_and_exact_round_trip(codec):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "a" * 3000, "ab" * 700, "日本語テキスト" * 50, "é́ x²½ ١٢٣", "  \n\n\t x  y   z", "<|endoftext|> it's we'll", "=====-----" * 60, "🙂👍🏽" * 20]
    texts += ["aaaaabaaaa" * 400, "th" * 30_000, "=" * 50_000, "漢字テキスト" * 3000, "".join(chr(97 + rng.randrange(26)) for _ in range(50_000)), "abcabcab" * 999]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(600)), "Erste Zeile\nzweite Zeile, und mehr."]
    for text, (ids, back) in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text), text[:40]
        assert back.decode() == text


def test_what_is_remembered_is_bounded_and_makes_no_difference(codec, monkeypatch):
    texts = [" ".join(f"word{k * j}x" for k in range(300)) for j in range(1, 6)]
    want = [list(codec.encode([t])) for t in texts]
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 50)
    assert [list(codec.encode([t])) for t in texts] == want
    assert codec.held < 200_000


def test_short_words_with_runs(codec):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(9)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for letters in ("ab", "a", "ao", "the", "nan", "ssi", "=", "日本") for _ in range(400)}
    for text, (ids, back) in zip(words, codec.encode(list(words)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text) and back.decode() == text, text


def test_tokens_that_must_be_contracted_alone():
    """With abc before ab, but b c never merged, (ab, c) has a lower rank than ab has."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257}
    assert bpe._passes(ranks, [b"a", b"b", b"a"]) and 257 in bpe._alone(ranks)


def test_pieces_split_as_the_text_does():
    pattern, rng = regex.compile(P.PATTERN), random.Random(1)
    letters = [" ", "\n", "a", "é", ",", "1", "'s", "\t", "\xa0", "日", "_", "²"]
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
        assert [w for p in pieces(text, pattern) for w in pattern.findall(p)] == pattern.findall(text), repr(text)


def test_query_over_odd_rows(odd, none):
    rows = bpe.bpe_digests(odd, PATH).collect()
    assert len(rows) == 12
    assert {r.ids_sha256 for r in rows if r.doc_id in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    back = {r.doc_id: r.decoded for r in bpe.encode_decode(odd, PATH).collect()}
    assert back[7] == "日本語 текст émoji 🙂🙂 ① ²"
    assert bpe.bpe_digests(none, PATH).count() == 0
