import hashlib
import random

import pytest
from llm_odd import ODD

from tarn.llm import bpe

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(RANKS, P.PATTERN).rank, special_tokens={})


def test_random_texts_equal_the_library():
    rng, own, other = random.Random(5), bpe.codec(RANKS, P.PATTERN), library()
    for alphabet in ("ab the", "éß漢😀 x", "abcdefghijklmnopqrstuvwxyz", "0123456789 .,", " \n\t"):
        for n in (0, 1, 2, 7, 40, 127, 128, 129, 130, 600):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            (ids,) = own.encode([text])
            assert ids == other.encode_ordinary(text)
            assert own.decode(ids).decode() == text


def test_both_ways_of_merging_agree():
    own = bpe.codec(RANKS, P.PATTERN)
    rng = random.Random(6)
    for _ in range(200):
        data = bytes(rng.choice(b"abethinr ") for _ in range(rng.randint(2, 128)))
        assert own._alone(data) == own._together([data, b"xx"], 128)[0]


def test_a_long_piece_is_fast():
    import time

    own = bpe.codec(RANKS, P.PATTERN)
    text = "thequickbrownfox" * 20_000
    began = time.monotonic()
    (ids,) = own.encode([text])
    assert time.monotonic() - began < 30 and own.decode(ids).decode() == text


def test_columns(docs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3)
    other = library()
    df = docs(list(enumerate(ODD))).selectExpr("*", "5 AS N_TOKENS", "'k' AS parts_", "'k' AS score")
    for r, text in zip(bpe.digests(df, RANKS, P.PATTERN).orderBy("doc_id").collect(), ODD, strict=True):
        ids = other.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r.parts_, r.score) == ("k", "k")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
    both = bpe.decode_column(bpe.encode_column(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    assert bpe.digests(docs([]), RANKS, P.PATTERN).count() == 0
