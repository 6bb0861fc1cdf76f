import random
import zlib
from itertools import groupby

import numpy as np
import pytest
from llm_odd import ODD

from tarn.llm import packing

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("byte_bpe_50k.json")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MODEL)
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß漢 \n1.") for _ in range(rng.randint(1, 9)))
    return [*ODD, "<|endoftext|> hello", "a <|endoftext|><|endoftext|>\nb <|endoftext", "<|endoftext|>", *(" ".join(word() for _ in range(rng.choice((3, 50, 400, 3000)))) for _ in range(60))]


def test_encoder_equals_the_library():
    own = packing.Encoder(MODEL, P.PATTERN)
    rows = texts()
    for _ in range(2):
        got = [list(np.frombuffer(b, "<u4")) + [0] for b in own.encode(rows)]
        assert got == reference(rows)


def test_cuts():
    assert packing.cut(0) == [] and packing.cut(5) == [(0, 5)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


def sequential(lengths, capacity):
    """Number of sequences of best-fit, longest first, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("capacity", [16, 100])
def test_rounds_against_sequential_best_fit(capacity):
    """Rounds pack all pieces, and into as many sequences as one piece at a time does, but for one more now and then."""
    rng, more = random.Random(capacity), 0
    for _ in range(60):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        plan = packing.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
        ordered = sorted(lengths, reverse=True)
        filled = {}
        for rank, n, first, offset in plan.tolist():
            for k in range(n):
                filled.setdefault(first + k, []).append((offset, ordered[rank + k]))
        assert sum(map(len, filled.values())) == len(lengths)
        for spots in filled.values():
            at = 0
            for offset, n in sorted(spots):
                assert offset == at
                at += n
            assert at <= capacity
        assert 0 <= len(filled) - -(-sum(lengths) // capacity)
        more += len(filled) - sequential(lengths, capacity)
        assert len(filled) <= sequential(lengths, capacity) + 1
    assert more <= 2


def test_query(docs):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "again"), (3, "again")]
    got = packing.pack(docs(rows).selectExpr("*", "1 AS piece", "2 AS length"), MODEL, P.PATTERN).collect()
    ids = reference([t for _, t in rows])
    want = sorted(repr((d, i, lo, n, zlib.crc32(np.array(x[lo : lo + n], "<u4").tobytes()))) for (d, _), x in zip(rows, ids, strict=True) for i, (lo, n) in enumerate(packing.cut(len(x))))
    assert sorted(repr(tuple(r)[:5]) for r in got) == want
    for _, spots in groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in spots:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    lengths = [r.length for r in got]
    assert len({r.sequence_id for r in got}) <= sequential(lengths, 2048) + 1
    assert packing.pack(docs([]), MODEL, P.PATTERN).count() == 0


def test_many_pieces_of_one_length_and_clashing_columns(docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = [(i, "one two three") for i in range(90)] + [(100, "word " * 30_000)]
    names = ["salt", "parts", "k", "length", "piece", "sequence_id", "offset"]
    got = packing.pack(docs(rows).selectExpr("*", *[f"'x' AS {n}" for n in names]), MODEL, P.PATTERN, capacity=64).collect()
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(set(places)) == len(places) and {r.doc_id for r in got} == {d for d, _ in rows}
    whole = sorted((r.start, r.length) for r in got if r.doc_id == 100)
    assert whole[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(whole, whole[1:], strict=False))
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 64)
