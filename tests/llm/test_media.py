import hashlib
import struct
import zlib

import numpy as np
import pytest
from llm_odd import ODD

from tarn.llm import media


def png(lines, kinds):
    """An image of given raw scanlines and filter types."""
    body = b"".join(bytes([k]) + bytes(x) for k, x in zip(kinds, lines, strict=True))
    head = struct.pack(">IIBBBBB", 64, len(kinds), 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(body)) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 200_000])
def test_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    assert media.decode_png(media.encode_png(payload, n)) == (payload, n)


def test_all_filters_are_undone():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (10, 64), np.uint8).astype(int)
    kinds = [3, 4, 0, 1, 2, 4, 4, 3, 2, 1]
    lines = []
    for y, k in enumerate(kinds):
        up = rows[y - 1] if y else np.zeros(64, int)
        left = np.concatenate([[0], rows[y][:-1]])
        corner = np.concatenate([[0], up[:-1]])
        p = left + up - corner
        paeth = [min(((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c)))[2] for q, a, b, c in zip(p, left, up, corner, strict=True)]
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(paeth)}[k]
        lines.append(((rows[y] - guess) % 256).astype(np.uint8))
    assert media.decode_png(png(lines, kinds))[0] == rows.astype(np.uint8).tobytes()


def test_damage_is_found():
    whole = media.encode_png(media.pad(b"abc" * 100), 300)
    for at in (3, 20, 45, len(whole) // 2, len(whole) - 2):
        with pytest.raises(ValueError):
            media.decode_png(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
    for cut in (8, 30, len(whole) - 12, len(whole) - 1):
        with pytest.raises(ValueError):
            media.decode_png(whole[:cut])


def test_hash_is_stable_under_small_changes():
    a = bytes((i * 37 // 11) % 256 for i in range(64 * 64))
    b = bytearray(a)
    b[100] ^= 4
    bits = lambda h: int(h, 16)
    assert (bits(media.cosine_hash(a)) ^ bits(media.cosine_hash(bytes(b)))).bit_count() <= 4
    assert media.cosine_hash(bytes(64)) == media.cosine_hash(bytes(64))


def test_columns(docs):
    df = docs(list(enumerate(ODD))).withColumnRenamed("text", "Text").selectExpr("*", "1 AS Media", "2 AS n_bytes")
    stored = media.encode_media(df, "Text")
    assert [c for c in stored.columns if c.lower() == "media"] == ["media"]
    rows = media.media_features(stored).orderBy("doc_id").collect()
    for r, text in zip(rows, ODD, strict=True):
        raw = (text or "").encode()
        payload = media.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert rows[9].feature == rows[10].feature
    assert [r.decoded_text for r in media.decode_media(stored).orderBy("doc_id").collect()] == [t or "" for t in ODD]
    assert media.media_features(media.encode_media(docs([]))).count() == 0


def test_hash_against_a_plain_cosine_transform():
    """The bits are the signs, against their median, of a two-dimensional cosine transform written out."""
    rng = np.random.default_rng(3)
    for rows in (1, 5, 32, 100):
        payload = rng.integers(0, 256, rows * 64).astype(np.uint8).tobytes()
        image = np.frombuffer(payload, np.uint8).reshape(rows, 64).astype(float)
        pairs = image[:, ::2] + image[:, 1::2]
        if rows < 32:
            small = np.array([pairs[i * rows // 32] for i in range(32)])
        else:
            edges = [i * rows // 32 for i in range(33)]
            small = np.array([pairs[a:b].mean(axis=0) for a, b in zip(edges, edges[1:], strict=False)])
        low = np.array([[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
        low[0] = 0
        median = np.median(low[1:])
        got = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(payload)), np.uint8)).astype(bool)
        # Integers round; only a frequency that all but equals the median may fall on its other side.
        sure = np.abs(low - median) > 1e-3 * np.abs(low).max()
        assert (got == (low > median))[sure].all() and sure.sum() >= (60 if rows >= 32 else 7)
