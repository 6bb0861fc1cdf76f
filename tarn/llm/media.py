"""Media columns: bytes kept as PNG images in binary columns, with perceptual hashes.

A payload becomes an 8-bit grey image of 64 samples a row. The writer picks a
scanline filter for each row and cuts the zlib stream into IDAT chunks; the
reader tests every chunk's checksum, inflates, and undoes the filters with
numpy. The feature is the sign pattern of the low-frequency part of a
two-dimensional cosine transform, in integers, so that equal images have equal
hashes on any machine.

Defined cases: a null or empty text is the payload of 64 zero bytes; texts of
any length are one image; repeated rows give repeated results; of scanline
filters that tie the first is taken, and a frequency equal to the median counts
as not above it, so equal payloads have equal images and hashes; columns of the
input with an output's name are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTH = 64
CHUNK = 1 << 15
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE = 32
LOW = 8
_K = np.arange(SIDE)
#: Rows of the cosine basis, scaled to integers.
BASIS = np.rint(4096 * np.cos(np.pi * np.outer(np.arange(LOW), 2 * _K + 1) / (2 * SIDE))).astype(np.int64)


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Scanlines led by their filter type: none, sub or up, whichever has the least absolute sum."""
    n = len(rows)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int32)
    kind = cost.argmin(axis=0)
    lines = np.empty((n, WIDTH + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind, np.arange(n)]
    return lines


def encode_png(payload: bytes, length: int) -> bytes:
    """A grey PNG of a padded payload; ``length`` is kept in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = zlib.compress(_filtered(rows).tobytes(), 1)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))]
    out.append(_chunk(b"tEXt", b"Length\0" + str(length).encode()))
    out += [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def _paeth(a: int, b: int, c: int) -> int:
    near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))
    return near[0][2]


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of scanlines; runs of one filter type are undone together."""
    kind, data = lines[:, 0], lines[:, 1:]
    if kind.max(initial=0) > 4:
        raise ValueError("unknown scanline filter")
    out = np.empty_like(data)
    edges = np.flatnonzero(np.diff(kind)) + 1
    above = np.zeros(data.shape[1], np.uint8)
    for lo, hi in zip([0, *edges], [*edges, len(lines)], strict=True):
        run = data[lo:hi]
        if kind[lo] == 0:
            out[lo:hi] = run
        elif kind[lo] == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind[lo] == 2:
            np.cumsum(run, axis=0, dtype=np.uint8, out=out[lo:hi])
            out[lo:hi] += above
        else:
            for y in range(lo, hi):
                left = corner = 0
                for x, v in enumerate(data[y].tolist()):
                    up = int(above[x])
                    guess = (left + up) // 2 if kind[lo] == 3 else _paeth(left, up, corner)
                    left, corner = (v + guess) & 255, up
                    out[y, x] = left
                above = out[y]
        above = out[hi - 1]
    return out


def decode_png(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of a stored image; raises ValueError if damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, length, height, ended = 8, [], None, 0, False
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("the image is cut off")
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if width != WIDTH or rest != [8, 0, 0, 0, 0]:
                raise ValueError("unsupported image kind")
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if not ended:
        raise ValueError("the image has no end")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != height * (WIDTH + 1):
        raise ValueError("image size")
    payload = unfilter(np.frombuffer(raw, np.uint8).reshape(height, WIDTH + 1)).tobytes()
    return payload, len(payload) if length is None else length


def cosine_hash(payload: bytes) -> str:
    """16 hex digits: signs, against their median, of the low frequencies without the mean."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    pairs = rows.reshape(len(rows), SIDE, 2).sum(axis=2, dtype=np.int64)
    if len(pairs) < SIDE:
        small = 512 * pairs[np.arange(SIDE) * len(pairs) // SIDE]
    else:
        edges = np.arange(SIDE + 1) * len(pairs) // SIDE
        small = 512 * np.add.reduceat(pairs, edges[:-1]) // np.diff(edges)[:, None]
    low = (BASIS @ small @ BASIS.T).ravel()
    low[0] = 0
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds a binary column with the PNG of each text's UTF-8 bytes."""
    from .common import add_columns

    def make(texts: list) -> list[list]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return [[encode_png(pad(b), len(b)) for b in raw]]

    return add_columns(df, text, [T.StructField(media, T.BinaryType())], make)


FEATURES = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads stored images back: sizes, digests and the perceptual hash (null image: nulls)."""
    from .common import add_columns

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * len(FEATURES)
        payload, n = decode_png(m)
        digest = hashlib.sha256
        return n, len(payload), digest(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), digest(m).hexdigest(), cosine_hash(payload)

    def make(stored: list) -> list[list]:
        return [list(c) for c in zip(*map(one, stored), strict=True)] if stored else [[] for _ in FEATURES]

    return add_columns(df, media, FEATURES, make)


def decode_media(df: DataFrame, media: str = "media", text: str = "decoded_text") -> DataFrame:
    """Adds the text that a stored image holds."""
    from .common import add_columns

    def make(stored: list) -> list[list]:
        read = [decode_png(m) if m is not None else None for m in stored]
        return [[r and r[0][: r[1]].decode("utf-8", "surrogatepass") for r in read]]

    return add_columns(df, media, [T.StructField(text, T.StringType())], make)
