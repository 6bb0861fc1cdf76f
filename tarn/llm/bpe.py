"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The tree stands over the byte positions of a piece (a match of the splitting
pattern). A live position holds the rank of the pair of its token and the next
live token, joined with the position, so that the root is the leftmost pair of
the least rank. A merge changes three leaves (the merged token, the position
that died, and the live neighbour before it), each updated up its path.

Short pieces of one size class share one array of trees, so that a step merges
in all of them at once; long pieces use one tree each. Pieces are independent,
so their ids are remembered, up to about CACHE_BYTES for each worker.

Defined cases: a null or empty text has no ids; any bytes decode back exactly;
a text without white space is one long piece and takes n log n steps; repeated
rows give repeated results; other columns come back unchanged, but those with the
names of new ones (in any case) are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of pieces and ids that a worker remembers before it starts anew, about.
CACHE_BYTES = 120 << 20
#: Pieces of up to this many bytes are merged in step with others.
SHORT = 128
#: Bytes of the trees that are merged in step.
LANES = 1 << 20
NONE = np.int64(1) << 60


class Codec:
    """Ranks of a vocabulary file (base64 token and rank on each line) and its encoder."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.token = {i: b for b, i in self.rank.items()}
        self.digits = {i: str(i) for i in self.token}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.base = max(self.token) + 1
        rank, base = self.rank, self.base
        pairs = {}
        for whole, i in rank.items():
            for cut in range(1, len(whole)):
                a, b = rank.get(whole[:cut]), rank.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a * base + b] = i
        self.pair = pairs
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _together(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Ids of pieces of at most ``size`` bytes (a power of two), merged in step."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        place = np.arange(size)
        token = np.full((n, size + 1), -1, np.int64)
        token[:, :size] = np.where(place < lengths[:, None], self.byte[raw], -1)
        after = np.minimum(place + 1, lengths[:, None])
        after = np.concatenate([np.where(after == lengths[:, None], size, after), np.full((n, 1), size)], axis=1)
        before = np.concatenate([np.tile(np.arange(-1, size - 1), (n, 1)), np.full((n, 1), -1)], axis=1)
        tree = np.full((n, 2 * size), NONE, np.int64)
        pair = self._pair_rank(token[:, : size - 1], token[:, 1:size])
        pair[token[:, 1:size] < 0] = NONE
        tree[:, size : 2 * size - 1] = np.where(pair < NONE, pair * size + place[:-1], NONE)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            rank, at = np.divmod(tree[live, 1], size)
            gone = after[live, at]
            follows = after[live, gone]
            token[live, at] = rank
            token[live, gone] = -1
            after[live, at] = follows
            before[live, follows] = at
            ahead = before[live, at]
            tree[live, size + gone] = NONE
            right = self._pair_rank(rank, token[live, follows])
            right[follows == size] = NONE
            tree[live, size + at] = np.where(right < NONE, right * size + at, NONE)
            left = self._pair_rank(token[live, ahead], rank)
            left[ahead < 0] = NONE
            spot = np.where(ahead < 0, at, ahead)
            tree[live, size + spot] = np.where(ahead < 0, tree[live, size + spot], np.where(left < NONE, left * size + ahead, NONE))
            for leaf in (gone, at, spot):
                node = (size + leaf) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE]
        rows = token[:, :size].tolist()
        return [tuple(i for i in row if i >= 0) for row in rows]

    def _alone(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one long piece."""
        n, base, pair = len(piece), self.base, self.pair
        size = 1 << (n - 1).bit_length()
        none = int(NONE)
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            j = after[i]
            rank = pair.get(token[i] * base + token[j]) if j < n else None
            return none if rank is None else rank * size + i

        tree[size : size + n] = [leaf(i) for i in range(n)]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            token[at], token[gone] = rank, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            changed = [(gone, none), (at, leaf(at))]
            if before[at] >= 0:
                changed.append((before[at], leaf(before[at])))
            for i, value in changed:
                node = size + i
                tree[node] = value
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    tree[node] = a if a < b else b
        return tuple(i for i in token if i >= 0)

    def learn(self, pieces: set[str]) -> None:
        """Remembers the ids of the pieces that are new."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if (whole := self.rank.get(data)) is not None:
                self.known[piece] = (whole,)
            elif len(data) > SHORT:
                self.known[piece] = self._alone(data)
            else:
                classes.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for size, found in classes.items():
            step = max(1, LANES // size)
            for lo in range(0, len(found), step):
                part = found[lo : lo + step]
                for (piece, _), ids in zip(part, self._together([d for _, d in part], size), strict=True):
                    self.known[piece] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null is empty."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known) if split else set()
        if new:
            self.learn(new)
            # Keys and lists of ids as Python holds them, about.
            self.held += sum(200 + 10 * len(p) for p in new)
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, built once for each worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text as an array."""
    from .common import add_columns

    def make(texts: list) -> list[list]:
        return [codec(path, pattern).encode(texts)]

    return add_columns(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that each array of ids stands for (null: empty)."""
    from .common import add_columns

    def make(rows: list) -> list[list]:
        return [[codec(path, pattern).decode(r or []) for r in rows]]

    return add_columns(df, ids, [T.StructField(decoded, T.BinaryType())], make)


DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds the number and digest of each text's ids, and the digest of what they decode to."""
    from .common import add_columns

    def make(texts: list) -> list[list]:
        own = codec(path, pattern)
        digits, sha = own.digits.__getitem__, hashlib.sha256
        rows = own.encode(texts)
        return [
            [len(r) for r in rows],
            [sha(" ".join(map(digits, r)).encode()).hexdigest() for r in rows],
            [sha(own.decode(r)).hexdigest() for r in rows],
        ]

    return add_columns(df, text, DIGESTS, make)
