"""Best-fit packing of token sequences in bulk-synchronous rounds over length classes.

Documents are encoded, closed with an end id, and cut into pieces of at most
CAPACITY tokens. Pieces are range-sorted by length, longest first, which gives
each a rank. Pieces of one length are alike, and so are gaps of one size, so the
rounds work on classes: at most CAPACITY lengths and as many gaps at any input.
A round sweeps the sorted gaps once for the successor of each length, the least
gap that holds it; where several lengths ask for one gap, its gaps go to their
pieces by rank; pieces without any gap open sequences, all those over half of
CAPACITY or else the longest length; then the gaps that are left and made are
sorted anew for the next round. What a round decides is a run of ranks and a run
of sequences. The classes are on the driver: there are about as many rounds as
different lengths (1,428 for the 1,883 lengths of 11,562 pieces), and as Spark jobs
each would be two shuffles of a table of a few kilobytes. Ranking the pieces and
finding their places is distributed.

Defined cases: a null or empty text is the end id alone; a text that spells an
added token gets that token's id, as the library gives it; equal pieces and those
of repeated rows take ranks in a fixed order, each its own place; only documents
over CAPACITY tokens are cut, and only their first piece may be shorter; texts of
any length are encoded whole; an empty table gives no pieces; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, rows_of, stored

CAPACITY = 2048
END = 0
#: Pieces of one length that are ranked together, about.
RANKED = 1 << 17
#: Bytes of pieces of text and their ids that a worker remembers before it starts anew, about.
CACHE_BYTES = 160 << 20
#: Words that are encoded in one text.
WORDS = 256


class Encoder:
    """Ids of texts by the tokenizers library, remembered for each match of its splitting pattern.

    The byte-level model splits a text by the pattern and merges inside each
    match alone, so a match has the same ids wherever it stands. A text that holds
    an added token, such as an end mark, goes to the library as a whole.
    """

    def __init__(self, path: str, pattern: str):
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Tokens that the library takes out of a text before it splits the rest.
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.size = np.ones(1, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that each id stands for: the characters of its byte-level token."""
        if len(self.size) == 1:
            named = self.model.get_vocab(with_added_tokens=False)
            self.size = np.zeros(max(named.values()) + 1, np.int64)
            for token, i in named.items():
                self.size[i] = len(token)
        return self.size[ids]

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of new matches.

        Words after a space are encoded many to a text, since the pattern splits
        them there again; where ids don't end with a word, that text's words are
        encoded one by one, as all other matches are.
        """
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        alone = [p for p in new if not (p[0] == " " and p[1:].isalpha())]
        groups = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
        for group, ids in zip(groups, self._ids(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum([len(p.encode()) for p in group])
            done = np.cumsum(self._bytes_of(ids))
            at = np.searchsorted(done, ends)
            if len(ids) and at[-1] < len(done) and np.array_equal(done[at], ends):
                data, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
                self.known.update(zip(group, (data[a:b] for a, b in zip([0, *cuts], cuts)), strict=True))
            else:
                alone += group
        self.known.update(zip(alone, (i.tobytes() for i in self._ids(alone)), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        whole = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        split = [self.split(t) if t else [] for t in texts]
        for i in whole:
            split[i] = []
        if new := set().union(*split).difference(self.known):
            self.learn(list(new))
            # Keys and values as Python holds them, about.
            self.held += sum(150 + 5 * len(p) for p in new)
        ids = self.known.__getitem__
        out = [b"".join(map(ids, pieces)) for pieces in split]
        for i in whole:
            out[i] = self._ids([texts[i]])[0].tobytes()
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes what is left over."""
    first = total % capacity or capacity if total else 0
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))] if total else []


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of every document of docs (doc_id, text)."""
    close = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in rows_of(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                ids += close
                for i, (lo, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, i, lo, n, zlib.crc32(ids[4 * lo : 4 * (lo + n)])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE, strict=True)] if rows else [pa.array([], f.type) for f in PIECE], schema=PIECE)

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (first rank, pieces, first sequence, offset) that place counts[n] pieces of each length n, by rank.

    Ranks go from the longest pieces to the shortest.
    """
    left = np.asarray(counts, np.int64).copy()
    left[0] = 0
    size = np.arange(capacity + 1)
    rank = np.cumsum(left[::-1])[::-1] - left
    have = np.zeros(capacity + 1, np.int64)
    #: Runs (first sequence, sequences) by gap.
    runs: list[list[tuple[int, int]]] = [[] for _ in size]
    rows, opened = [], 0

    def place(length: int, n: int, gap: int, sequence: int) -> None:
        rows.append((int(rank[length]), n, sequence, capacity - gap))
        rank[length] += n
        left[length] -= n

    while left.any():
        made: list[tuple[int, int, int]] = []
        # One sweep from the largest size down: the least gap at or above each size.
        successor = np.minimum.accumulate(np.where(have > 0, size, capacity + 1)[::-1])[::-1]
        longest_first = np.flatnonzero(left)[::-1]
        fits = successor[longest_first] <= capacity
        asking, alone = longest_first[fits], longest_first[~fits]
        if len(asking):
            # Lengths that ask for one gap follow each other; those before get theirs first.
            gap, wanted = successor[asking], left[asking]
            before = np.cumsum(wanted) - wanted
            given = np.clip(have[gap] - (before - before[np.searchsorted(-gap, -gap)]), 0, wanted)
            for length, g, n in zip(asking.tolist(), gap.tolist(), given.tolist(), strict=True):
                have[g] -= n
                while n:
                    sequence, there = runs[g].pop()
                    some = min(n, there)
                    if some < there:
                        runs[g].append((sequence + some, there - some))
                    place(length, some, g, sequence)
                    made.append((g - length, sequence, some))
                    n -= some
        large = alone[2 * alone > capacity]
        for length in (large if len(large) else alone[:1]).tolist():
            layers = capacity // length
            n, gap, sequence = -(-int(left[length]) // layers), capacity, opened
            opened += n
            for _ in range(layers):
                some = min(n, int(left[length]))
                place(length, some, gap, sequence)
                made.append((gap, sequence + some, n - some))
                n, gap = some, gap - length
            made.append((gap, sequence, n))
        # What was made in a round can be asked for in the next.
        for gap, sequence, n in made:
            if gap and n:
                have[gap] += n
                runs[gap].append((sequence, n))
    return np.array(sorted(r for r in rows if r[1]), np.int64).reshape(-1, 4)


def packed(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with sequence_id and offset."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    spark = cuts.sparkSession
    # One row for each length: at most CAPACITY, at any input.
    counts = {r.length: r["count"] for r in cuts.groupBy("length").count().collect()}
    # A length is ranked in parts, as many as its pieces need.
    parts = {n: -(-c // RANKED) for n, c in counts.items()}
    salts = spark.createDataFrame([(n, k) for n, k in parts.items()], "length long, parts long")
    salted = cuts.join(F.broadcast(salts), "length").select(*[f.name for f in PIECE], F.pmod(F.xxhash64(*order), F.col("parts")).cast("int").alias("salt"))
    # One row for each part: at most CAPACITY and one in RANKED pieces.
    seen = salted.groupBy("length", "salt").count().toPandas()
    table = np.zeros((capacity + 1, max(parts.values(), default=1)), np.int64)
    table[seen["length"].to_numpy(np.int64), seen["salt"].to_numpy(np.int64)] = seen["count"].to_numpy(np.int64)
    longest_first = table[::-1].ravel()
    base = (np.cumsum(longest_first) - longest_first).reshape(table.shape)[::-1].copy()
    plan = best_fit(table.sum(axis=1), capacity)
    ranged = salted.repartitionByRange(F.desc("length"), F.asc("salt"))
    numbered = ranged.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)))
    schema = PIECE.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6))
            rank = base[length, salt] + k - 1
            at = np.searchsorted(plan[:, 0], rank, side="right") - 1
            sequence = plan[at, 2] + rank - plan[at, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(plan[at, 3])], schema=schema)

    return arrow_map(numbered, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Encodes, cuts and packs docs (doc_id, text)."""
    return packed(stored(pieces(docs, path, pattern, capacity, end), "pieces")[0], capacity)
