"""Removal of long repeated passages with a logarithmic family of suffix arrays.

A byte is removed when a string of LENGTH bytes that covers it starts anywhere
else too. The suffix arrays are sparse: a suffix is kept where it begins with the
least hashed SEED-gram of some window of LENGTH bytes, which depends on the
window's bytes alone, so equal windows meet at equal suffixes. The windows that
share an anchor form one stretch of text; an entry of the array is the anchor's
fingerprint, the stretch's fingerprint, and how often that pair occurs. Arrays
are ordered by fingerprint, so that a merge scan is a sort-merge operation.

A batch becomes an array of level 0. On arrival it is scanned against itself and
all levels present: the anchors that occur twice once it is there are stored as
its matches. Then, while two arrays have one level, they merge into the next, so
an entry is rewritten a logarithmic number of times. An anchor that occurs twice
is among the matches of the last batch that holds it, so the matches of all
batches are all long matches.

Every stretch has one of three fates: its anchor occurs once (no window of it
repeats), the whole stretch occurs twice (all do), or its anchor occurs in
different stretches. Only the last are refined, with one representative of each
stretch that occurs twice, by the same rule at each of the sizes CELLS: a
stretch is cut into cells of neighbouring windows at fixed distances from the
anchor; the bytes that all windows of a cell share are its core, those that any
of them has its extent. A cell whose core occurs once has no window that repeats
and is dropped; one whose extent occurs twice is done; what is left holds the
end of a match and goes to the next size, of which the last is one window. So a
stretch gives a few rows for each end of a match in it, whatever the number of
stretches with its anchor, and no task gets a group.

Texts stay on a shelf: only numbers and fingerprints are shuffled.

Defined cases: a null text is empty (and stays null where nothing is cut); texts
under LENGTH bytes lose nothing; a repeated row is another occurrence of its
text, so long texts that occur twice lose all bytes; runs of one byte are handled
like other text; texts of any length are cut into chunks that overlap, which does
not change what is found; an empty table gives an empty table; other columns,
whatever their names, come back unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, delete, fresh, release, rows_of, stored
from .shelf import Shelf, conform

LENGTH = 200
SEED = 32
CHUNK = 1 << 21
#: Windows of a cell, from the first cut of a stretch to single windows; each divides the one before it.
CELLS = (16, 4, 1)
#: Batches that a one-off query deals its table into.
BATCHES = 3
_P = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 14, 2 * len(self.up))
            for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Rolling:
    """Hashes of any substrings of bytes, after one pass."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers.to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def all(self, size: int) -> np.ndarray:
        """Hashes of the substrings of one size, by start."""
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    m = -(-len(x) // w) * w
    blocks = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(anchor, stretch, place) of every stretch of windows that share an anchor.

    A place is start << 16 | (anchor's position - start) << 8 | windows - 1.
    """
    found = []
    for lo in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[lo : lo + CHUNK + length - 1]
        rolling = Rolling(part)
        grams = rolling.all(seed)
        order = np.arange(len(grams), dtype=np.uint64)
        at = (_least((grams & ~_LOW) | order, length - seed + 1) & _LOW).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        size = np.diff(np.append(start, len(at)))
        shape = (at[start] - start) << 8 | (size - 1)
        text = rolling.hash(start, start + size + length - 1)
        found.append((grams[at[start]], _mix(text ^ _mix(shape.astype(np.uint64))), (start + lo) << 16 | shape))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def cells(at: np.ndarray, dist: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(parent, at, dist, size) of the cells of runs of windows.

    A run starts at byte ``at``, ``dist`` before the anchor, and has ``size``
    windows. A cell holds the windows whose distances have one quotient by width.
    """
    first, last = dist // width, (dist - size + 1) // width
    count = first - last + 1
    parent = np.repeat(np.arange(len(at)), count)
    step = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
    quotient = first[parent] - step
    top = np.minimum(dist[parent], quotient * width + width - 1)
    bottom = np.maximum((dist - size + 1)[parent], quotient * width)
    return parent, at[parent] + dist[parent] - top, top, top - bottom + 1


def fingerprints(rolling: Rolling, at: np.ndarray, dist: np.ndarray, size: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Core and extent of each cell."""
    quotient = dist // width
    anchor = at + dist
    core = rolling.hash(anchor - quotient * width, anchor - (quotient * width + width - 1) + length)
    extent = rolling.hash(at, at + size - 1 + length)
    shape = (dist << 16 | size << 8 | width).astype(np.uint64)
    return _mix(core ^ _mix((quotient << 16 | width).astype(np.uint64))), _mix(extent ^ _mix(shape))


def _bytes(text: str | bytes | None) -> np.ndarray:
    return np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _signed(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(values).astype(np.uint64).view(np.int64)) if values else pa.array([], pa.int64())


def _longs(arrays: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=names.replace(" long", "").split(", "))


def entries(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, stretch, n): stretches of a one-column table, counted by batch of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [stretches(_bytes(t), length, seed) for t in batch.column(0).to_pylist()]
            anchor, stretch = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
            order = np.lexsort((stretch, anchor))
            anchor, stretch = anchor[order], stretch[order]
            first = np.flatnonzero((np.diff(anchor, prepend=0) != 0) | (np.diff(stretch, prepend=0) != 0)) if len(anchor) else order
            first = np.union1d(first, [0]) if len(anchor) else first
            yield _longs([anchor[first], stretch[first], np.diff(np.append(first, len(anchor)))], ENTRY)

    return arrow_map(texts, run, ENTRY)


ENTRY = "anchor long, stretch long, n long"
PLACES = "row long, anchor long, stretch long, place long"


def places(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """Every stretch with its row and place; rows has row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [stretches(_bytes(t), length, seed) for t in batch.column(1).to_pylist()]
            count = np.array([len(f[0]) for f in found], np.int64)
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)
            yield _longs([row, *(_signed([f[i] for f in found]) for i in range(3))], PLACES)

    return arrow_map(rows.select("row", "text"), run, PLACES)


class SuffixIndex:
    """A family of suffix arrays in the shared folder, of levels that double in batches."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, seed: int = SEED):
        if not 0 < seed <= length:
            raise ValueError("a seed is part of a match")
        self.spark, self.length, self.seed = spark, length, seed
        #: (level, array, folder), highest level first.
        self.arrays: list[tuple[int, DataFrame, str]] = []
        #: (anchors, folder) that each batch was found to share, on arrival, with itself and the levels.
        self.matches: list[tuple[DataFrame, str]] = []

    def _store(self, rows: DataFrame) -> tuple[DataFrame, str]:
        return stored(rows.sortWithinPartitions("anchor", "stretch"), "suffixes")

    def add(self, texts: DataFrame) -> None:
        """Adds a batch (one column of texts) as an array of level 0, scans it against the levels, and merges equal ones."""
        new, path = self._store(entries(texts, self.length, self.seed).groupBy("anchor", "stretch").agg(F.sum("n").alias("n")))
        self.matches.append(stored(self._scanned(new), "matches"))
        self.arrays.append((0, new, path))
        while len(self.arrays) > 1 and self.arrays[-1][0] == self.arrays[-2][0]:
            (level, a, at), (_, b, bt) = self.arrays[-2:]
            merged = a.union(b).groupBy("anchor", "stretch").agg(F.sum("n").alias("n"))
            self.arrays[-2:] = [(level + 1, *self._store(merged))]
            for path in (at, bt):
                delete(self.spark, path)
        release(self.spark)

    def _scanned(self, new: DataFrame) -> DataFrame:
        """Anchors of a new array that occur twice in it and the levels; counts meet, not entries."""
        both = new.select("anchor", "n", F.lit(1).alias("fresh"))
        for _, old, _ in self.arrays:
            both = both.union(old.select("anchor", "n", F.lit(0)))
        return both.groupBy("anchor").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh")).filter("n >= 2 and fresh = 1").select("anchor")

    def entries(self) -> DataFrame:
        """Entries of all levels, merged."""
        rows = self.arrays[0][1]
        for _, more, _ in self.arrays[1:]:
            rows = rows.union(more)
        return rows.groupBy("anchor", "stretch").agg(F.sum("n").alias("n")) if len(self.arrays) > 1 else rows

    def fates(self) -> DataFrame:
        """(anchor, stretch, n) of the entries that a match reaches."""
        anchors = self.matches[0][0]
        for more, _ in self.matches[1:]:
            anchors = anchors.union(more)
        rows = self.arrays[0][1]
        for _, more, _ in self.arrays[1:]:
            rows = rows.union(more)
        return rows.join(anchors.distinct(), "anchor", "left_semi").groupBy("anchor", "stretch").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        for path in [a[2] for a in self.arrays] + [m[1] for m in self.matches]:
            delete(self.spark, path)
        self.arrays, self.matches = [], []


def _with_kinds(counts: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """counts (key, another, n) of the keys that occur twice, with the number of kinds of each key; and the folders that it reads.

    Both sides are written before they are joined, so that a key of many kinds can
    be split among tasks.
    """
    counts, path = stored(counts, "counts")
    twice, twice_path = stored(counts.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).filter("total >= 2").drop("total"), "twice")
    return counts.join(twice, key), [path, twice_path]


RUN = "row long, at long, dist long, size long"
CELL = RUN + ", core long, extent long"


def _cut(shelf: Shelf, runs: DataFrame, width: int, length: int) -> DataFrame:
    """The cells of runs of windows, with their fingerprints."""

    def make(rows: pa.RecordBatch, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        row, at, dist, size = (asked.column(c).to_numpy() for c in ("row", "at", "dist", "size"))
        number, texts = rows.column(0).to_numpy(), rows.column(1)
        found = []
        # Runs come sorted by row and byte; those of one row and chunk share their sums.
        part = row * 0 + at // CHUNK
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        for lo, hi in zip(first, [*first[1:], len(row)], strict=True):
            data = _bytes(texts[int(np.searchsorted(number, row[lo]))].as_py())
            begin = int(part[lo]) * CHUNK
            rolling = Rolling(data[begin : begin + CHUNK + 2 * length + 256])
            _, a, d, n = cells(at[lo:hi] - begin, dist[lo:hi], size[lo:hi], width)
            core, extent = fingerprints(rolling, a, d, n, width, length)
            found.append((np.full(len(a), row[lo]), a + begin, d, n, core.view(np.int64), extent.view(np.int64)))
        if found:
            yield _longs([np.concatenate([f[i] for f in found]) for i in range(6)], CELL)

    return shelf.visit(runs, make, CELL)


def _refined(shelf: Shelf, runs: DataFrame, width: int, length: int) -> tuple[DataFrame, DataFrame, str]:
    """(row, at, size) of cells all of whose windows repeat, runs that are left, and the folder that both read."""
    cut, cut_path = stored(_cut(shelf, runs, width, length), "cells")
    counts, paths = _with_kinds(cut.groupBy("core", "extent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("first")), "core")
    near = cut.join(counts, ["core", "extent"]).filter("n >= 2 or kinds >= 2")
    again = (F.col("kinds") >= 2) & ((F.col("n") == 1) | (F.col("first") == F.struct("row", "at")))
    judged, path = stored(near.select("row", "at", "dist", "size", (F.col("n") >= 2).alias("done"), again.alias("again")), "judged")
    for folder in (cut_path, *paths):
        delete(shelf.spark, folder)
    return judged.filter("done").select("row", "at", "size"), judged.filter("again").select("row", "at", "dist", "size"), path


def repeated_ranges(shelf: Shelf, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES) -> DataFrame:
    """Stored (row, at, size) of runs of windows that repeat, overlapping and in any order."""
    if length - seed + 1 > 256:
        raise ValueError("a stretch has at most 256 windows")
    index = SuffixIndex(shelf.spark, length, seed)
    for i in range(batches):
        index.add(shelf.batch(i, batches).select("text"))
    fates, paths = _with_kinds(index.fates(), "anchor")
    index.drop()
    release(shelf.spark)
    found = places(shelf.rows, length, seed).join(fates, ["anchor", "stretch"])
    # Fingerprints are needed once more only where an anchor has several kinds.
    several = F.col("kinds") >= 2
    hits, hits_path = stored(found.select("row", "place", "n", "kinds", *[F.when(several, F.col(c)).alias(c) for c in ("anchor", "stretch")]), "hits")
    for folder in paths:
        delete(shelf.spark, folder)
    release(shelf.spark)
    run = ["row", F.shiftright("place", 16).alias("at"), F.shiftright("place", 8).bitwiseAND(F.lit(255)).alias("dist"), (F.col("place").bitwiseAND(F.lit(255)) + 1).alias("size")]
    found = hits.filter("n >= 2").select(run[0], run[1], run[3])
    # One of each stretch that occurs twice stands for it in what follows.
    mixed = hits.filter("kinds >= 2")
    one = mixed.filter("n >= 2").groupBy("anchor", "stretch").agg(F.min(F.struct("row", "place")).alias("s")).select("s.*")
    left, folders = mixed.filter("n = 1").select("row", "place").union(one).select(*run), [hits_path]
    for width in CELLS:
        done, left, path = _refined(shelf, left, width, length)
        found, folders = found.union(done), [*folders, path]
        release(shelf.spark)
    ranges, _ = stored(found, "ranges")
    for folder in folders:
        delete(shelf.spark, folder)
    return ranges


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of byte ranges, in order."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]])) if len(lo) else np.zeros(0, np.int64)
    return lo[first], reach[np.append(first[1:], len(lo)) - 1] if len(lo) else hi


def kept(data: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """The bytes outside of maximal runs."""
    ends = zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True)
    return b"".join(data[a:b] for a, b in ends)


def _treated(df: DataFrame, fields: list[T.StructField], one: Callable, **options: int) -> DataFrame:
    """Columns of df but for its text, and the fields that one(bytes or None, lo, hi) gives each row.

    It is computed where it is read, from what stays in the shared folder.
    """
    length = options.get("length", LENGTH)
    shelf = Shelf(df)
    if not shelf.files:
        return df.sparkSession.createDataFrame([], T.StructType([*[df.schema[c] for c in shelf.names], *fields]))
    ranges = repeated_ranges(shelf, **options)
    schema = T.StructType([T.StructField("rest", shelf.rest_type()), *fields])

    def make(rows: pa.RecordBatch, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        row, at, size = (asked.column(c).to_numpy() for c in ("row", "at", "size"))
        number = rows.column(0).to_numpy()
        begin, end = np.searchsorted(row, number), np.searchsorted(row, number, side="right")
        made = [one(t, *merged(at[a:b], at[a:b] + size[a:b] + length - 1)) for t, a, b in zip(rows.column(1).to_pylist(), begin, end, strict=True)]
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(target)[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([conform(rows.column(2), target.field(0).type), *arrays], schema=target)

    return shelf.restored(shelf.visit(ranges, make, schema, columns=("text", "rest"), every=True), *[f.name for f in fields])


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
]


def measured(df: DataFrame, **options: int) -> DataFrame:
    """doc_id and what removal does to each row of df (doc_id, text)."""

    def one(text: bytes | None, lo: np.ndarray, hi: np.ndarray) -> tuple:
        data = text or b""
        return len(data), int((hi - lo).sum()), len(lo), hashlib.sha256(kept(data, lo, hi)).hexdigest()

    return _treated(df.select("doc_id", "text"), FIELDS, one, **options)


def without_repeats(df: DataFrame, **options: int) -> DataFrame:
    """df (doc_id, text and any others) with the repeated bytes cut out of the texts.

    A character that loses some of its bytes goes as a whole.
    """

    def one(text: bytes | None, lo: np.ndarray, hi: np.ndarray) -> tuple:
        return (text.decode("utf-8", "ignore") if not len(lo) else kept(text, lo, hi).decode("utf-8", "ignore")) if text is not None else None,

    own = next(c for c in df.columns if c.lower() == "text")
    hidden = fresh("text", df.columns)
    done = _treated(df, [T.StructField(hidden, T.StringType())], one, **options)
    return done.select(*[done[hidden].alias(c) if c == own else done[f"`{c}`"] for c in df.columns])
