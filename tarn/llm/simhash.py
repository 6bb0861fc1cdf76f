"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; two link when at most ``bits`` differ. Cut into
``blocks`` blocks, linked fingerprints agree on at least blocks - bits of them,
so every choice of that many blocks is a key under which some linked pair meets;
distances are then verified. Equal fingerprints are one node from the start, so
copies never meet in pairs. Within a key only a spanning forest is kept: a node
is compared with nodes not yet reached, and each that it reaches is linked once.
Components come from rounds of star contraction, stored after each round.

The number of blocks follows the number of fingerprints, so that a key has about
one unrelated fingerprint at any size; every number gives the same links.

``without_near_duplicates`` asks for a similarity of word shingles instead of a
few bits. Texts of Jaccard similarity s differ in a share acos(2s / (1 + s)) / pi
of their SimHash bits, 15 % at 0.8, which no choice of all but that many blocks
can tell from chance. So it takes WIDE bits in blocks of two, and a number of
keys, each a fixed choice of blocks, such that a pair at the similarity asked for
meets with probability RECALL; the verified distance decides, with a radius of
MARGIN deviations over the expected distance. The bits of a key follow the number
of fingerprints and the number of keys follows those bits, so that RECALL is the
same at any size.

Defined cases: a null or wordless text has fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; texts of any length
are read whole; null ids are never the smallest id of a component (null if all
are) and stay last; of equal ids the row read first stays; repeated rows are
nodes of one component; an empty table gives an empty table; other columns,
whatever their names, come back unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, arrow_map, delete, release, rows_of, stored
from .shelf import Shelf

BITS = 4
SHINGLE = 4
SEED = 42
#: Bits of a fingerprint for similarities, the similarity, the words of a shingle, and the share of pairs at that similarity that meet.
WIDE = 256
SIMILARITY = 0.8
WORDS = 5
RECALL = 0.95
#: Deviations of a distance over its mean that still count: nine of ten pairs at the similarity are within.
MARGIN = 1.28


def shingle_hashes(text: str | bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[lo : lo + 8192].byteswap().view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles."""
    return majority(shingle_hashes(text, shingle))


def wide_fingerprint(text: str | bytes | None, shingle: int = WORDS) -> bytes:
    """SimHash of WIDE bits: each further 64 come from the shingles' hashes mixed anew."""
    hashes = shingle_hashes(text, shingle)
    out = []
    for k in range(WIDE // 64):
        h = hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(h ^ (h >> np.uint64(31))))
    return np.array(out, "<i8").tobytes()


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "simhash", shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of each text as a signed long."""

    def make(texts: list) -> list[list]:
        return [[fingerprint(t, shingle) for t in texts]]

    return add_columns(df, text, [T.StructField(out, T.LongType())], make)


def block_masks(blocks: int, bits: int = BITS) -> list[int]:
    """Masks of every choice of blocks - bits blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in pairwise(cuts)]
    return [sum(c) for c in combinations(block, blocks - bits)]


def blocks_for(n: int, bits: int = BITS) -> int:
    """The least number of blocks whose keys hold about one of n spread fingerprints."""
    return next((b for b in range(bits + 2, bits + 6) if n <= 2 ** (64 * (b - bits) // b + 1)), bits + 6)


def _forest(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (as indices) of a spanning forest of the link graph of fingerprints, one to a row of words."""
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1, dtype=np.int64) <= bits
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), at), found
                queue.extend(found)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns (longs) in tables that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        ends = np.flatnonzero((key != key[:, -1:]).any(axis=0))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        # What is held has one key: it is over if this batch starts with another.
        if held and any(held[-1].column(i)[-1].as_py() != key[i, 0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _linked(start: np.ndarray, size: np.ndarray, fps: np.ndarray, node: np.ndarray, bits: int) -> pa.RecordBatch:
    """Linked pairs of nodes within runs of rows that share a key."""
    two = start[size == 2]
    ok = two[np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1, dtype=np.int64) <= bits]
    found = [(ok, ok + 1)]
    for lo, n in zip(start[size > 2], size[size > 2], strict=True):
        found += [(lo + a, lo + b) for a, b in _forest(fps[lo : lo + n], bits)]
    a, b = (node[np.concatenate([f[i] for f in found])] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _starts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and how long they are."""
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    start = np.flatnonzero(change)
    return start, np.diff(np.append(start, len(change)))


def link_forest(fps: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """Linked pairs (a, b) of a one-column table of distinct fingerprints, enough to connect each component."""
    masks = block_masks(blocks_for(n, bits), bits)
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    name = fps.columns[0]
    keyed = fps.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col(name).bitwiseAND(F.lit(m)).alias("key"), F.col(name).alias("fp")) for i, m in enumerate(signed)])).alias("k")
    ).select("k.choice", "k.key", "k.fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, 2):
            choice, key, fp = (table.column(i).to_numpy() for i in range(3))
            yield _linked(*_starts(choice, key), fp.view(np.uint64).reshape(-1, 1), fp, bits)

    dealt = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
    return arrow_map(dealt, run, "a long, b long").distinct()


def share_of_bits(similarity: float) -> float:
    """The share of SimHash bits in which two sets of one size and a Jaccard similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float) -> int:
    """Differing bits, of WIDE, up to which fingerprints are taken to have the similarity."""
    p = share_of_bits(similarity)
    return int(WIDE * p + MARGIN * math.sqrt(WIDE * p * (1 - p)))


def wide_keys(n: int, similarity: float, recall: float = RECALL) -> np.ndarray:
    """Rows of bit positions, one row a key, for n fingerprints."""
    blocks = min(20, max(6, math.ceil(math.log2(max(n, 2)) / 2)))
    meets = (1 - share_of_bits(similarity)) ** (2 * blocks)
    count = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    rng = np.random.default_rng(SEED)
    chosen = np.array([rng.choice(WIDE // 2, blocks, replace=False) for _ in range(count)])
    return np.stack([2 * chosen, 2 * chosen + 1], axis=2).reshape(count, 2 * blocks)


def wide_links(nodes: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """Linked pairs (a, b) of nodes (node, fp) with distinct wide fingerprints: a spanning forest for each key."""
    chosen, radius = wide_keys(n, similarity), radius_of(similarity)
    count, size = chosen.shape
    weights = np.int64(1) << np.arange(size, dtype=np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fps = batch.column(1).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, WIDE // 8), axis=1)
            # One column a key: its number, then its bits.
            keys = np.stack([(np.int64(k) << 40) + bits[:, own].astype(np.int64) @ weights for k, own in enumerate(chosen)], axis=1)
            node = batch.column(0).to_numpy().repeat(count)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), pa.array([f for f in fps for _ in range(count)], pa.binary())], names=["key", "node", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, 1):
            fps = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint64).reshape(-1, WIDE // 64)
            yield _linked(*_starts(table.column(0).to_numpy()), fps, table.column(1).to_numpy(), radius)

    dealt = arrow_map(nodes.select("node", "fp"), keyed, "key long, node long, fp binary").repartition("key").sortWithinPartitions("key", "node")
    return arrow_map(dealt, run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; root is the least node of a component.

    Rounds of large-star and small-star contraction, each written to the shared
    folder; the work of a round is two aggregations and two joins on edges. The
    least neighbours are written before they are joined, so that the rows of a
    node with many edges can be split among tasks.
    """
    spark = edges.sparkSession
    now, path = stored(edges.filter("a <> b"), "edges")
    was = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low, low_path = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down, down_path = stored(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
        least, least_path = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        following, new_path = stored(small, "edges")
        sums = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for folder in (path, low_path, down_path, least_path):
            delete(spark, folder)
        now, path = following, new_path
        if sums == was or not sums[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = sums


def _named(nodes: DataFrame, links: DataFrame, key: str, least: str) -> DataFrame:
    """Stored (key, least of the component) of nodes with a column ``least``, by linked pairs of keys."""
    spark = nodes.sparkSession
    roots = components(links).toDF(key, "root")
    placed, placed_path = stored(nodes.join(roots, key, "left").select(key, least, F.coalesce("root", key).alias("root")), "placed")
    # Written first: the rows of a large component can then be split among tasks.
    smallest, smallest_path = stored(placed.groupBy("root").agg(F.min(least).alias("found")), "smallest")
    named, _ = stored(placed.join(smallest, "root").select(key, F.col("found").alias(least)), "named")
    for folder in (placed_path, smallest_path):
        delete(spark, folder)
    release(spark)
    return named


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row of df."""
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked, _ = stored(with_fingerprint(own, "text", "fp", shingle).drop("text"), "simhash")
    nodes, nodes_path = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "nodes")
    named = _named(nodes, link_forest(nodes.select("fp"), nodes.count(), bits), "fp", "component_id")
    delete(df.sparkSession, nodes_path)
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(df: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS) -> DataFrame:
    """df (doc_id, text and any others) with one row of each component: that of the least id."""
    shelf = Shelf(df)
    own = next(c for c in shelf.names if c.lower() == "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fps = [wide_fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["row", "id", "fp"])

    rows = shelf.rows.select("row", F.col("rest").getField(own).cast("long").alias("id"), "text")
    marked, marked_path = stored(arrow_map(rows, run, "row long, id long, fp binary"), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes, nodes_path = stored(marked.groupBy("fp").agg(F.min("row").alias("node"), first), "nodes")
    named = _named(nodes.select("node", "first"), wide_links(nodes, nodes.count(), similarity), "node", "first")
    stays, _ = stored(named.select("first.row").distinct(), "stays")

    def make(rows: pa.RecordBatch, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from .shelf import conform

        at = pa.array(np.searchsorted(rows.column(0).to_numpy(), asked.column("row").to_numpy()))
        target = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([conform(rows.column(i).take(at), f.type) for i, f in zip((1, 2), target, strict=True)], schema=target)

    schema = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("rest", shelf.rest_type())])
    done = shelf.visit(stays, make, schema, columns=("text", "rest"))
    for folder in (marked_path, nodes_path):
        delete(df.sparkSession, folder)
    release(df.sparkSession)
    return done.select(*[done["text"].cast("string").alias(c) if c.lower() == "text" else done["rest"].getField(c).alias(c) for c in df.columns])
