"""Rows kept in numbered files, so that small tables visit texts instead of moving them.

A shelf writes a table to the shared folder once. Every row has a number: the
number of its file << 33 | its place in the file, so that rows of one file lie in
order. A table keyed by row number, however it came about, goes to one task for
each file, which reads that file beside it: texts are never shuffled. A task
that runs again reads the same files, as only what Spark commits is listed.

Columns of the table beside the text travel in one struct, so that no name of
theirs can clash with a name used here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, arrow_map, delete, scratch

#: Bytes of a row group, which a reader holds at once.
GROUP_BYTES = 8 << 20


def open_store(uri: str):
    """File system and path of a folder or file, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def _file_rows(uri: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(SLICE_ROWS, columns=columns):
            if batch.num_rows:
                yield batch


def _meet(batches: Iterator[pa.RecordBatch], named: str, columns: list[str], every: bool) -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
    """Batches of file rows, each with what is asked of them; both sides are read once, in order.

    The first column of what is asked is the row number; the second is -1 in the
    row that stands before what is asked of a file.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    rows: Iterator[pa.RecordBatch] = iter(())
    now, asked, schema = None, [], None

    def end() -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
        if now is not None and (asked or every):
            yield now, pa.Table.from_batches(asked, schema)
        if every:
            for batch in rows:
                yield batch, pa.Table.from_batches([], schema)

    for batch in batches:
        schema = batch.schema
        mark = batch.column(1).to_numpy()
        marks = np.flatnonzero(mark < 0).tolist()
        ends = [0, *marks, batch.num_rows]
        for at, to in zip(ends, ends[1:], strict=False):
            part = batch.slice(at, to - at)
            if to > at and mark[at] < 0:
                yield from end()
                rows, now, asked = _file_rows(named.format(part.column(0)[0].as_py() >> 33), columns), None, []
                part = part.slice(1)
            while part.num_rows:
                if now is None:
                    now = next(rows)
                n = int(np.searchsorted(part.column(0).to_numpy(), now.column(0)[-1].as_py(), side="right"))
                if n:
                    asked.append(part.slice(0, n))
                    part = part.slice(n)
                if part.num_rows:
                    if asked or every:
                        yield now, pa.Table.from_batches(asked, schema)
                    now, asked = None, []
    yield from end()


class Shelf:
    """A table (text and any others) in the shared folder as ``row``, ``text`` (bytes) and ``rest``."""

    def __init__(self, df: DataFrame, text: str = "text"):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, "shelf")
        self.names = [c for c in df.columns if c.lower() != text.lower()]
        rest = F.struct(*[df[f"`{c}`"].alias(c) for c in self.names]) if self.names else F.struct(F.lit(True).alias("none"))
        made = df.select(F.monotonically_increasing_id().alias("row"), df[f"`{text}`"].cast("binary").alias("text"), rest.alias("rest"))
        made.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).option("maxRecordsPerFile", 0).parquet(self.path)
        self.schema = made.schema
        self.rows = self.spark.read.schema(made.schema).parquet(self.path)
        #: Files by number. Their names differ in it alone.
        self.files = {int(uri.rpartition("/part-")[2].split("-")[0]): uri for uri in self.rows.inputFiles()}
        folder, _, name = next(iter(self.files.values()), "").rpartition("/part-")
        self.named = f"{folder}/part-{{:05d}}-{name.partition('-')[2]}"
        if any(self.named.format(k) != uri for k, uri in self.files.items()):
            raise RuntimeError(f"unexpected names of files in {self.path}")

    def batch(self, i: int, n: int) -> DataFrame:
        """The rows of every n-th file from the i-th on."""
        own = [uri for k, uri in self.files.items() if k % n == i]
        return self.spark.read.schema(self.schema).parquet(*own) if own else self.rows.limit(0)

    def visit(self, asked: DataFrame, make: Callable[[pa.RecordBatch, pa.Table], Iterator[pa.RecordBatch]], schema: str | T.StructType, columns: tuple[str, ...] = ("text",), every: bool = False, opened: Callable | None = None) -> DataFrame:
        """What make(rows, asked) returns for batches of rows and the asked rows that belong to them.

        ``asked`` starts with the column ``row`` and holds longs; rows of a file come
        in order, and what is asked of a row is sorted by all its columns. Rows of
        which nothing is asked may be left out, unless ``every`` is set. make gets
        tables of (row, *columns) and (row, mark, *others), where mark is zero, and
        what the context ``opened()`` of a task gives, if there is one.
        """
        if not self.files:
            return self.spark.createDataFrame([], schema)
        others = asked.columns[1:]
        marks = self.spark.createDataFrame([(k << 33,) for k in self.files], "row long").select("row", F.lit(-1).alias("mark"), *[F.lit(-1).cast("long").alias(c) for c in others])
        both = marks.union(asked.select("row", F.lit(0), *others))
        dealt = both.repartitionById(max(self.files) + 1, F.shiftright("row", 33).cast("int"))
        ordered = dealt.sortWithinPartitions("row", "mark", *others)
        named, wanted = self.named, ["row", *columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with opened() if opened else nullcontext() as held:
                for rows, own in _meet(batches, named, wanted, every):
                    yield from make(rows, own, held) if opened else make(rows, own)

        return arrow_map(ordered, run, schema)

    def rest_type(self) -> T.DataType:
        return self.schema["rest"].dataType

    def restored(self, df: DataFrame, *more: str) -> DataFrame:
        """df (rest and others) with the columns of the table in place of ``rest``, then others by name."""
        return df.select(*[df["rest"].getField(c).alias(c) for c in self.names], *[df[c] for c in more])

    def drop(self) -> None:
        delete(self.spark, self.path)


def conform(column: pa.Array, target: pa.DataType) -> pa.Array:
    """A column as Parquet gives it in the Arrow type that Spark expects."""
    return column if column.type.equals(target) else column.cast(target)
