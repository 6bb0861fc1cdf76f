"""Shared helpers: tables, Arrow column operators, and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one output batch.
SLICE_ROWS = 512
#: Bytes of one input batch, unless the session sets fewer.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whole text of every document, null text read as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS."""
    # The system's allocator gives large buffers back at once; Arrow's own keeps them.
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers through Spark's file server, once for each application."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="tarn-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with the session's Arrow batches bounded to BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    ship(spark)
    return df.mapInArrow(run, schema)


def add_columns(
    df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[list], list[list]]
) -> DataFrame:
    """df with new columns that ``make`` computes from one column, by Arrow batch.

    ``make`` gets the values of ``column`` and returns one list for each field.
    A column of df whose name (in any case) is that of a new field is replaced.
    """
    new = {f.name.lower() for f in fields}
    if column.lower() in new:
        raise ValueError(f"the input column {column!r} cannot also be an output")
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in new])
    schema = T.StructType([*kept.schema.fields, *fields])
    at = [c.lower() for c in kept.columns].index(column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(T.StructType(fields))
        for batch in rows_of(batches):
            made = make(batch.column(at).to_pylist())
            arrays = [pa.array(v, type=f.type) for v, f in zip(made, target, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *target.names])

    return arrow_map(kept, run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset in a local session, as in tests, a temporary folder is
    made and set as the checkpoint folder of the session; a cluster has no folder
    to guess, so it is an error there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarn-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    _scratches.discard(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Folders that operators made and that may still be read.
_scratches: set[str] = set()


@contextmanager
def swept(spark: SparkSession):
    """Deletes at the end what operators left in the shared folder meanwhile, but for the folders added to the list that it gives."""
    before, kept = set(_scratches), []
    try:
        yield kept
    finally:
        for path in _scratches - before - set(kept):
            delete(spark, path)


#: Folders that the last stage left, of which its result may still be computed.
_left: set[str] = set()


def stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stage before it left in the shared folder.

    A stage gets rows that were written and read again, so what the one before it
    left is no longer needed; where its rows do come from there, it stays.
    """

    @wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left.intersection_update(_scratches)
        if _left and not any(path.rpartition("/")[2] in f for f in docs.inputFiles() for path in _left):
            for path in list(_left):
                delete(spark, path)
        _left.clear()
        before = set(_scratches)
        found = run(spark, docs, sf_dir)
        _left.update(_scratches - before)
        return found

    return staged


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tarn-{what}-{uuid.uuid4().hex}"
    _scratches.add(path)

    def end() -> None:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc() is not None:
            try:
                delete(spark, path)
            except Exception:  # the session is closing; the folder stays
                return

    atexit.register(end)
    return path


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again; lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of plans that nothing refers to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A struct that carries all columns of a table past an operator.
BOX = "box_of_columns"


def boxed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of df and a struct of all its columns, so that none of them can clash with an operator's names."""
    return df.select(*[df[f"`{c}`"].alias(c) for c in needed], F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias(BOX))


def unboxed(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that boxed() put away, some of them changed (by name in lower case)."""
    return df.select(*[changed.get(c.lower(), F.col(BOX).getField(c)).alias(c) for c in names])


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that none of the taken ones equals."""
    lower = {t.lower() for t in taken}
    return next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}") not in lower)
