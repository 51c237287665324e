"""What the training-data operators share: shipping code, shared folders, Arrow batches."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch going back to the JVM closes at about this many bytes.
OUT_BYTES = 8 << 20

#: Bytes of a batch that goes to Python, where the session has Spark's own default: both sides hold a batch or two of each task.
IN_BYTES, BATCH_SETTING, DEFAULT_BYTES = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64MB", "64m")

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application; they may not have it on their path. Bounds the batches that they get."""
    if spark.conf.get(BATCH_SETTING) in DEFAULT_BYTES:
        spark.conf.set(BATCH_SETTING, str(IN_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) gets one of its own where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and later branches do not compute it twice."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _scopes:
        _scopes[-1].append(path)
    return out


_scopes: list[list[str]] = []


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        path = t if isinstance(t, str) else t.scratch_path
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        for scope in _scopes:
            if path in scope:
                scope.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """At its end the tables written in it are deleted, but those given to the function that it yields: these pass to the scope around it, if there is one."""
    made, kept = [], []
    _scopes.append(made)
    try:
        yield lambda *tables: kept.extend(t.scratch_path for t in tables)
    finally:
        _scopes.pop()
        dropped(spark, *(x for x in made if x not in kept))
        if _scopes:
            _scopes[-1].extend(kept)


def texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that clashing extra columns never reach it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable], ship_code: bool = True) -> DataFrame:
    """mapInArrow over rows. start() runs once a task and returns f(*columns of a row) -> an output row, an iterable of rows, or None."""
    if ship_code:
        ship(df.sparkSession)
    return df.mapInArrow(_RowMapper(start, schema_of(schema)), schema)


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class _RowMapper:
    def __init__(self, start: Callable[[], Callable], schema: pa.Schema):
        self.start, self.schema = start, schema

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _kept()["used"] = False
        f = self.start()
        if not _kept()["used"]:
            forget()
        end = getattr(f, "end", None)

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        out = f(*row)
                        if isinstance(out, tuple):
                            yield out
                        elif out is not None:
                            yield from out
            if end is not None:
                yield from end()

        yield from batched(rows(), self.schema)


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += 64
        for x in row:
            if isinstance(x, (str, bytes, list, tuple)):
                weight += 8 * len(x) if isinstance(x, (list, tuple)) else len(x)
            elif hasattr(x, "nbytes"):
                weight += x.nbytes
        if weight >= OUT_BYTES or len(held) >= 20_000:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _kept() -> dict:
    return sys.modules.setdefault("_tidemark_kept", type(sys)("_tidemark_kept")).__dict__


def forget() -> None:
    """Frees what the worker keeps: a task that does not use it begins. The tables and their memos refer to each other, so they are collected at once."""
    if _kept().pop("newest", None) is not None:
        gc.collect()


def once(key: object, make: Callable[[], object]) -> object:
    """A value kept in this Python worker under key. Only the newest is kept, and only while tasks use it: a worker that serves one query after the other holds the tables of one."""
    kept = _kept()
    if kept.get("newest", (None,))[0] != key:
        forget()  # before the new one is made
        kept["newest"] = (key, make())
    kept["used"] = True
    return kept["newest"][1]
