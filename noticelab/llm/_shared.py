"""Folders that all executors share, tables written there, and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of strings and binaries in one frame that a Python function gets, unless a single row has more.
CUT_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master (tests) gets a temporary folder and a
    cluster gets a folder beside its warehouse, which executors share too.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    own = getattr(sc, "_noticelab_shared", None)
    if own is None:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            path = tempfile.mkdtemp(prefix="noticelab-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            own = f"file://{path}"
        else:
            own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        sc._noticelab_shared = own
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: The tables written since each `swept` block began, the innermost last.
_SWEPT: list[list[str]] = []


def written(df: DataFrame, label: str, outside: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage
    is cut and a lost executor costs nothing but the tasks it was running.  It
    outlives the innermost `swept` block if asked."""
    spark = df.sparkSession
    path = new_path(spark, label)
    scopes = _SWEPT[:-1] if outside else _SWEPT
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that `written` returned."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, folders) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Tables that `written` makes inside are deleted at the end; what is to
    stay must be written outside, or be in files of its own."""
    _SWEPT.append([])
    try:
        yield
    finally:
        _delete(spark, _SWEPT.pop())


def pieces(batch: pa.RecordBatch, most: int = CUT_BYTES):
    """A batch in slices of neighbouring rows with about `most` bytes of strings and binaries."""
    sizes = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    limits = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(limits[:-1], limits[1:]):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives as long as its
    executor, and what one task needed would be kept from all that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_INTEGERS = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}


def map_frames(df: DataFrame, function, schema: str, most: int = CUT_BYTES) -> DataFrame:
    """df.mapInPandas(function, schema), with frames bounded in bytes instead of
    rows.  Integers are nullable ones, so that a missing id costs no digits."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches):
        try:
            frames = (x.to_pandas(types_mapper=_INTEGERS.get) for batch in batches for x in pieces(batch, most))
            for out in function(frames):
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)
        finally:
            give_back()

    return df.mapInArrow(mapped, schema)


def with_columns(df: DataFrame, text: str, function, added: str, keep: list[str] | None = None, most: int = CUT_BYTES) -> DataFrame:
    """The columns `keep` of df (all, if not given) and those that function
    computes from a list of texts, in the order of `added`.  Columns of those
    names are replaced, others go through as they are; no row is shuffled."""
    new = StructType.fromDDL(added)
    types, taken = to_arrow_schema(new).types, {f.name.lower() for f in new.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    columns = [F.col(f"`{c}`") for c in kept]
    own = df.select(*columns) if text in kept else df.select(*columns, F.col(f"`{text}`"))
    at, n = own.columns.index(text), len(kept)
    schema = StructType([*df.select(*columns).schema.fields, *new.fields])
    names = schema.names

    def mapped(batches):
        try:
            for batch in batches:
                for piece in pieces(batch, most):
                    got = function(piece.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays([*piece.columns[:n], *(pa.array(x, t) for x, t in zip(got, types))], names=names)
        finally:
            give_back()

    return own.mapInArrow(mapped, schema)


def filesystem(uri: str):
    """(file system, path) for a file:, hdfs:, s3: or gs: address or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def put_file(uri: str, data: bytes) -> None:
    """Write a file in full under its final name only once it is complete."""
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with system.open_output_stream(partial, compression=None) as out:
        out.write(data)
    system.move(partial, path)


def get_file(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
