"""Plumbing shared by the operators: shared folders, Arrow batches, broadcast state.

Conventions that hold for every operator here:

* an operator names the columns that it reads and selects only those, so extra
  columns, or columns whose names clash with its outputs, never reach it;
* a null id is carried through as it is, a null text is stated in each docstring;
* Arrow batches are cut into slices of about ``SLICE_BYTES`` of text, so that the
  memory of a Python worker doesn't depend on the number of rows in a batch. A
  single text that is longer than that forms a slice of its own, and is whole.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a local folder is
    made and set for the session; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="textlab-")
    sc.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system; without one it is of Hadoop's default file system."""
    p, system = _hadoop(spark, path)
    return re.sub("^file:/+", "file:///", system.makeQualified(p).toString())


def drop_shared(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            p, system = _hadoop(spark, path)
            system.delete(p, True)


def kind_of(df: DataFrame, column: str) -> str:
    """A column's type as it is written in a schema: ids keep theirs."""
    return df.schema[column].dataType.simpleString()


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by the bytes of a string column; every slice has a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = offsets(batch.column(column))
        start = 0
        base = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            base = int(ends[stop - 1])
            start = stop


def offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings of an array, in bytes of ``data(column)``."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = at - at[0]
    return at[:-1], at[1:]


def data(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of a string array (nulls take none)."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)
    first, last = int(at[column.offset]), int(at[column.offset + len(column)])
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8)[first:last] if body is not None and last > first else np.zeros(0, np.uint8)


def over_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: int = 1, limit: int = SLICE_BYTES) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that applies ``fn`` to slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return run


def csr_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s : s + n]`` over all (s, n)."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return values[np.arange(total) + shift]
