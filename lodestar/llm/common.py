"""Staging, keys and Arrow helpers shared by the operators of this subpackage.

Every operator takes and returns DataFrames. Rows of ``documents`` are identified by ``(doc_id, xxhash64(text))``: a
null id counts as the smallest one, and repeated rows (same id, same text) all get the same result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEAST_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session on one machine gets one of its own; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        sc.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


#: Shuffle files of a query go when it ends, not when the driver happens to collect garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The shuffle files of what led to it are freed at once; the table is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """df, an aggregate by long keys, for a join on them with many rows a key.

    Spark would keep the aggregate's partitioning and deal the large side to match it, hot keys and all. With keys it can't trace
    back, it deals both sides for the join alone, and adaptive execution may split a hot key among tasks.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(id, th, text, more...): the key of a document row and its text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"), *more
    )


def real_id(column: str = "id") -> Column:
    return F.when(F.col(column) != LEAST_ID, F.col(column)).alias("doc_id")


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from all its values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def each(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow from one that takes a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return run


def whole_groups(key: str, f: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow over rows sorted by a long column: f gets tables that never cut a group, and where groups begin (and end)."""

    def cut(t: pa.Table, last: bool) -> tuple[int, np.ndarray]:
        k = t[key].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return (len(k), np.append(begin, len(k))) if last else (int(begin[-1]), begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held and held[-1][key][-1].as_py() == b[key][-1].as_py():
                held.append(b)  # the open group goes on
                continue
            t = pa.Table.from_batches([*held, b])
            upto, begin = cut(t, last=False)
            if upto:
                yield from f(t.slice(0, upto), begin)
            held = t.slice(upto).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from f(t, cut(t, last=True)[1])

    return run
