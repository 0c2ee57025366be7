"""Shared helpers: staged tables in the cluster's shared folder, Arrow batches, what a worker remembers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. A machine-local one is used in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/flowloom"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, so lost executors cost one task each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column begins with, for columns of an operator's own beside the caller's."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete the folder when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later read needs, and have the driver drop the shuffle files of what it no longer refers to."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Bound an Arrow batch, as texts may be long. The options hold for the session from then on: a result that is not yet computed
    needs them when it is."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = re.match(r"\d+", spark.conf.get(key))  # one has a unit behind it
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


_MEMO: dict[Hashable, Any] = {}


def worker_memo(key: Hashable, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker between tasks. Workers go from one operator to the next, so that the memo of one
    goes when another asks for its own. What make() returns has to bound its size for itself, in bytes."""
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = make()
    return _MEMO[key]


def forget() -> None:
    """Of operators that keep nothing: leave a worker without the memo of others."""
    _MEMO.clear()


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, binary: tuple[str, ...] = (), memo: bool = False) -> DataFrame:
    """mapInArrow with columns as Python lists; those in `binary` arrive as UTF-8 bytes. memo: fn uses worker_memo()."""
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    struct = _parse_datatype_string(schema)
    names = [f.name for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not memo:
            forget()
        out_schema = to_arrow_schema(struct)
        for batch in batches:
            cols = {n: (batch.column(i).cast(pa.binary()) if n in binary else batch.column(i)).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = fn(cols)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=out_schema.field(n).type) for n in names], schema=out_schema)

    return df.mapInArrow(run, struct)
