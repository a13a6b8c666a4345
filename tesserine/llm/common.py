"""Helpers shared by the operators: column picking, row identity, lineage cuts and Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text turned into Python objects at a time.
SLICE = 256


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name and position, so other columns may have any names, clashing ones included.

    pick(df, doc_id="id", text="body") gives columns doc_id and text.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(name)}").alias(out) for out, name in wanted.items()])


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, as in tests, a local master gets a temporary folder.

    On a cluster a temporary folder would be another one on each machine, so there the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: a folder that all machines share is needed")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserine-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    path = f"{base.rstrip('/')}/tesserine-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None and spark.sparkContext._jsc is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and its size is known to the planner."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once all that reads them has been written itself. Others are left alone."""
    for table in tables:
        if (path := getattr(table, "_cut_path", None)) is not None:
            _remove(table.sparkSession, path)


def _is_scan(df: DataFrame) -> bool:
    """Whether df is one file scan with nothing but filters and projections above it, all of which a recomputation repeats.

    Only then do file and position name a row: a generator gives several rows one position, and a union, a join or a
    limit may do so too.
    """
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def with_row_key(df: DataFrame) -> DataFrame:
    """df as columns c0, c1, ... with a row identity (file_key, row_key) that no two rows share and a recomputation repeats.

    Rows of a file scan are named by file and position. Any other DataFrame is numbered once and written out; whoever
    needs the keys twice has to use the same result twice.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    if _is_scan(df):
        try:
            meta = df.select("*", "_metadata")
            named = meta.toDF(*plain.columns, "source_meta")
            return named.select(*plain.columns, F.xxhash64("source_meta.file_path").alias("file_key"), F.col("source_meta.row_index").alias("row_key"))
        except AnalysisException:
            pass
    return cut(plain.withColumns({"file_key": F.lit(0).cast("long"), "row_key": F.monotonically_increasing_id()}))


def without_rows(keyed: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of with_row_key() whose keys are not among gone (gone_file, gone_row), with their own column names."""
    left = keyed.join(gone, (F.col("file_key") == F.col("gone_file")) & (F.col("row_key") == F.col("gone_row")), "left_anti")
    return left.drop("file_key", "row_key").toDF(*columns)


def column_of(df: DataFrame, name: str) -> str:
    """The name that with_row_key gives to a column."""
    return f"c{df.columns.index(name)}"


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """malloc_trim of the C library, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def settle() -> None:
    """Hand freed memory back to the system: a worker lives on after its task, and what the C library keeps adds up."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def arrow_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list[list]], dict[str, list]]]) -> DataFrame:
    """Apply a function of column lists, made once for each task, to slices of SLICE rows."""
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    out = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_pydict(got, schema=out)
            settle()

    return df.mapInArrow(run, schema)
