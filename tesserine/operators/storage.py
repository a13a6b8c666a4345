"""Tables: guarded writing, lineage cuts, and broadcasts of checked size."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their JSON, up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, as in tests, a local master gets a temporary folder; a cluster needs the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if base is None:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir is not set: a folder that all machines share is needed")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tesserine-"))
        base = context._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again; the table goes when the interpreter ends."""
    spark, path = df.sparkSession, f"{_shared_folder(df.sparkSession)}/tesserine-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes, which are counted; otherwise the planner shuffles."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    told = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if told["n"] <= rows and told["bytes"] <= most_bytes else df


def save(df: DataFrame, path: str, overwrite: bool = False, by: list[str] | None = None) -> None:
    """Parquet; an existing table is an error unless overwrite says otherwise."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def open_table(spark, path: str) -> DataFrame:
    """The table at a path; FileNotFoundError if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)
