"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a scratch folder; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    target.getFileSystem(conf).deleteOnExit(target)
    return path


#: Rows of a file of narrow rows, about, where their number is known beforehand.
FILE_ROWS = 20_000


def stored(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """Compute ``df`` once into Parquet in the shared folder and continue from there.

    Cuts the lineage, survives lost executors, and later reads prune columns and push
    filters down. ``rows``, if given, is the most that ``df`` can have: a small table of narrow rows
    then makes few files. Every file costs its executor up to three child processes on a local folder.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
