"""Session helpers that every training-data operator uses."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of ASCII white space, as ``[\x20\x09-\x0D]`` matches them.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return str(jvm_dir.get())
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomweb-"))
        return str(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loomweb/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and any executor can read it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once everything that reads them is written."""
    for t in tables:
        drop_path(t.sparkSession, t.written_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path under the shared folder, wherever that is stored."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def text_key(column: str) -> list:
    """k1 and k2: 128 hash bits of a text, null as empty, which with the row's id tell rows apart."""
    from pyspark.sql import functions as F

    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def ascii_lower(column):
    """Lower-cases A-Z only."""
    from pyspark.sql import functions as F

    return F.translate(column, UPPER, LOWER)
