"""The shared folder for intermediate tables, and cutting lineage through it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a plain local session may lack the setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spandoc-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/spandoc-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and read back from the shared folder, whatever executors are lost later."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that no later step reads."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
