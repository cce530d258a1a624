"""Materialising intermediate results where every executor can reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder named by spark.checkpoint.dir. Only in local mode, where it may be unset, a temporary one stands in."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder once and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As stable(), but as a Parquet table: rows are packed by column, and readers take the columns that they use."""
    folder = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again; what came of them is written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
