"""Reading test tables, and tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where the session names none, one is made on a single machine, and a cluster raises."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/loomgraph-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here and a lost executor loses nothing."""
    schema = df.schema
    df.write.parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(schema).parquet(f"{path}/{name}")
