"""Cutting lineage in iterative jobs without losing fault tolerance."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only a local session, as in tests, may leave it unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="mailgraph-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and return a frame that reads them back.

    Later steps read only the columns they need from it, and a lost executor re-reads files instead of re-running the
    lineage. Used where a result is read several times or a loop would grow the plan.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # shuffle files of the plan just run stay until the driver collects its garbage
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("table-"):
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
