"""Intermediate tables that outlive lost executors.

A table is written once as Parquet below the shared folder of the cluster and read
again, which cuts the lineage: whatever executor is lost later, nothing before the
table runs again. The tables of an application lie in one folder, which goes when it ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that an Arrow batch carries to a Python worker, but for a longer row.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset and Spark runs on one machine, as in tests, a temporary folder is made and set; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="upkeep-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns; removed when the application ends."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    folder = f"{shared_dir(spark)}/upkeep-{context.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table as read back."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    del df
    # shuffle files of what has been written go once the driver collects its garbage; a large heap may not for long
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let Arrow batches carry about ``size`` bytes, so that long texts don't fill a Python worker; a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
