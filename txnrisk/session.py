"""Spark session settings for the engine.

Production jobs get their session from the cluster; ``build_session`` is for
tests, the bench and local runs.  ``checkpoint_dir`` reads the shared folder the
cluster names in ``spark.checkpoint.dir`` and only invents one (under /tmp)
when nothing is configured, which is the local/test case.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale:
#  * AQE re-plans joins at runtime from real shuffle sizes: it turns a
#    sort-merge join into a broadcast join only when the measured side is
#    below the threshold, and splits skewed partitions of a sort-merge join.
#  * advisory partition size keeps post-shuffle partitions spill-free.
#  * UTC session zone: every timestamp we derive is zone-free (TIMESTAMP_NTZ),
#    casts to TIMESTAMP for streaming watermarks then agree with DuckDB.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128MB",
}


def build_session(master: str | None = None, app: str = "txnrisk",
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("TXNRISK_DRIVER_MEM", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus))))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in
    ``spark.checkpoint.dir``.  Only a local session, where all run on one
    machine, gets a folder of its own when nothing is set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="txnrisk-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back: one job (``checkpoint()`` would run the plan twice
    unless cached), survives executor loss, and later reads prune columns."""
    path = os.path.join(checkpoint_dir(df.sparkSession), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Remove the tables that ``cut_lineage`` has written; frames that still
    read one can't be used afterwards."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint_dir(spark), "tables"))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions of at most ``rows`` rows: dealt out evenly where one holds more (a scan packs files up
    to a number of bytes, whatever the rows cost that are made of them), in whole rounds of the cores, else as it is."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]   # a number a partition
    if max(sizes, default=0) <= rows:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(math.ceil(sum(sizes) / rows / cores) * cores)


def ensure_parallelism(df: DataFrame, minimum: int | None = None) -> DataFrame:
    """Raise the partition count to the cluster's parallelism for CPU-heavy
    stages (model fits, Python scoring) when a small input arrives in few
    files.  A no-op at scale, where inputs already have many more partitions
    than cores."""
    want = minimum or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
