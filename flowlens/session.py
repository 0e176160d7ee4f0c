"""Session construction and shared scratch space.

On a cluster the shared folder is the one named by ``spark.checkpoint.dir``;
a private one is made only where nothing is configured and Spark runs in one
process (tests, laptops); on a cluster without the setting we raise.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "flowlens",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("FLOWLENS_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only when unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        # Spark appends a per-application uuid folder; write next to it.
        return d.rsplit("/", 1)[0] if "/" in d else d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowlens-ckpt-"))     # one machine: tests, laptops
    return sc.getCheckpointDir().rsplit("/", 1)[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for one written table."""
    return f"{_tables_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _tables_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/flowlens-tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df) -> None:
    """Delete the table of a frame that ``materialize`` returned, once nothing reads it any more."""
    path = getattr(df, "_table_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised (call it when its results are written)."""
    _delete(spark, _tables_root(spark))


def materialize(df, name: str = "stage"):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts lineage and survives executor loss (like ``checkpoint()``), and unlike an
    RDD checkpoint the re-read keeps column pruning and filter pushdown. Used
    where one frame feeds several jobs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._table_path = path
    return out
