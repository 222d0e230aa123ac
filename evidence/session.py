"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Spark 4.1 may skip a shuffle above a union of co-partitioned inputs; together with
    # exchange reuse that duplicated rows of the registered ``manifest_current`` query.
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "evidence", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings are left alone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str = "table") -> str:
    """A fresh path under the folder the cluster shares.

    That is ``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``.
    Where neither is set a session on one machine gets a folder of its own, which
    goes when the process ends; on a cluster an error is raised, because executors
    do not see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="evidence-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores when the files give fewer splits than that.

    For row-wise work that is heavy per row. A large table already has more
    splits than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Rows of equal keys together, in as many partitions as the session asks for, or so many times that.

    The number is given outright, so that a small but costly input is not merged into few tasks.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
