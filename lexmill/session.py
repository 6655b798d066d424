"""Session settings and shared folders of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of the default file system; on a cluster this must not be a local one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm = context._jvm
        system = jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
        if system.getUri().getScheme() == "file" and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = system.makeQualified(jvm.org.apache.hadoop.fs.Path(f"/tmp/lexmill-{uuid.uuid4().hex}")).toString()
    context.setCheckpointDir(root)
    return context.getCheckpointDir() or root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes read the stored rows, also after an executor is lost."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a scan that has fewer partitions than there are cores; larger scans stay as they are.

    Text work is bound by the processor, so one small file must not be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def python_partitions(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Fixed number of partitions by key in front of Python groups, which adaptive execution would
    merge into few tasks by their small size in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
