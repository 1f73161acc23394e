"""Session helper and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app_name: str = "kinspot", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    # driver and executors of a local session are one machine
    conf = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="kinspot-")} | conf
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or else one in the warehouse, which is shared too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kinspot-work"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    """New folder below one folder per application, which can go when it has ended."""
    root = f"{shared_dir(spark).rstrip('/')}/kinspot-{spark.sparkContext.applicationId}"
    return f"{root}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where a result is read more than once: the lineage is cut in a way
    that survives lost executors, and the planner then knows the true size, so
    that a join broadcasts this side only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
    """
    target = path or new_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def written_small(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """:func:`written` with little disk: Zstandard pages, and no shuffle file of ``df`` stays when the table is there."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    target, before = path or new_path(df.sparkSession, name), conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file at ``path``, in whatever store the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
