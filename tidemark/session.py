"""Session helpers: shared checkpoint folder and materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scoped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This run's folder for intermediate tables, on storage that outlives an executor.

    It lies in the folder that ``spark.checkpoint.dir`` names, which all executors must share, is
    scoped by the application and is removed when the driver's JVM ends. A local folder is made
    only when the setting is absent and the master is local (tests, laptops).
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/tidemark-{sc.applicationId}"
    if path not in _scoped:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _scoped.add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Used where one wide table feeds several later stages: the written form keeps column
    pruning and filter push-down, which an RDD checkpoint would lose.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files that ``materialise`` wrote for ``df``, once a later table holds what is needed of them."""
    spark = df.sparkSession
    scope = f"{shared_dir(spark).rstrip('/')}/tables/".split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if scope in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
