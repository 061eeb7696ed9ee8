"""Session helpers: table reading, and written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def session(app: str = "lodestone", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use; on a cluster, pass your own session instead."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, each: int = 32 << 20, least: int = 1 << 20) -> DataFrame:
    """df dealt over all cores where that is worth it: a small table is often one row group, which one task reads, and what is
    done to its texts then runs in that task. Tables with over `each` bytes a core (by Spark's estimate) stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if least <= size < each * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary folder of this machine only where that is unset and the master
    is local (tests). On a cluster without that setting it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; clear() deletes it."""
    _WRITTEN.append(path := f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}")
    return path


def clear(spark: SparkSession) -> None:
    """Deletes all tables and files that this driver's queries have left in the shared folder so far. Call it when their
    results are written: a DataFrame that was returned before can't be read afterwards."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors. The shuffle files
    of the write go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path, cleanup = scratch(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialize(), once nothing reads it any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone/" in parent:
            _delete(df.sparkSession, parent)
