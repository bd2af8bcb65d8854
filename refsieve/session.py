"""Session settings the library is meant to run under."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that hold on a laptop and on a cluster alike. Partition counts, executor sizes and
# the checkpoint folder belong to the cluster and are left to it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Slim rows of pairs take much work per byte: parallelism counts before partition size.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("refsieve")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


# Row groups of intermediates: what each writing task holds before it writes, so not Parquet's 128 MB.
ROW_GROUP_BYTES = 16 << 20

_CLEARED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for written intermediates; it goes when the application ends.

    It lies in ``spark.checkpoint.dir``, or where that is unset in the context's checkpoint folder
    or the warehouse, which driver and executors share as well.
    """
    base = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    )
    folder = f"{base.rstrip('/')}/refsieve-{spark.sparkContext.applicationId}"
    if folder not in _CLEARED:
        _CLEARED.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return the scan of what was written.

    Cuts lineage: later stages re-read files that survive the loss of any executor, and the scan
    keeps column pruning, filter push-down and size statistics. ``compression`` names a Parquet codec in
    place of the session's, such as ``zstd`` for whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
