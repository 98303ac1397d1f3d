"""Sessions and written snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "findery", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster use the one that the cluster gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(found) if table in LONG_TEXTS else found


#: Tables of which each row takes much work.
LONG_TEXTS = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer parts than tasks can run at once is dealt to all of them; a large one, in many parts, is left alone."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where none is set and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def snapshot(df: DataFrame, name: str = "snapshot") -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors.  It is deleted as the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
