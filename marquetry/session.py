"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marquetry", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution. On a cluster pass nothing and let spark-submit decide."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.host", "127.0.0.1")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset and the master is local (tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="marquetry-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a reliable checkpoint: computed once, kept in the shared folder, safe against lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, laid out by the columns `by`, so later reads take only the columns
    and parts they need. Unlike a checkpoint it holds on to nothing of the job that made it. Gone when the application ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}")
    out = df.write.option("parquet.enable.dictionary", "false")
    (out.partitionBy(*by) if by else out).parquet(path.toString())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def release(spark: SparkSession, rounds: int = 2) -> None:
    """Lets the executors delete the shuffle files of finished jobs now: Spark does so when the driver collects its garbage,
    which a driver with little to do may put off until the disks are full. Call it after a large table is `written`."""
    for left in reversed(range(rounds)):  # what the first round finalises, the second one finds free
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3 if left or rounds > 1 else 0)


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """Partitions so that each holds about rows_per_partition rows, never fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition))


def ship_package(spark: SparkSession) -> bool:
    """Makes this package importable in Python workers that cannot see it; True if it had to be sent.

    Nothing is done where PYTHONPATH names its folder, or locally when that folder is the current one. Otherwise the sources go
    to the executors through Spark's own file server, once per context.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in seen or (sc.master.startswith("local[") and os.getcwd() == root) or getattr(sc, "_marquetry_sent", False):
        return False
    made = os.path.join(tempfile.mkdtemp(prefix="marquetry-"), "marquetry.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "marquetry")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(made)
    sc._marquetry_sent = True
    return True
