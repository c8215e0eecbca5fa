"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning is what adapts one plan to 8 local cores and to 1000
# executors: partition counts are coalesced from a high initial number, skewed
# join partitions are split, and a side is broadcast only when its measured size
# is under the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Wide plans have more generated classes than the default cache of 100 holds.
    "spark.sql.codegen.cache.maxEntries": "4000",
    # Call-site capture costs several JVM round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "chainsieve", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    if not partitions and not master:
        # On a cluster: start high, let runtime coalescing bring small stages down.
        spark.conf.set("spark.sql.shuffle.partitions", str(max(200, 3 * spark.sparkContext.defaultParallelism)))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only where driver and executors are one process."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chainsieve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of the executors that computed it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
