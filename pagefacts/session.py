"""Session settings and the folder for durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pagefacts.sources import files

# Runtime-settable options the plans rely on. Broadcasts stay under Spark's own
# size check (autoBroadcastJoinThreshold): no operator forces one.
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # what a job shuffled goes when the job ends, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


#: Set only where the session says nothing. Rows of texts are five to ten times as large in memory as in a
#: shuffle, so a task that reads Spark's own 64 MB of them needs near a GB; with this it stays the same whatever the input.
SIZES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}

_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Switch on adaptive execution with skew handling; leaves sizing to the cluster,
    but for the size of a task's share where the cluster does not name one.

    Also makes the package importable for Python workers on every executor.
    """
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    for key, value in SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pagefacts-")) / "pagefacts.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, f"{root.name}/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


_private: dict[str, str] = {}


def durable_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where driver and executors are one process, in local mode, an unset one may be a
    private folder, which goes when the process ends; anywhere else it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _private:
        _private[app] = tempfile.mkdtemp(prefix="pagefacts-")
        atexit.register(shutil.rmtree, _private[app], ignore_errors=True)
    return _private[app]


def cut_lineage(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, in another session if one is given.

    Survives lost executors, and a frame used by several consumers is computed once.
    """
    path = f"{durable_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    out = (spark or df.sparkSession).read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what ``cut_lineage`` wrote for frames that nobody reads any more: all that was made of them is written."""
    for df in frames:
        files.remove(df.sparkSession, df._cut_at)
