"""What a job needs on the cluster: the code on executors, and a folder that all share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``.  Only where that is unset and all runs on one
    machine a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_SHIPPED: set[str] = set()
BATCH_BYTES = 8 << 20  # of an Arrow batch; else 10,000 long rows make one


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, unless PYTHONPATH has it; bound Arrow batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    root, app = Path(__file__).resolve().parent, spark.sparkContext.applicationId
    if app in _SHIPPED or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = f"{tempfile.mkdtemp(prefix='lodestone-')}/lodestone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


class Workspace:
    """Tables that one operator call writes into the shared folder.

    Each is read back from there, so a lost executor costs at most the step
    that is running.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df written and read back; in a folder for each value of the columns ``by``."""
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
