"""Session helpers: a tuned local session for tests/bench, and checkpoint setup."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ARCHIVE = "stayframe-src.zip"

#: Python workers live on between tasks: few heaps, Arrow's memory from the same ones, and the cores left to Spark's tasks.
WORKER_ENVIRONMENT = {"MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"}

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove checkpoint files once the checkpointed data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  driver_memory: str = "16g", app: str = "stayframe") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", driver_memory)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``. Only a local
    session (tests) with the setting unset gets a fresh scratch folder; on a
    cluster an unset setting is an error, never a machine-local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS / S3)")
        path = tempfile.mkdtemp(prefix="stayframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written stage tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "stages", name)


def ensure_package(spark: SparkSession) -> None:
    """Let the executors' Python import this library: its sources are sent along once per application.
    Python functions made from here on run in workers of ``WORKER_ENVIRONMENT`` (values already set stay)."""
    context = spark.sparkContext
    for name, value in WORKER_ENVIRONMENT.items():
        context.environment.setdefault(name, value)
    if any(os.path.basename(f) == ARCHIVE for f in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="stayframe-src-"), ARCHIVE)
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(archive)
