"""Sessions: settings that the engine expects, and the package on the workers' path."""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``; there
    the extra entry in the path does nothing.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    return spark


def local(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(spark)


_MADE: list[tuple[SparkSession, str]] = []


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all machines share, ``spark.checkpoint.dir``; it is removed at exit.

    Where that is unset the folder lies in the session's warehouse, which all machines share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidelog-scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _MADE:
        try:
            fs, at = filesystem(spark, path)
            fs.delete(at, True)
        except Exception:  # the JVM may be gone at exit; the folder is temporary
            return
