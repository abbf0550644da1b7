"""Session settings the operators rely on."""

from __future__ import annotations

import functools
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


@functools.cache
def _shipped(application: str) -> str:
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix=f"corpusmill-{application}-")
    return shutil.make_archive(f"{folder}/corpusmill", "zip", package.parent, package.name)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of a session that was started without it."""
    context = spark.sparkContext
    archive = _shipped(context.applicationId)
    if not any(Path(file).name == Path(archive).name for file in context.listFiles):
        context.addPyFile(archive)


def local_session(cores: str = "8", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusmill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
