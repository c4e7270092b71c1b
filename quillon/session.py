"""Sessions for local use, and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it; on a cluster the cluster's own settings hold."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quillon")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once a context, so that Python functions of it run wherever their tasks do."""
    sc = spark.sparkContext
    if not getattr(sc, "_quillon_shipped", False):
        folder = tempfile.mkdtemp(prefix="quillon-code-")
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(f"{folder}/quillon", "zip", Path(__file__).parents[1], "quillon"))
        sc._quillon_shipped = True
    return spark
