"""Sessions: sensible settings for tests and jobs, and the package shipped to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch: texts of some kilobytes each are exchanged with Python a few megabytes at a time.
BATCH_ROWS = 1500


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, wherever the driver was started; keep Arrow batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file from here as long as it runs
    target = Path(folder, "lectern_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path(root.name, path.relative_to(root))))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine for tests and benchmarks."""
    settings = {
        "spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
