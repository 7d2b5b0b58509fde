"""Session helpers: scratch space, lineage cuts, size-checked rows, code for the workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row bound under which a side may be shipped to every task.
SMALL_ROWS = 10_000


#: Settings these operators count on; all can be changed on a running session.
SETTINGS = {
    # Skewed joins (frames of one reference, rows of one sample) are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Whole spectra are wide rows: smaller Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see, as named by ``spark.checkpoint.dir``.

    Only on a local master (one machine) that names none is a temporary folder made and
    recorded in the session; a cluster without a shared folder is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spectrel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of :func:`shared_dir`; never reused between runs."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    Unlike a cache this survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, max_rows: int = SMALL_ROWS):
    """Rows of ``df`` when there are at most ``max_rows`` of them, else ``None``."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of this session (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = scratch_path(spark, "code").removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        # An object store is not a file system; Spark serves the archive from the driver instead.
        folder = tempfile.mkdtemp(prefix="spectrel-code-")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, "spectrel.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for root, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
