"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch to or from Python, where the session leaves Spark's default. Rows of long texts would else fill 64 MB a task and direction.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, DEFAULT_BYTES = 8 << 20, "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through Spark's own file server, once per application, and bound Arrow batches."""
    if spark.conf.get(BATCH, DEFAULT_BYTES) == DEFAULT_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodestrand-")) / "lodestrand_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root).as_posix()}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
