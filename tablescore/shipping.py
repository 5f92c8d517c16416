"""Makes this package importable by the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Bytes of rows that Spark hands to Python at once, where the session doesn't say: rows can be long texts.
BYTES_AT_ONCE = str(4 << 20)
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the session's Python workers, once for each application, and bounds the bytes that
    they get at once unless the session has a bound of its own.

    The archive is handed to Spark's own file server; the driver's copy is a scratch file."""
    if not spark.conf.get(_BYTES, None):
        spark.conf.set(_BYTES, BYTES_AT_ONCE)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent).as_posix())
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark
