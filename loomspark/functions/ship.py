"""Sending this package to executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows and bytes of a batch that goes to a Python worker: rows of any width then need bounded memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application, and bound their batches.

    Spark has no bound for one operator alone, so the session's is set, but never one that the session has set itself.
    """
    sc = spark.sparkContext
    own = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)
    if sc.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="loomspark-")) / "loomspark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(path.resolve()))
    _sent.add(sc.applicationId)
