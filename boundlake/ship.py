"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch where the session doesn't say. Spark's own default of
#: 10 000 makes batches of tens of MB from documents, several times over.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each application.

    Spark's own file server hands the archive out, so no folder needs to be
    shared and executors that start later fetch it as well.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="boundlake-")
        archive = os.path.join(folder, "boundlake_src.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, os.path.join(root.name, path.relative_to(root)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
