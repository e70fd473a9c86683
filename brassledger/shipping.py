"""Hand this package's code to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once an application.

    Workers do not see the driver's sys.path; a zip of the package goes to them
    through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-ship-")), f"{here.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)
