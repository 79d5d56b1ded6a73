"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application. The state
    machines run there, wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    # Only the driver reads this file; addPyFile hands it to every executor.
    target = pathlib.Path(tempfile.mkdtemp(prefix="sessionledger-", dir="/tmp")) / f"{root.name}.zip"
    with zipfile.PyZipFile(str(target), "w") as z:
        z.writepy(str(root))  # compiled once here rather than in every worker
    spark.sparkContext.addPyFile(str(target))
    # Python processes beside the driver (of streams and their sources) read no such file.
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), str(root.parent)]))
    _SHIPPED.add(app)
