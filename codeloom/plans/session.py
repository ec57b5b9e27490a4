"""Sessions whose Python workers find this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def with_package(spark: SparkSession) -> SparkSession:
    """Puts the folder of this checkout on the Python workers' path, whatever the driver's folder is.
    On a cluster without a shared checkout, ship the package with --py-files."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HERE not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, HERE]))
    return spark
