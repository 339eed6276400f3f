"""Session builder with the settings every query of the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "prismlane", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow; extra settings as keyword arguments with _ for dots."""
    os.environ.setdefault("TZ", "UTC")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.environ.get("PYTHONPATH", "")
    if here not in path.split(os.pathsep):  # Python workers import the package from here
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (here, path) if x)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
