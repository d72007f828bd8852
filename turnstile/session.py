"""Sessions: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that the engine's results or plans rely on; a cluster's own settings win elsewhere.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cores: int | str = "*", memory: str = "8g", **more: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    os.environ.setdefault("PYTHONPATH", "")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ["PYTHONPATH"].split(":"):
        os.environ["PYTHONPATH"] = f"{root}:{os.environ['PYTHONPATH']}".strip(":")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("turnstile")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
