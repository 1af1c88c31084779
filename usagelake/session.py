"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """For one machine. On a cluster the same settings but for master and memory apply; shuffle partitions are then AQE's to coalesce."""
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName("usagelake").config(map=settings).getOrCreate()
