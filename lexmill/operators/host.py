"""Figures of the driver's host, from the operating system alone."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _memory() -> tuple[int | None, int | None]:
    """Bytes of memory, all and available; None where the system does not say."""
    try:
        with open("/proc/meminfo") as f:
            rows = dict(line.split(":", 1) for line in f)
        return tuple(int(rows[k].split()[0]) * 1024 for k in ("MemTotal", "MemAvailable"))
    except (OSError, KeyError, ValueError):
        return None, None


def metrics(spark: SparkSession, path: str = "/") -> DataFrame:
    """One row: cpus, load_1m, memory_total, memory_available, memory_percent, disk_total, disk_free, disk_percent (of the file system of path), at."""
    total, available = _memory()
    disk = shutil.disk_usage(path)
    load = os.getloadavg()[0] if hasattr(os, "getloadavg") else None
    row = spark.createDataFrame([(os.cpu_count(), load, total, available, disk.total, disk.free)], "cpus int, load_1m double, memory_total long, memory_available long, disk_total long, disk_free long")
    used = lambda free, all_: F.round((1 - F.col(free) / F.col(all_)) * 100, 1)
    return row.withColumns({"memory_percent": used("memory_available", "memory_total"), "disk_percent": used("disk_free", "disk_total"), "at": F.current_timestamp()})
