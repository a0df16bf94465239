"""What a run did: rows and seconds of each step, on which machine, with which versions and scripts, as one JSON row."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import resource
import socket
import time
from collections.abc import Callable, Iterable
from importlib import metadata

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RunRecord:
    """Collects steps by name. Rows are counted by the write itself (``observe``), in no job of their own."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.steps = spark, {}

    def step(self, name: str, rows: DataFrame, write: Callable[[DataFrame], object], **metrics: Column) -> None:
        """Write ``rows`` with ``write`` and keep its rows, seconds, the driver's memory growth (KB) and ``metrics`` (aggregates)."""
        seen = Observation(name)
        began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        write(rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in metrics.items()]))
        took = time.perf_counter() - began
        self.steps[name] = dict(seen.get) | {"seconds": round(took, 6), "driver_kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before}

    def overhead(self, name: str, over: str) -> float | None:
        """By how many percent step ``name`` took longer than step ``over``; none where that took no time."""
        base = self.steps[over]["seconds"]
        return round((self.steps[name]["seconds"] - base) / base * 100, 4) if base else None

    def environment(self, scripts: Iterable[str] = (), packages: Iterable[str] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict:
        """Host, processors, memory, versions, and SHA-256 of the scripts (null for one that isn't there)."""

        def digest(path: str) -> str | None:
            if not os.path.isfile(path):
                return None
            with open(path, "rb") as f:
                return hashlib.file_digest(f, "sha256").hexdigest()

        def version(name: str) -> str | None:
            try:
                return metadata.version(name)
            except metadata.PackageNotFoundError:
                return None

        pages = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
        return {
            "host": socket.gethostname(), "platform": platform.platform(), "python": platform.python_version(), "cpus": os.cpu_count(), "memory_bytes": pages,
            "parallelism": self.spark.sparkContext.defaultParallelism, "packages": {p: version(p) for p in packages}, "scripts": {os.path.basename(s): digest(s) for s in scripts},
        }

    def row(self, script: str, dataset: str, config: dict, scripts: Iterable[str] = (), notes: str | None = None) -> DataFrame:
        """The run as one row: ``script_name``, ``dataset``, and as JSON ``config``, ``environment`` and ``steps``, and ``notes``."""
        values = (script, dataset, json.dumps(config, sort_keys=True), json.dumps(self.environment(scripts), sort_keys=True), json.dumps(self.steps, sort_keys=True), notes)
        return self.spark.createDataFrame([values], "script_name string, dataset string, config string, environment string, steps string, notes string")
