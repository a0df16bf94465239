"""Results that are kept and refreshed: snapshots of mergeable aggregates with a list of versions.

A snapshot holds, for each group, counts, sums, sums of squares, least and
largest values. A refresh aggregates the new rows alone and merges them with the
latest snapshot, whose size is that of the result. The new snapshot is written
beside the old one and becomes current by one appended row in ``versions``; a
reader sees the old result or the new one, and a refresh that fails leaves the
old. Two refreshes at once are not supported.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Materialized:
    """A kept summary of ``values`` by ``group`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, group: Sequence[str], values: Sequence[str]) -> None:
        self.spark, self.path, self.group, self.values = spark, path, list(group), list(values)

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, snapshot string, batch string").parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def current(self) -> tuple[int, str | None]:
        """Number and folder of the latest snapshot; 0 and none before the first refresh."""
        versions = self._versions()
        row = versions.orderBy(F.desc("version")).head() if versions is not None else None
        return (row["version"], row["snapshot"]) if row else (0, None)

    def has(self, batch: str) -> bool:
        """Whether the rows named ``batch`` are in already."""
        versions = self._versions()
        return versions is not None and not versions.where(F.col("batch") == batch).isEmpty()

    def _partial(self, rows: DataFrame) -> DataFrame:
        x = {v: F.col(v).cast("double") for v in self.values}
        parts = [c for v in self.values for c in (F.count(v).alias(f"n_{v}"), F.sum(x[v]).alias(f"sum_{v}"), F.sum(x[v] * x[v]).alias(f"sq_{v}"), F.min(x[v]).alias(f"min_{v}"), F.max(x[v]).alias(f"max_{v}"))]
        return rows.groupBy(*self.group).agg(F.count("*").alias("n_rows"), *parts)

    def refresh(self, rows: DataFrame, batch: str) -> int:
        """Merge ``rows``, a batch that is not in yet, into the result; the version that is current afterwards. A known batch changes nothing."""
        version, old = self.current()
        if self.has(batch):
            return version
        new = self._partial(rows)
        if old is not None:
            how = {"min": F.min, "max": F.max}
            both = new.unionByName(self.spark.read.schema(new.schema).parquet(f"{self.path}/{old}"))
            new = both.groupBy(*self.group).agg(*[how.get(c.split("_")[0], F.sum)(c).alias(c) for c in new.columns if c not in self.group])
        name = f"snapshot-{version + 1}-{uuid.uuid4().hex}"
        new.write.parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(version + 1, name, batch)], "version long, snapshot string, batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return version + 1

    def result(self, digits: int = 4) -> DataFrame:
        """The current summary: rows, and for each value mean, sample deviation, least and largest."""
        version, old = self.current()
        if old is None:
            raise ValueError("never refreshed")
        rows, shown = self.spark.read.parquet(f"{self.path}/{old}"), []
        for v in self.values:
            n, total, square = F.col(f"n_{v}"), F.col(f"sum_{v}"), F.col(f"sq_{v}")
            spread = F.when(n > 1, F.sqrt(F.greatest(square - total * total / n, F.lit(0.0)) / (n - 1)))
            shown += [F.round(F.try_divide(total, n), digits).alias(f"avg_{v}"), F.round(spread, digits).alias(f"std_{v}"), F.round(f"min_{v}", digits).alias(f"min_{v}"), F.round(f"max_{v}", digits).alias(f"max_{v}")]
        return rows.select(*self.group, "n_rows", *shown)
