"""Parquet tables of a data folder, and tables written between the steps of a query."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def select_rows(spark: SparkSession, folder: str, name: str, where: Column | str | None = None, without: Mapping[str, Sequence[str]] | None = None, order: Sequence[str] = (), limit: int | None = None, allowed: Sequence[str] = TABLES) -> DataFrame:
    """Rows of one of the ``allowed`` tables, by what is asked for: a predicate, values of columns to leave out, the first in an order. Any other name is an error before anything is read."""
    if name not in allowed:
        raise ValueError(f"no such table: {name}")
    rows = table(spark, folder, name)
    if where is not None:
        rows = rows.where(where)
    for column, values in (without or {}).items():
        rows = rows.where(~F.coalesce(F.lower(column).isin(*[v.lower() for v in values]), F.lit(False)))
    rows = rows.orderBy(*order) if order else rows
    return rows if limit is None else rows.limit(limit)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where it is unset, one of this machine, if it is the only one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet (by ``codec``, or the session's) into the shared folder and read back: what is read several times is made once, and a retry after a lost executor starts from it."""
    path = f"{shared_dir(df.sparkSession)}/treeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
