"""Writes as whole new versions: keyed inserts, upserts and replacements; exports; tables of the catalogue.

Plain Parquet has no in-place update; each function returns the rows of the new
version, to be written with ``mode("overwrite")`` or, for ``replace_by``, with
dynamic partition overwrite.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``. A grouping with a map-side minimum, so that a frequent key is no hot task."""
    names = rows.columns
    marked = rows.select(*key, F.struct(*order).alias("__order"), F.struct(*names).alias("__row"))
    return marked.groupBy(*key).agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def insert_absent(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``target`` and the first of ``rows`` for each key that it lacks."""
    return target.unionByName(first_by_key(rows, key, order).join(target.select(*key).distinct(), list(key), "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows``, and those of ``target`` whose key they lack; values are overwritten, not added."""
    return rows.select(*target.columns).unionByName(target.join(rows.select(*key).distinct(), list(key), "left_anti"))


def replace_by(target: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``target`` with all rows that share a value of ``column`` with ``rows`` replaced by ``rows``."""
    return upsert(target, rows, [column])


def write_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Replace the partitions of ``column`` that ``rows`` has, in a folder partitioned by it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


_EMPTY = "\0empty"  # what the reader gives for a quoted empty field, as it holds a plain one for null
_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def append_csv(rows: DataFrame, path: str) -> None:
    """Append rows as CSV below ``path``; the header is a part of its own, written with the first rows.

    Each batch is a folder named by its time, so that all parts in order of path
    are one CSV file. A null is an empty field, an empty text a quoted one.
    """
    spark = rows.sparkSession
    try:
        spark.read.text(f"{path}/batch={0:020d}").schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        head = spark.range(1).select(*[F.lit(c).alias(c) for c in rows.columns])
        head.coalesce(1).write.options(**_CSV).mode("overwrite").csv(f"{path}/batch={0:020d}")
    rows.write.options(**_CSV).csv(f"{path}/batch={time.time_ns():020d}")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows that ``append_csv`` wrote, of all batches."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    batch = T.StructField("batch", T.StringType())
    rows = spark.read.schema(T.StructType([*kind.fields, batch])).options(**_CSV, multiLine=True, nullValue="", emptyValue=_EMPTY).csv(path).where(F.col("batch") != f"{0:020d}")
    filled = lambda f: F.when(F.col(f.name) == _EMPTY, "").otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
    return rows.select(*map(filled, kind.fields))


def write_trees(rows: DataFrame, path: str, key: str, tree: str, by: Sequence[str] = ()) -> None:
    """JSON trees as lines that hold a key and a tree, in folders of the columns ``by``; ``files.read_trees`` reads them."""
    named = F.to_json(F.struct(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)))  # {"key":"..."}
    line = F.concat(named.substr(F.lit(1), F.length(named) - 1), F.lit(f',"{tree}":'), F.coalesce(F.regexp_replace(tree, r"[\r\n]+", " "), F.lit("null")), F.lit("}"))
    out = rows.select(line.alias("value"), *by).write
    (out.partitionBy(*by) if by else out).text(path)


def export_lines(rows: DataFrame, path: str, columns: Sequence[str], key: str) -> None:
    """Parallel line files in ``path``/column=name, of all ``columns`` and the key: line i of part k of one belongs to line i of part k of the others.

    One job sorts the rows by ranges of ``key`` and writes all the files of a
    range in one task, so that lines stay aligned whatever ties there are. White
    space becomes single spaces. Keys already exported are skipped, so that an
    interrupted export goes on; it then adds parts.
    """
    spark = rows.sparkSession
    try:
        done = spark.read.text(f"{path}/column={key}").select(F.col("value").alias("__done"))
        rows = rows.join(done, F.col(key).cast("string") == F.col("__done"), "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    names = [key, *(c for c in columns if c != key)]
    said = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
    placed = rows.select(*names).repartitionByRange(key, *[F.col(c) for c in names[1:]]).select("*", F.monotonically_increasing_id().alias("__nth"))
    each = placed.select(F.struct(key, F.struct(*names[1:]), "__nth").alias("__at"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), said(c).alias("value")) for c in names])).alias("x"))
    each.select("__at", "x.column", "x.value").sortWithinPartitions("column", "__at").select("value", "column").write.mode("append").partitionBy("column").text(path)


def create_if_missing(spark: SparkSession, name: str, columns: str, partition: str | None = None, location: str | None = None) -> bool:
    """Make the catalogue table ``name`` of ``columns`` (as DDL) unless it exists; whether it was made."""
    if spark.catalog.tableExists(name):
        return False
    by = f" PARTITIONED BY ({partition})" if partition else ""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by}{at}")
    return True


def _insert(rows: DataFrame, name: str, overwrite: bool, mode: str) -> None:
    """Rows in the table's order of columns; partitions that they don't have stay with ``mode`` dynamic, go with static."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=overwrite)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def append(rows: DataFrame, name: str) -> None:
    """Add ``rows`` to the catalogue table ``name``."""
    _insert(rows, name, False, "static")


def replace_partitions(rows: DataFrame, name: str) -> None:
    """Put ``rows`` in place of those partitions of the catalogue table that they have."""
    _insert(rows, name, True, "dynamic")


def replace_all(rows: DataFrame, name: str) -> None:
    """Put ``rows`` in place of all rows of the catalogue table."""
    _insert(rows, name, True, "static")


def truncate(spark: SparkSession, name: str) -> None:
    """Leave the catalogue table without rows; it keeps its place, inside the warehouse or not."""
    replace_all(spark.createDataFrame([], spark.table(name).schema), name)
