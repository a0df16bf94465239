"""Readers of corpora in files: JSON lines, parallel lines, whole files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import text as tx

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str | list[str], aliases: dict[str, Sequence[str]], joined: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines, and the lines that are no JSON objects.

    Each output column is the first filled one of its ``aliases`` (nulls and
    empty strings fall through; empty if none is filled); list columns named in
    ``joined`` become words joined by spaces. The file's name is ``file``; blank
    lines are skipped.
    """
    fields = list(dict.fromkeys(f for names in aliases.values() for f in names))
    schema = T.StructType([*(T.StructField(f, T.ArrayType(T.StringType()) if f in joined else T.StringType()) for f in fields), T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).select(F.translate("value", "\0", "").alias("value"), F.input_file_name().alias("file")).where(F.trim("value") != "")
    rows = lines.select("file", "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    text = lambda f: F.array_join(f"r.{f}", " ") if f in joined else F.col(f"r.{f}")
    good = rows.where(~bad).select("file", *[tx.first_filled(*map(text, names)).alias(to) for to, names in aliases.items()])
    return good, rows.where(bad).select("file", "value")


def number_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of the files below ``path``: ``file``, ``line`` (from 1, of its file) and ``value``.

    A large file is read in blocks by many tasks: a line's number is that of the
    lines in its file's blocks before, and its place in its own.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ahead = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return raw.withColumn("nth", nth).join(ahead, ["file", "block"]).select("file", (F.col("ahead") + F.col("nth")).alias("line"), "value")


def read_parallel(spark: SparkSession, sides: dict[str, str], split: str, stem: str | None = None) -> DataFrame:
    """Line i of each file beside line i of the others: ``func_name`` ({split}_func_{i}, from 1), ``file``, ``line`` and a column for each side.

    Where a side has several files, its k-th by name goes with the k-th of the
    others, or with that of equal ``stem`` (the first group of a pattern); ``file``
    is that number or stem, and lines count within it. NUL characters go, lines
    are stripped, invalid UTF-8 is replaced. A line that is blank on any side is
    left out; the numbers stay those of the files.
    """
    out: DataFrame | None = None
    for name, path in sides.items():
        lines = number_lines(spark, path)
        if stem is None:
            # A row for each file.
            files = lines.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).cast("string").alias("nth"))
            lines = lines.join(F.broadcast(files), "file")
        else:
            lines = lines.withColumn("nth", F.regexp_extract("file", stem, 1))
        clean = tx.strip(F.translate(F.make_valid_utf8("value"), "\0", ""))
        side = lines.select(F.col("nth").alias("file"), "line", clean.alias(name)).where(F.col(name) != "")
        out = side if out is None else out.join(side, ["file", "line"])
    return out.select(F.concat(F.lit(f"{split}_func_"), F.col("line").cast("string")).alias("func_name"), "file", "line", *sides)


def manifest(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """Name, size and SHA-256 of all files below ``path``; hidden files and folders are skipped.

    ``name`` is an expression of the file's whole ``path``; by default it is the
    path below the folder. Each file is read whole, of 2 GB at most; Spark's reader
    skips empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    below = F.substring_index("path", base, -1)
    shown = files.where(~F.concat(F.lit("/"), below).rlike(r"/\.[^/]*"))
    return shown.select((below if name is None else name).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_totals(rows: DataFrame) -> DataFrame:
    """``file_count``, ``total_bytes`` and ``sha256`` of a manifest: that of its lines of path, size and hash between tabs, by path in code points.

    A flat hash is sequential, so one task holds a line of some hundred bytes for
    each file; the listing of the files does so as well. ``manifest_hash`` of the
    plans is a tree of hashes for entries of any number.
    """
    line = F.concat("path", F.lit("\t"), F.col("size").cast("string"), F.lit("\t"), "sha256", F.lit("\n"))
    sorted_ = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    whole = F.array_join(F.transform(sorted_, lambda x: x["line"]), "")
    return rows.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.sha2(whole.cast("binary"), 256).alias("sha256"))


def read_trees(spark: SparkSession, path: str | list[str], key: str = "key", tree: str = "tree", whole: bool = False) -> DataFrame:
    """JSON trees of files: with ``whole``, one a file, by its ``file`` name; else a line holds a key and a tree (``sinks.write_trees``).

    The tree stays JSON text. Folders named column=value give columns. A line or
    a file that is no JSON object has a null tree, a blank line is none.
    """
    if whole:
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias(tree))
        return rows.withColumn(tree, F.when(F.from_json(tree, "map<string, string>").isNotNull(), F.col(tree)))
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    read = F.from_json("value", T.StructType([T.StructField(key, T.StringType()), T.StructField(tree, T.StringType())]))
    return lines.withColumn("__read", read).select(*[c for c in lines.columns if c != "value"], F.col(f"__read.{key}").alias(key), F.col(f"__read.{tree}").alias(tree))
