"""Readers, exports, kept results and tables of the catalogue, run over the given tables and held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.operators.materialized import Materialized
from treeloom.operators.run_record import RunRecord
from treeloom.plans.common import Queries
from treeloom.plans.tree_queries import turns
from treeloom.sources import files, sinks
from treeloom.sources.tables import shared_dir, table

found = Queries()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/treeloom/{name}-{uuid.uuid4().hex}"


@found.add(r"""
WITH named AS (SELECT conv_id * 1000 + turn AS doc_id, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS said FROM conversations),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS number FROM named)
SELECT number, doc_id::VARCHAR AS doc_id, role, said FROM numbered WHERE said <> '' AND trim(role) <> ''
""")
def parallel_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All turns exported as parallel line files of several parts and read back by line numbers, in blocks of a few KB."""
    path = _folder(spark, "lines")
    sinks.export_lines(turns(spark, folder).select("doc_id", "role", F.col("text").alias("said")), path, ["role", "said"], "doc_id")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        # The plan that is written here reads with small blocks.
        read = files.read_parallel(spark, {c: f"{path}/column={c}" for c in ("doc_id", "role", "said")}, "all", r"part-(\d+)")
        read.write.parquet(f"{path}/read")
        sizes = files.number_lines(spark, f"{path}/column=doc_id").groupBy(F.regexp_extract("file", r"part-(\d+)", 1).alias("file")).agg(F.max("line").alias("n"))
        sizes.write.parquet(f"{path}/sizes")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # A row for each part; parts are ranges of the key.
    ahead = spark.read.parquet(f"{path}/sizes").withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = spark.read.parquet(f"{path}/read").join(F.broadcast(ahead), "file")
    return rows.select((F.col("ahead") + F.col("line")).alias("number"), "doc_id", "role", "said")


@found.add("""
WITH good AS (SELECT doc_id, lang, source, text FROM documents)
SELECT doc_id::VARCHAR AS task, coalesce(nullif(lang, ''), nullif(source, ''), '') AS language, array_to_string(string_split(coalesce(text, ''), ' '), ' ') AS doc, length(coalesce(text, '')) AS n_chars, 0::BIGINT AS n_bad FROM good
UNION ALL SELECT 'bad', '', '', 0, count(*) FROM documents WHERE doc_id % 7 = 3
""")
def jsonl_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as JSON lines, with broken and blank lines between them, and read by chains of aliases."""
    path = _folder(spark, "jsonl")
    docs = table(spark, folder, "documents")
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("task_id"), F.lit("").alias("name"), F.col("lang").alias("language"), F.col("source").alias("repo"), F.split(F.coalesce("text", F.lit("")), " ").alias("tokens")))
    broken = F.when(F.col("doc_id") % 7 == 3, F.array(F.lit('{"task_id": "cut'), F.lit("   "))).otherwise(F.array().cast("array<string>"))
    docs.select(F.explode(F.concat(F.array(record), broken)).alias("value")).write.text(path)
    good, bad = files.read_jsonl(spark, path, {"task": ("name", "task_id"), "language": ("language", "repo"), "doc": ("tokens",)}, joined=("tokens",))
    rows = good.select("task", "language", "doc", F.length("doc").cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_bad"))
    none = F.lit("")
    return rows.unionByName(bad.agg(F.count("*").alias("n_bad")).select(F.lit("bad").alias("task"), none.alias("language"), none.alias("doc"), F.lit(0).cast("long").alias("n_chars"), "n_bad"))


_MONEY = ["l_quantity", "l_extendedprice"]


@found.add("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, " + ", ".join(f"round({f}({v}), 4) AS {n}_{v}" for v in _MONEY for n, f in (("avg", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM lineitem GROUP BY ALL")
def refreshed_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A kept summary after three refreshes, each of which reads its own batch of lines only."""
    lines = table(spark, folder, "lineitem")
    kept = Materialized(spark, _folder(spark, "summary"), ["l_returnflag", "l_linestatus"], _MONEY)
    cuts = [F.col("l_shipdate") < "1994-01-01", (F.col("l_shipdate") >= "1994-01-01") & (F.col("l_shipdate") < "1997-01-01"), (F.col("l_shipdate") >= "1997-01-01") | F.col("l_shipdate").isNull()]
    for i, cut in enumerate(cuts):
        kept.refresh(lines.where(cut), f"batch-{i}")
    kept.refresh(lines.where(cuts[1]), "batch-1")  # is in already
    return kept.result()


@found.add("""
WITH target AS (SELECT lang AS dataset, source, count(*) AS n_rows FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
replaced AS (SELECT lang AS dataset, 'all' AS source, count(*) AS n_rows FROM documents WHERE lang IN (SELECT min(lang) FROM documents) GROUP BY ALL)
SELECT 'by_dataset' AS name, true AS made, false AS made_again, * FROM replaced UNION ALL SELECT 'by_dataset', true, false, * FROM target WHERE dataset NOT IN (SELECT dataset FROM replaced)
UNION ALL SELECT 'whole', true, false, 'documents', source, count(*) FROM documents GROUP BY source
""")
def catalogue_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables of the catalogue, made once, filled, and replaced: one dataset's partition of the one, all rows of the other."""
    docs = table(spark, folder, "documents").select("lang", "source")
    shown, run = [], uuid.uuid4().hex
    columns = "source string, n_rows long, dataset string"
    for name in ("by_dataset", "whole"):
        full, place = f"treeloom_{name}_{run}", _folder(spark, name)
        made = [sinks.create_if_missing(spark, full, columns, "dataset", place) for _ in range(2)]
        counts = docs.where("lang IS NOT NULL").groupBy(F.col("lang").alias("dataset"), "source").agg(F.count("*").alias("n_rows"))
        sinks.append(counts, full)
        if name == "by_dataset":
            first = docs.agg(F.min("lang").alias("lang"))
            sinks.replace_partitions(docs.join(F.broadcast(first), "lang").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n_rows")).withColumn("source", F.lit("all")), full)
        else:
            sinks.truncate(spark, full)
            sinks.append(docs.groupBy("source").agg(F.count("*").alias("n_rows")).withColumn("dataset", F.lit("documents")), full)
        shown.append(spark.table(full).select(F.lit(name).alias("name"), F.lit(made[0]).alias("made"), F.lit(made[1]).alias("made_again"), "dataset", "source", "n_rows"))
    return shown[0].unionByName(shown[1])


@found.add("""
SELECT 'read' AS step, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars, true AS timed, true AS described FROM documents
UNION ALL SELECT 'filled', count(*), sum(n_chars)::BIGINT, true, true FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'grouped', count(*), sum(n)::BIGINT, true, true FROM (SELECT sum(n_chars) AS n FROM documents GROUP BY source, lang)
""")
def run_record(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, sums and seconds of the steps of a run, as its one JSON row holds them beside host, versions and script hashes."""
    path, record, docs = _folder(spark, "run"), RunRecord(spark), table(spark, folder, "documents")
    write = lambda name: lambda rows: rows.write.parquet(f"{path}/{name}")
    record.step("read", docs, write("read"), n_chars=F.sum("n_chars"))
    record.step("filled", docs.where(F.trim("text") != ""), write("filled"), n_chars=F.sum("n_chars"))
    record.step("grouped", docs.groupBy("source", "lang").agg(F.sum("n_chars").alias("n")), write("grouped"), n_chars=F.sum("n"))
    row = record.row("store_queries", "documents", {"steps": list(record.steps)}, [__file__, f"{__file__}.missing"])
    step = "map<string, struct<n_rows: bigint, n_chars: bigint, seconds: double>>"
    told = F.from_json("environment", "struct<host: string, python: string, packages: map<string, string>, scripts: map<string, string>>")
    rows = row.select(F.explode(F.from_json("steps", step)).alias("step", "x"), told.alias("e"))
    described = F.col("e.host").isNotNull() & F.col("e.python").isNotNull() & F.col("e.packages")["pyspark"].isNotNull() & (F.length(F.col("e.scripts")["store_queries.py"]) == 64)
    return rows.select("step", "x.n_rows", "x.n_chars", (F.col("x.seconds") >= 0).alias("timed"), described.alias("described"))


@found.add("SELECT doc_id, lang, source, strlen(text) AS n_bytes, sha256(text) AS text_sha256 FROM documents")
def csv_appends(spark: SparkSession, folder: str) -> DataFrame:
    """Documents appended to one CSV in three batches, and read back."""
    path, docs = _folder(spark, "csv"), table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    for i in range(3):
        sinks.append_csv(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == i), path)
    rows = sinks.read_csv(spark, path, "doc_id long, lang string, source string, text string")
    text = F.col("text").cast("binary")
    return rows.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


@found.add("""
WITH shards AS (SELECT 'shard=' || (doc_id // 100) AS path, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, text) || chr(10) AS content FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id // 100),
files AS (SELECT path, strlen(content)::BIGINT AS size, sha256(content) AS sha256 FROM shards)
SELECT path, 1::BIGINT AS file_count, size, sha256 FROM files UNION ALL SELECT 'manifest', count(*), sum(size)::BIGINT, sha256(string_agg(path || chr(9) || size || chr(9) || sha256 || chr(10), '' ORDER BY path)) FROM files
""")
def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the files that a hundred documents each are written to, and its totals."""
    path = _folder(spark, "artifact")
    docs = table(spark, folder, "documents").where("doc_id IS NOT NULL").select(F.expr("doc_id div 100").alias("shard"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("shard").sortWithinPartitions("shard", "doc_id", "value").select("value", "shard").write.partitionBy("shard").text(path)
    rows = files.manifest(spark, path, F.regexp_extract("path", r"(shard=-?\d+)/[^/]*$", 1)).where("path <> ''")
    totals = files.manifest_totals(rows).select(F.lit("manifest").alias("path"), "file_count", F.col("total_bytes").alias("size"), "sha256")
    return rows.select("path", F.lit(1).cast("long").alias("file_count"), "size", "sha256").unionByName(totals)
