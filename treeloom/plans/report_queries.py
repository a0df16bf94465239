"""Relational reports over the tables, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import text as tx
from treeloom.operators import reports
from treeloom.operators.trees import leaves
from treeloom.plans.common import LEAVES_SQL, Queries
from treeloom.sources import sinks
from treeloom.sources.tables import table

found = Queries()


@found.add("""
SELECT 'documents' AS dataset, source AS split, lang AS language, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source, lang
""")
def corpus_counts_by_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.groupBy(F.lit("documents").alias("dataset"), F.col("source").alias("split"), F.col("lang").alias("language")).agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@found.add("""
SELECT min(doc_id) AS doc_id, lang, md5(text) AS text_md5, count(*) AS n_rows FROM documents GROUP BY lang, md5(text)
""")
def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    first = sinks.first_by_key(docs, ["lang", "text_md5"], ["doc_id"])
    counts = docs.groupBy("lang", "text_md5").agg(F.count("*").alias("n_rows"))
    return first.join(counts, ["lang", "text_md5"]).select("doc_id", "lang", "text_md5", "n_rows")


@found.add("""
WITH target AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, 'kept' AS origin FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
rows AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, 'inserted' AS origin FROM orders GROUP BY o_custkey)
SELECT * FROM target UNION ALL SELECT * FROM rows WHERE o_custkey NOT IN (SELECT o_custkey FROM target)
""")
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    target = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).withColumn("origin", F.lit("kept"))
    rows = orders.select("o_custkey", "o_orderkey", F.lit("inserted").alias("origin"))
    return sinks.insert_absent(target, rows, ["o_custkey"], ["o_orderkey"])


@found.add("""
WITH target AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
rows AS (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT * FROM rows UNION ALL SELECT * FROM target WHERE o_custkey NOT IN (SELECT o_custkey FROM rows)
""")
def upsert_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    count = F.count("*").alias("n_orders")
    return sinks.upsert(orders.groupBy("o_custkey").agg(count), orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(count), ["o_custkey"])


@found.add("""
WITH target AS (SELECT lang AS dataset, source, count(*) AS n_rows FROM documents GROUP BY ALL),
rows AS (SELECT lang AS dataset, 'all' AS source, count(*) AS n_rows FROM documents WHERE lang = 'en' GROUP BY ALL)
SELECT * FROM rows UNION ALL SELECT * FROM target WHERE dataset NOT IN (SELECT dataset FROM rows)
""")
def replace_by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("lang").alias("dataset"), "source")
    target = docs.groupBy("dataset", "source").agg(F.count("*").alias("n_rows"))
    rows = docs.where("dataset = 'en'").groupBy("dataset").agg(F.count("*").alias("n_rows")).withColumn("source", F.lit("all"))
    return sinks.replace_by(target, rows, "dataset")


@found.add("""
SELECT doc_id, md5(doc_id::VARCHAR) AS sort_key, lang FROM documents ORDER BY sort_key, doc_id LIMIT 100
""")
def md5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 100 documents that any run draws alike."""
    docs = table(spark, folder, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("sort_key"), "lang")
    return docs.orderBy("sort_key", "doc_id").limit(100)


@found.add("""
SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''), nullif(c_name, ''), '') AS label,
  array_to_string(string_split(c_name, '#'), ' ') AS name_words, trim(c_mktsegment) <> '' AS has_segment FROM customer
""")
def alias_coalesce_projection(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return table(spark, folder, "customer").select("c_custkey", tx.first_filled(segment, F.col("c_name")).alias("label"), F.array_join(F.split("c_name", "#"), " ").alias("name_words"), (F.trim("c_mktsegment") != "").alias("has_segment"))


@found.add("""
SELECT event_type, count(*) AS n_rows, count(try_cast(nullif(json_extract_string(props, '$.k'), '') AS DOUBLE)) AS n_extracted,
  round(avg(coalesce(try_cast(nullif(json_extract_string(props, '$.code'), '') AS DOUBLE), try_cast(nullif(json_extract_string(props, '$.k'), '') AS DOUBLE), value)), 6) AS avg_value
FROM events GROUP BY event_type
""")
def json_extract_fallback(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda path: F.nullif(F.get_json_object("props", path), F.lit("")).try_cast("double")
    value = F.coalesce(number("$.code"), number("$.k"), F.col("value"))
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count(number("$.k")).alias("n_extracted"), F.round(F.avg(value), 6).alias("avg_value"))


@found.add(f"""
WITH {LEAVES_SQL}, sets AS (SELECT doc_id, lang, list_distinct(list(type)) AS kinds FROM leaves JOIN documents USING (doc_id) GROUP BY doc_id, lang)
SELECT lang, kind, count(*) FILTER (WHERE list_contains(kinds, kind)) AS n_with, count(*) AS n_rows
FROM sets, (SELECT unnest(['word', 'number', 'mixed', 'punct']) AS kind) GROUP BY lang, kind
""")
def json_contains_count(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kinds = leaves(docs, keep=["lang"]).groupBy("doc_id", "lang").agg(F.to_json(F.array_sort(F.collect_set("type"))).alias("kinds"))
    grid = kinds.withColumn("kind", F.explode(F.array(*map(F.lit, ("word", "number", "mixed", "punct")))))
    return grid.groupBy("lang", "kind").agg(F.expr("count(*) FILTER (WHERE array_contains(from_json(kinds, 'array<string>'), kind))").alias("n_with"), F.count("*").alias("n_rows"))


def _by_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("chars"))


_PAIRS_SQL = """sides AS (SELECT source, lang, count(*) AS n, avg(n_chars) AS chars FROM documents GROUP BY source, lang),
pairs AS (SELECT l.source, l.lang AS language1, r.lang AS language2, least(l.n, r.n) AS n_pairs, round(least(l.chars, r.chars) / greatest(l.chars, r.chars), 6) AS size_ratio
  FROM sides l JOIN sides r ON l.source = r.source AND l.lang < r.lang)"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of one source in unordered pairs; the sides are grouped before they meet."""
    side = _by_source(spark, folder)
    l, r = side.alias("l"), side.alias("r")
    ratio = F.least(F.col("l.chars"), F.col("r.chars")) / F.greatest(F.col("l.chars"), F.col("r.chars"))
    return l.join(r, (F.col("l.source") == F.col("r.source")) & (F.col("l.lang") < F.col("r.lang"))).select("l.source", F.col("l.lang").alias("language1"), F.col("r.lang").alias("language2"), F.least(F.col("l.n"), F.col("r.n")).alias("n_pairs"), F.round(ratio, 6).alias("size_ratio"))


@found.add(f"WITH {_PAIRS_SQL} SELECT * FROM pairs")
def pair_join_unordered(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


@found.add("""
WITH pairs AS (SELECT a.n_nationkey AS nation1, b.n_nationkey AS nation2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
done AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS nation1, greatest(c_nationkey, s_nationkey) AS nation2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_discount < 0.01)
SELECT * FROM pairs EXCEPT SELECT * FROM done
""")
def pair_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of nations not yet seen in either order: pairs are put in order, then anti-joined."""
    nation = table(spark, folder, "nation")
    a, b = nation.alias("a"), nation.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("nation1"), F.col("b.n_nationkey").alias("nation2"))
    lines = table(spark, folder, "lineitem").where("l_quantity >= 50 AND l_discount < 0.01").select("l_orderkey", "l_suppkey")
    met = lines.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    done = met.select(F.least("c_nationkey", "s_nationkey").alias("nation1"), F.greatest("c_nationkey", "s_nationkey").alias("nation2")).distinct()
    return pairs.join(done, ["nation1", "nation2"], "left_anti")


@found.add(f"""
WITH {_PAIRS_SQL}, both_sides AS (SELECT source, language1 AS language, size_ratio FROM pairs UNION ALL SELECT source, language2, size_ratio FROM pairs)
SELECT source, language, round(avg(size_ratio), 6) AS avg_ratio, count(*) AS n_pairs FROM both_sides GROUP BY source, language
""")
def pair_rollup_avg(spark: SparkSession, folder: str) -> DataFrame:
    """Averages over the pairs on either side of which a language stands."""
    each = _pairs(spark, folder).withColumn("language", F.explode(F.array("language1", "language2")))
    return each.groupBy("source", "language").agg(F.round(F.avg("size_ratio"), 6).alias("avg_ratio"), F.count("*").alias("n_pairs"))


_LANGUAGES = ("de", "en", "es", "fr", "it")


@found.add(f"""
WITH {LEAVES_SQL}, present AS (SELECT DISTINCT doc_id, lang, type FROM leaves JOIN documents USING (doc_id)),
totals AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
grid AS (SELECT l.lang, k.type FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang) l, (SELECT unnest(['word', 'number', 'mixed', 'punct', 'space']) AS type) k),
cells AS (SELECT g.lang, g.type, (200000000 * count(p.doc_id) + max(t.n)) // (2 * max(t.n)) AS units FROM grid g LEFT JOIN present p ON p.lang = g.lang AND p.type = g.type LEFT JOIN totals t ON t.lang = g.lang GROUP BY g.lang, g.type),
wide AS (SELECT type AS category, {", ".join(f"coalesce(max(CASE WHEN lang = '{x}' THEN units END), 0) AS {x}" for x in _LANGUAGES)} FROM cells GROUP BY type),
sums AS (SELECT category, {", ".join(_LANGUAGES)}, 1 AS n FROM wide UNION ALL SELECT 'AVERAGE ALL', {", ".join(f"sum({x})" for x in _LANGUAGES)}, count(*) FROM wide UNION ALL SELECT 'AVERAGE CORE', {", ".join(f"sum({x})" for x in _LANGUAGES)}, count(*) FROM wide WHERE category <> 'space')
SELECT category, {", ".join(f"((2 * {x} + n) // (2 * n)) / 10000 AS {x}" for x in _LANGUAGES)}, ((2 * ({" + ".join(_LANGUAGES)}) + 5 * n) // (10 * n)) / 10000 AS average FROM sums
""")
def dim_grid_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Completeness by category and language, as a pivot with sub-totals; a language or category without documents shows zeros.

    Percents are whole numbers of ten-thousandths, and means of them are rounded
    by whole numbers, halves up, so that no order of rows changes a digit.
    """
    docs = table(spark, folder, "documents")
    present = leaves(docs, keep=["lang"]).select("doc_id", "lang", "type").distinct().groupBy("lang", "type").agg(F.count("*").alias("n_with"))
    totals = docs.groupBy("lang").agg(F.count("*").alias("n"))
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, _LANGUAGES))).alias("lang")).withColumn("type", F.explode(F.array(*map(F.lit, ("word", "number", "mixed", "punct", "space")))))
    cells = reports.dense(grid, present, ["lang", "type"]).join(totals, "lang", "left").withColumn("units", F.expr("(200000000 * coalesce(n_with, 0) + n) div (2 * n)"))
    wide = cells.groupBy(F.col("type").alias("category")).pivot("lang", list(_LANGUAGES)).agg(F.max("units")).na.fill(0)
    total = lambda name, rows: rows.agg(*[F.sum(x).alias(x) for x in _LANGUAGES], F.count("*").alias("n")).withColumn("category", F.lit(name))
    sums = wide.withColumn("n", F.lit(1).cast("long")).unionByName(total("AVERAGE ALL", wide)).unionByName(total("AVERAGE CORE", wide.where("category <> 'space'")))
    return sums.select("category", *[F.expr(f"((2 * {x} + n) div (2 * n)) / 10000").alias(x) for x in _LANGUAGES], F.expr(f"((2 * ({' + '.join(_LANGUAGES)}) + 5 * n) div (10 * n)) / 10000").alias("average"))


_LINE_METRICS = [("l_quantity", 2), ("l_extendedprice", 2), ("l_discount", 5), ("l_tax", 5)]


@found.add("SELECT l_returnflag, l_linestatus, " + ", ".join(f"round({f}({c}), {d}) AS {n}_{c}" for c, d in _LINE_METRICS for n, f in (("avg", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM lineitem GROUP BY ALL")
def quad_summary_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return reports.quad_summary(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], _LINE_METRICS)


@found.add("""
SELECT n_name, count(c_custkey) AS n_customers, round(avg(c_acctbal), 4) AS avg_balance, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_negative
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING' GROUP BY n_name
""")
def group_averages_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Averages for every nation; one without customers has nulls."""
    rows = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"), F.avg((F.col("c_acctbal") < 0).cast("double")).alias("negative"))
    wide = reports.dense(table(spark, folder, "nation"), rows, ["n_nationkey"])
    return wide.select("n_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_customers"), F.round("balance", 4).alias("avg_balance"), F.round(F.coalesce("negative", F.lit(0.0)), 6).alias("share_negative"))


@found.add("""
WITH long AS (
  SELECT 'lineitem' AS dataset, 'quantity' AS metric, l_quantity AS value, false AS is_percent FROM lineitem UNION ALL SELECT 'lineitem', 'discount', 100 * l_discount, true FROM lineitem
  UNION ALL SELECT 'lineitem', 'kept', 100 * (1 - l_discount), true FROM lineitem UNION ALL SELECT 'orders', 'total_price', o_totalprice, false FROM orders UNION ALL SELECT 'events', 'value', value, false FROM events
), stats AS (SELECT dataset, metric, bool_or(is_percent) AS is_percent, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, max(value) AS high FROM long GROUP BY dataset, metric)
SELECT dataset, metric, CASE dataset WHEN 'lineitem' THEN 1 WHEN 'orders' THEN 2 ELSE 3 END AS sort_key, round(mean, 3)::DECIMAL(38,3)::VARCHAR || CASE WHEN is_percent THEN '%' ELSE '' END AS mean,
  round(std, 3)::DECIMAL(38,3)::VARCHAR || CASE WHEN is_percent THEN '%' ELSE '' END AS std, round(low, 3)::DECIMAL(38,3)::VARCHAR || CASE WHEN is_percent THEN '%' ELSE '' END AS low,
  round(high, 3)::DECIMAL(38,3)::VARCHAR || CASE WHEN is_percent THEN '%' ELSE '' END AS high FROM stats
""")
def descriptive_stats_long(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of several tables in one long form, described and formatted."""
    lines = reports.long_metrics(table(spark, folder, "lineitem"), "lineitem", {"quantity": (F.col("l_quantity"), False), "discount": (100 * F.col("l_discount"), True), "kept": (100 * (1 - F.col("l_discount")), True)})
    rows = lines.unionByName(reports.long_metrics(table(spark, folder, "orders"), "orders", {"total_price": (F.col("o_totalprice"), False)})).unionByName(reports.long_metrics(table(spark, folder, "events"), "events", {"value": (F.col("value"), False)}))
    stats = rows.groupBy("dataset", "metric").agg(F.bool_or("is_percent").alias("is_percent"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    sign = F.when(F.col("is_percent"), F.lit("%")).otherwise(F.lit(""))
    order = F.when(F.col("dataset") == "lineitem", 1).when(F.col("dataset") == "orders", 2).otherwise(3)
    shown = stats.select("dataset", "metric", order.alias("sort_key"), *[F.concat(reports.decimal_text(F.col(c)), sign).alias(c) for c in ("mean", "std", "low", "high")])
    return shown.orderBy("sort_key", "metric")


@found.add("""
WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, n, v[n // 2 + 1] AS upper_median, v[greatest(0, floor(0.025 * n)::BIGINT - 1) + 1] AS ci_low, v[least(n - 1, floor(0.975 * n)::BIGINT - 1) + 1] AS ci_high FROM s
""")
def order_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Upper median and percentile bounds of each group."""
    n = F.col("__all")
    places = {"upper_median": F.floor(n / 2), "ci_low": F.greatest(F.lit(0), F.floor(F.lit(0.025) * n) - 1), "ci_high": F.least(n - 1, F.floor(F.lit(0.975) * n) - 1)}
    return reports.order_statistics(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", places)


_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0"


@found.add(f"""
WITH pairs AS (SELECT lang AS task, n_chars::DOUBLE AS x, len(string_split(text, ' '))::DOUBLE AS y FROM documents),
both_tasks AS (SELECT * FROM pairs UNION ALL SELECT 'ALL', x, y FROM pairs),
ranked AS (SELECT *, {_RANK.format(g="task", v="x")} AS rx, {_RANK.format(g="task", v="y")} AS ry FROM both_tasks)
SELECT task, count(*) AS n, round(corr(x, y), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_r FROM ranked GROUP BY task
""")
def correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of two measures of a document, by language and pooled."""
    docs = table(spark, folder, "documents").select(F.explode(F.array("lang", F.lit("ALL"))).alias("task"), F.col("n_chars").cast("double").alias("x"), F.size(F.split("text", " ")).cast("double").alias("y"))
    return reports.correlations(docs, ["task"], "x", "y")


_COEFFICIENTS = "lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)"
_RANKED_SQL = f"""WITH pairs AS (SELECT source AS task, n_chars::DOUBLE AS x, len(string_split(text, ' '))::DOUBLE AS y FROM documents UNION ALL SELECT 'ids ' || source, doc_id::DOUBLE, n_chars::DOUBLE FROM documents),
ranked AS (SELECT *, {_RANK.format(g="task", v="x")} AS rx, {_RANK.format(g="task", v="y")} AS ry FROM pairs),
r AS (SELECT task, count(*) AS n, round(corr(x, y), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_r FROM ranked GROUP BY task),
long AS (SELECT task, n, 'pearson' AS kind, pearson_r AS r FROM r UNION ALL SELECT task, n, 'spearman', spearman_r FROM r),
sides AS (SELECT *, (n - 2) / 2.0 AS a0, 1 - r * r AS x0, 1 - r * r < ((n - 2) / 2.0 + 1) / ((n - 2) / 2.0 + 2.5) AS near FROM long),
args AS (SELECT *, CASE WHEN near THEN a0 ELSE 0.5 END AS a, CASE WHEN near THEN 0.5 ELSE a0 END AS b, CASE WHEN near THEN x0 ELSE 1 - x0 END AS x FROM sides),
folded AS (SELECT *, list_reduce(list_transform(generate_series(600, 1, -1), lambda k: CASE WHEN k % 2 = 0 THEN (k / 2) * (b - k / 2) * x / ((a + k - 1) * (a + k)) ELSE -(a + (k - 1) / 2) * (a + b + (k - 1) / 2) * x / ((a + k - 1) * (a + k)) END), lambda f, t: 1 + t / f, 1.0::DOUBLE) AS fraction FROM args),
p AS (SELECT task, kind, r, n, CASE WHEN x0 <= 0 THEN 0 WHEN x0 >= 1 THEN 1 WHEN near THEN exp({_COEFFICIENTS}) / a / fraction ELSE 1 - exp({_COEFFICIENTS}) / a / fraction END AS p FROM folded)
SELECT task, max(n) AS n, max(r) FILTER (kind = 'pearson') AS pearson_r, max(r) FILTER (kind = 'spearman') AS spearman_r, round(max(p) FILTER (kind = 'pearson'), 9) AS pearson_p, round(max(p) FILTER (kind = 'spearman'), 9) AS spearman_p FROM p GROUP BY task"""


@found.add(_RANKED_SQL)
def correlation_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations of two measures of a document and of its id with one, by source, with their p-values."""
    docs = table(spark, folder, "documents")
    measures = docs.select(F.col("source").alias("task"), F.col("n_chars").cast("double").alias("x"), F.size(F.split("text", " ")).cast("double").alias("y"))
    ids = docs.select(F.concat(F.lit("ids "), F.col("source")).alias("task"), F.col("doc_id").cast("double").alias("x"), F.col("n_chars").cast("double").alias("y"))
    return reports.correlation_tests(measures.unionByName(ids), ["task"], "x", "y")


@found.add("""
WITH pairs AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS price, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, round(avg(price), 4) AS macro_price, sum(n)::BIGINT AS n_rows, NULL::DOUBLE AS median_price FROM pairs GROUP BY o_orderpriority
""")
def macro_average(spark: SparkSession, folder: str) -> DataFrame:
    """Means of group means, beside sums of group sizes; a median of medians is left null."""
    pairs = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("n"))
    return pairs.groupBy("o_orderpriority").agg(F.round(F.avg("price"), 4).alias("macro_price"), F.sum("n").alias("n_rows")).withColumn("median_price", F.lit(None).cast("double"))


@found.add("""
SELECT event_type AS dataset, strftime(date_trunc('month', ts), '%Y-%m-%d') AS run_month, count(*) AS n_rows, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_large, round(avg(value), 4) AS avg_value,
  round(coalesce(stddev_samp(value), 0), 4) AS std_value, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value FROM events GROUP BY ALL
""")
def result_summary_view(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of results by dataset and run; a single row has deviation 0."""
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("dataset"), F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd").alias("run_month"))
    return rows.agg(F.count("*").alias("n_rows"), F.sum((F.col("value") > 50).cast("long")).alias("n_large"), F.round(F.avg("value"), 4).alias("avg_value"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("std_value"), F.round(F.min("value"), 4).alias("min_value"), F.round(F.max("value"), 4).alias("max_value"))


@found.add("""
SELECT doc_id AS row_id, sha256(text) AS text_sha256, sha256(coalesce(lang, '')) AS lang_sha256,
  '{"chars":' || length(text) || ',"lang":"' || lang || '"}' AS summary FROM documents
""")
def audit_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of each row's parts beside a JSON summary."""
    docs = table(spark, folder, "documents")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return docs.select(F.col("doc_id").alias("row_id"), digest(F.col("text")).alias("text_sha256"), digest(F.coalesce("lang", F.lit(""))).alias("lang_sha256"), F.to_json(F.struct(F.length("text").alias("chars"), "lang")).alias("summary"))


@found.add("""
WITH l0 AS (SELECT source, doc_id // 1000 AS part, count(*) AS n, sum(strlen(text)) AS size, sha256(string_agg(doc_id || chr(9) || strlen(text) || chr(9) || sha256(text), chr(10) ORDER BY doc_id)) AS hash FROM documents GROUP BY ALL),
l1 AS (SELECT source, part // 1000 AS part, sum(n) AS n, sum(size) AS size, sha256(string_agg(hash, chr(10) ORDER BY l0.part)) AS hash FROM l0 GROUP BY source, l0.part // 1000)
SELECT source AS artifact, sum(n)::BIGINT AS file_count, sum(size)::BIGINT AS total_bytes, sha256(string_agg(hash, chr(10) ORDER BY part)) AS sha256 FROM l1 GROUP BY source
""")
def manifest_hash(spark: SparkSession, folder: str) -> DataFrame:
    """A hash over the sorted manifest of each source's documents, as a tree of hashes of a thousand entries each."""
    docs = table(spark, folder, "documents")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.octet_length("text").cast("string"), F.sha2(F.col("text").cast("binary"), 256))
    level = docs.select("source", F.col("doc_id").alias("part"), F.lit(1).cast("long").alias("n"), F.octet_length("text").cast("long").alias("size"), line.alias("line"))
    for divisor in (1000, 1000, None):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")
        up = F.lit(0).cast("long") if divisor is None else F.floor(F.col("part") / divisor)
        level = level.groupBy("source", up.alias("up")).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sha2(joined.cast("binary"), 256).alias("line")).withColumnRenamed("up", "part")
    return level.select(F.col("source").alias("artifact"), F.col("n").alias("file_count"), F.col("size").alias("total_bytes"), F.col("line").alias("sha256"))


_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@found.add(" UNION ALL ".join(f"SELECT 'tables' AS dataset, '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def run_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table of a run, in one statement."""
    counts = [table(spark, folder, t).groupBy(F.lit("tables").alias("dataset"), F.lit(t).alias("table_name")).agg(F.count("*").alias("n_rows")) for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
