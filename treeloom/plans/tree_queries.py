"""Tree operators over documents and conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import text as tx
from treeloom.operators import trees
from treeloom.plans.common import LEAVES_SQL, TURNS_SQL, UNIFIED_SQL, Queries
from treeloom.sources.tables import table

found = Queries()
SEVERITIES = (0.0, 0.1, 0.25, 0.5, 0.75)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "turn", "role", "text")


_COUNTS_SQL = f"""{LEAVES_SQL}, {UNIFIED_SQL},
o AS (SELECT doc_id, (1 + count(DISTINCT line) + count(*))::BIGINT AS n_original, sum(len(list_filter(string_split(text, ' '), lambda w: w <> '')))::BIGINT AS a_original FROM leaves GROUP BY doc_id),
ul AS (SELECT doc_id, line, max(n_line) AS n FROM unified GROUP BY doc_id, line),
u AS (SELECT doc_id, (1 + sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) + sum(n))::BIGINT AS n_unified, sum(n)::BIGINT AS a_unified FROM ul GROUP BY doc_id)"""


@found.add("WITH " + LEAVES_SQL + """, sizes AS (SELECT doc_id, line, count(*) AS n FROM leaves GROUP BY doc_id, line)
SELECT doc_id, lpad(line::VARCHAR, 6, '0') || '.' || lpad(pos::VARCHAR, 6, '0') AS path, 2 AS depth, type, text, 'line' AS parent_type, 0::BIGINT AS n_children FROM leaves
UNION ALL SELECT doc_id, lpad(line::VARCHAR, 6, '0'), 1, 'line', '', 'document', n FROM sizes
UNION ALL SELECT doc_id, '', 0, 'document', '', NULL, count(*) FROM sizes GROUP BY doc_id""")
def node_table_documents(spark: SparkSession, folder: str) -> DataFrame:
    return trees.nodes(trees.leaves(table(spark, folder, "documents")))


@found.add(f"""WITH {_COUNTS_SQL}
SELECT o.doc_id, n_original, coalesce(n_unified, 0) AS n_unified, round_even(coalesce(n_unified, 0) / n_original, 4) AS compression_ratio, round_even(1 - coalesce(n_unified, 0) / n_original, 4) AS compression_gain FROM o LEFT JOIN u USING (doc_id)""")
def compression(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of both trees, their ratio and the gain."""
    rows = trees.leaves(table(spark, folder, "documents"))
    original = trees.node_counts(rows, F.lit(1)).withColumnRenamed("n_nodes", "n_original")
    small = trees.node_counts(trees.unified(rows), (F.col("n_line") > 1).cast("int")).withColumnRenamed("n_nodes", "n_unified")
    both = original.join(small, "doc_id", "left").na.fill(0, ["n_unified"])
    ratio = F.col("n_unified") / F.col("n_original")
    return both.select("doc_id", "n_original", "n_unified", F.bround(ratio, 4).alias("compression_ratio"), F.bround(1 - ratio, 4).alias("compression_gain"))


@found.add(f"""WITH {_COUNTS_SQL}
SELECT o.doc_id, a_original, coalesce(a_unified, 0) AS a_unified, round_even(CASE WHEN a_original = 0 THEN 0 ELSE 1 - coalesce(a_unified, 0) / (a_original + 1e-9) END, 4) AS attribute_loss FROM o LEFT JOIN u USING (doc_id)""")
def attribute_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Words in the texts of both trees' nodes, and the share lost."""
    rows = trees.leaves(table(spark, folder, "documents"))
    count = lambda r, name: r.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).cast("long").alias(name))
    both = count(rows, "a_original").join(count(trees.unified(rows), "a_unified"), "doc_id", "left").na.fill(0, ["a_unified"])
    return both.withColumn("attribute_loss", F.bround(F.when(F.col("a_original") == 0, 0.0).otherwise(1 - F.col("a_unified") / (F.col("a_original") + 1e-9)), 4))


@found.add(f"""WITH {LEAVES_SQL}, {UNIFIED_SQL}, kept AS (SELECT DISTINCT doc_id, line FROM leaves), alone AS (SELECT doc_id, line, count(*) AS n FROM leaves GROUP BY ALL)
SELECT lang, 'original' AS category, type AS node_type, count(*) AS n FROM leaves JOIN documents USING (doc_id) GROUP BY lang, type
UNION ALL SELECT lang, 'canonical', type, count(*) FROM unified JOIN documents USING (doc_id) GROUP BY lang, type
UNION ALL SELECT lang, 'removed', l.type, count(*) FROM leaves l JOIN documents USING (doc_id) WHERE l.type = 'punct' GROUP BY lang, l.type
UNION ALL SELECT lang, 'single_child', 'line', count(*) FROM alone JOIN documents USING (doc_id) WHERE n = 1 GROUP BY lang""")
def node_type_freq(spark: SparkSession, folder: str) -> DataFrame:
    """How often each node type occurs, is removed, or stands above a lone child, by language."""
    rows = trees.leaves(table(spark, folder, "documents"), keep=["lang"])
    by = lambda r, category: r.groupBy("lang", F.lit(category).alias("category"), F.col("type").alias("node_type")).agg(F.count("*").alias("n"))
    alone = rows.groupBy("doc_id", "lang", "line").agg(F.count("*").alias("n")).where("n = 1").withColumn("type", F.lit("line"))
    return by(rows, "original").unionByName(by(trees.unified(rows), "canonical")).unionByName(by(rows.where(F.col("type").isin(*trees.REMOVED)), "removed")).unionByName(by(alone, "single_child"))


@found.add(f"""WITH {LEAVES_SQL}, {UNIFIED_SQL}, placed AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth, type FROM unified)
SELECT l.doc_id, l.type AS removed_type, count(*) AS n FROM leaves l LEFT JOIN placed p ON p.doc_id = l.doc_id AND p.line = l.line AND p.nth = l.pos WHERE p.type IS NULL OR p.type <> l.type GROUP BY l.doc_id, l.type""")
def removed_types(spark: SparkSession, folder: str) -> DataFrame:
    """Original types whose place holds another type, or none, in the unified tree."""
    from pyspark.sql import Window

    rows = trees.leaves(table(spark, folder, "documents"))
    placed = trees.unified(rows).select("doc_id", "line", F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("pos")).alias("pos"), F.col("type").alias("other"))
    both = rows.join(placed, ["doc_id", "line", "pos"], "left").where(F.col("other").isNull() | (F.col("other") != F.col("type")))
    return both.groupBy("doc_id", F.col("type").alias("removed_type")).agg(F.count("*").alias("n"))


@found.add(r"""
SELECT event_type, CASE regexp_replace(lower(trim(replace('$' || event_type || ' ', '$', ''))), ':=', '=', 'g') WHEN 'click' THEN 'action' WHEN 'purchase' THEN 'action' WHEN 'view' THEN 'visit' ELSE lower(event_type) END AS canonical,
  coalesce(nullif(regexp_replace(regexp_replace(lower(event_type), '[^\p{L}\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'empty') AS token, count(*) AS n FROM events GROUP BY event_type""")
def canonicalize_types(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical names of raw type labels."""
    raw = F.concat(F.lit("$"), F.col("event_type"), F.lit(" "))
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", trees.canonical(raw, {"click": "action", "purchase": "action", "view": "visit"}).alias("canonical"), tx.normalize_token(F.col("event_type")).alias("token"), "n")


_CATEGORY = {"word": "NAME", "mixed": "NAME", "identifier": "NAME", "number": "VALUE", "literal": "VALUE", "punct": "MARK"}
_CASE = "CASE " + " ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in _CATEGORY.items()) + " END"


@found.add(f"""WITH {LEAVES_SQL}, {UNIFIED_SQL}, a AS (SELECT doc_id, list_sort(list_distinct(list({_CASE}))) AS original_all FROM leaves GROUP BY doc_id), b AS (SELECT doc_id, list_sort(list_distinct(list({_CASE}))) AS unified_all FROM unified GROUP BY doc_id),
c AS (SELECT a.doc_id, original_all, coalesce(unified_all, []) AS unified_all FROM a LEFT JOIN b USING (doc_id))
SELECT doc_id, array_to_string(original_all, ',') AS original_all, array_to_string(unified_all, ',') AS unified_all, round_even(len(list_intersect(original_all, unified_all)) / len(original_all), 4) AS pec_all,
  round_even(CASE WHEN len(list_filter(original_all, lambda x: x <> 'MARK')) = 0 THEN 1.0 ELSE len(list_filter(list_intersect(original_all, unified_all), lambda x: x <> 'MARK')) / len(list_filter(original_all, lambda x: x <> 'MARK')) END, 4) AS pec_core,
  array_to_string(list_filter(original_all, lambda x: NOT list_contains(unified_all, x)), ',') AS lost FROM c""")
def pec_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Element completeness: categories of the original tree that the unified one keeps, with and without marks."""
    rows = trees.leaves(table(spark, folder, "documents"))
    category = F.create_map(*[F.lit(x) for pair in _CATEGORY.items() for x in pair])[F.col("type")]
    sets = lambda r, name: r.groupBy("doc_id").agg(F.array_sort(F.collect_set(category)).alias(name))
    both = sets(rows, "o").join(sets(trees.unified(rows), "u"), "doc_id", "left").withColumn("u", F.coalesce("u", F.array().cast("array<string>")))
    core = lambda c: F.size(F.array_remove(c, "MARK"))
    kept = F.array_intersect("o", "u")
    return both.select("doc_id", F.array_join("o", ",").alias("original_all"), F.array_join("u", ",").alias("unified_all"), F.bround(F.size(kept) / F.size("o"), 4).alias("pec_all"), F.bround(F.coalesce(F.try_divide(core(kept), core(F.col("o"))), F.lit(1.0)), 4).alias("pec_core"), F.array_join(F.array_except("o", "u"), ",").alias("lost"))


@found.add(f"""WITH {LEAVES_SQL}, {UNIFIED_SQL}, paths AS (SELECT DISTINCT doc_id, CASE WHEN n_line = 1 THEN 'document>' ELSE 'document>line>' END || type AS path FROM unified),
n AS (SELECT doc_id, count(*) AS n FROM paths GROUP BY doc_id), shared AS (SELECT a.doc_id AS left_id, count(*) AS both_n FROM paths a JOIN paths b ON b.doc_id = a.doc_id + 1 AND a.path = b.path GROUP BY a.doc_id)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(coalesce(both_n / (na.n + nb.n - both_n), CASE WHEN coalesce(na.n, 0) + coalesce(nb.n, 0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS path_jaccard
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN n na ON na.doc_id = a.doc_id LEFT JOIN n nb ON nb.doc_id = b.doc_id LEFT JOIN shared s ON s.left_id = a.doc_id""")
def path_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Shared root-to-leaf label paths of each document's unified tree and the next one's; 1 where both have none."""
    docs = table(spark, folder, "documents")
    rows = trees.unified(trees.leaves(docs))
    sizes = trees.line_sizes(rows)
    labels = rows.join(sizes, ["doc_id", "line"]).select("doc_id", F.concat(F.when(F.col("n_line") == 1, "document>").otherwise("document>line>"), F.col("type")).alias("path")).distinct()
    sets = docs.select("doc_id").join(labels.groupBy("doc_id").agg(F.collect_set("path").alias("paths")), "doc_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    pair = sets.select(F.col("doc_id").alias("left_id"), F.col("paths").alias("a")).join(sets.select((F.col("doc_id") - 1).alias("left_id"), F.col("paths").alias("b")), "left_id")
    jaccard = F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b")))
    return pair.select("left_id", (F.col("left_id") + 1).alias("right_id"), F.round(F.coalesce(jaccard, F.lit(1.0)), 6).alias("path_jaccard"))


@found.add(f"""WITH {LEAVES_SQL}, bags AS (SELECT doc_id, type, count(*) AS n FROM leaves GROUP BY ALL), l AS (SELECT doc_id AS left_id, type, n AS na FROM bags WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), r AS (SELECT doc_id - 1 AS left_id, type, n AS nb FROM bags WHERE doc_id - 1 IN (SELECT doc_id FROM documents))
SELECT left_id, round(sum(least(coalesce(na, 0), coalesce(nb, 0))) / sum(greatest(coalesce(na, 0), coalesce(nb, 0))), 6) AS bag_similarity FROM l FULL JOIN r USING (left_id, type) GROUP BY left_id""")
def bag_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of the label counts of each document and the next one."""
    docs = table(spark, folder, "documents")
    bags = trees.leaves(docs).groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    ids = docs.select("doc_id")
    left = bags.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "left_id")
    right = bags.join(ids.select((F.col("doc_id") + 1).alias("doc_id")), "doc_id", "left_semi").select((F.col("doc_id") - 1).alias("left_id"), "type", "n")
    return trees.bag_similarity(left, right, ["left_id"], "type").withColumn("bag_similarity", F.round("bag_similarity", 6))


@found.add(f"""WITH {LEAVES_SQL}, sizes AS (SELECT doc_id, line, count(*) AS n FROM leaves GROUP BY ALL), roots AS (SELECT doc_id, count(*) AS n FROM sizes GROUP BY doc_id),
features AS (
  SELECT doc_id, unnest(['node_' || type, 'depth_2_' || type, 'arity_' || type || '_0', 'edge_line_' || type, 'path_document_line_' || type]) AS feature FROM leaves
  UNION ALL SELECT doc_id, unnest(['node_line', 'depth_1_line', 'arity_line_' || least(n, 8), 'edge_document_line']) FROM sizes
  UNION ALL SELECT doc_id, unnest(['node_document', 'depth_0_document', 'arity_document_' || least(n, 8)]) FROM roots)
SELECT doc_id, feature, count(*) AS n FROM features GROUP BY doc_id, feature""")
def structural_features(spark: SparkSession, folder: str) -> DataFrame:
    return trees.structural_features(trees.leaves(table(spark, folder, "documents")))


@found.add(f"""WITH {TURNS_SQL}, line_text AS (SELECT doc_id, line, string_agg(type || ' ' || text, ' ' ORDER BY pos) AS t, string_agg('node_' || type || ' leaf_' || coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'empty'), ' ' ORDER BY pos) AS s FROM leaves GROUP BY doc_id, line)
SELECT doc_id, 'document ' || string_agg('line ' || t, ' ' ORDER BY line) AS flat, 'node_document ' || string_agg('node_line ' || s, ' ' ORDER BY line) AS labelled FROM line_text GROUP BY doc_id""")
def flat_text(spark: SparkSession, folder: str) -> DataFrame:
    """Both one-line forms of each turn's tree."""
    rows = trees.leaves(turns(spark, folder))
    return trees.flat_text(rows).join(trees.flat_text(rows, labelled=True).withColumnRenamed("flat", "labelled"), "doc_id")


@found.add(f"""WITH {TURNS_SQL}, numbered AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS l, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) - 1 AS p, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) AS k, count(*) OVER (PARTITION BY doc_id, line) AS n FROM leaves),
roots AS (SELECT doc_id, count(DISTINCT line) AS n FROM leaves GROUP BY doc_id)
SELECT doc_id, (k + l + 1)::INTEGER AS node_id, (k + l + 1 - p - 1)::INTEGER AS parent_id, p::INTEGER AS pos, 2 AS depth, lpad(l::VARCHAR, 4, '0') || '.' || lpad(p::VARCHAR, 4, '0') AS path, type, text, 0 AS n_children FROM numbered
UNION ALL SELECT doc_id, (k + l)::INTEGER, 0, l::INTEGER, 1, lpad(l::VARCHAR, 4, '0'), 'line', '', n::INTEGER FROM numbered WHERE p = 0
UNION ALL SELECT doc_id, 0, -1, 0, 0, '', 'document', '', n::INTEGER FROM roots""")
def tree_flatten_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON trees of the turns, flattened to node rows."""
    rows = trees.leaves(turns(spark, folder))
    leaf = F.struct("pos", F.struct("type", "text", F.array().cast("array<string>").alias("children")).alias("node"))
    lines = rows.groupBy("doc_id", "line").agg(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["node"]).alias("children"))
    line = F.struct("line", F.struct(F.lit("line").alias("type"), F.lit("").alias("text"), "children").alias("node"))
    whole = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(line), lambda a, b: F.when(a["line"] < b["line"], -1).otherwise(1)), lambda x: x["node"]).alias("children"))
    return trees.flatten_json(whole.select("doc_id", F.to_json(F.struct(F.lit("document").alias("type"), F.lit("").alias("text"), "children")).alias("tree")), "doc_id", "tree")


def _unit_sql(path: str, kind: str) -> str:
    return f"(('0x' || substr(sha256('pec|' || doc_id || '|' || {path} || '|{kind}'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


_LEAF_PATH, _LINE_PATH = "'(' || (line - 1) || ', ' || (pos - 1) || ')'", "'(' || (line - 1) || ',)'"
_DEGRADED_SQL = f"""{TURNS_SQL}, s AS (SELECT unnest([{', '.join(map(str, SEVERITIES))}])::DOUBLE AS severity),
hashed AS (SELECT *, {_unit_sql(_LINE_PATH, 'drop')} AS line_drop, {_unit_sql(_LEAF_PATH, 'drop')} AS leaf_drop, {_unit_sql(_LEAF_PATH, 'node')} AS h FROM leaves),
line_lives AS (SELECT *, line_drop >= severity OR (max(line_drop) OVER (PARTITION BY doc_id, severity) < severity AND line_drop = min(line_drop) OVER (PARTITION BY doc_id, severity)) AS lives FROM hashed, s),
kept_lines AS (SELECT * FROM line_lives WHERE lives),
leaf_lives AS (SELECT * EXCLUDE (lives), leaf_drop >= severity OR (max(leaf_drop) OVER (PARTITION BY doc_id, line, severity) < severity AND leaf_drop = min(leaf_drop) OVER (PARTITION BY doc_id, line, severity)) AS lives FROM kept_lines),
degraded AS (SELECT doc_id, line, pos, severity, CASE WHEN h < 0.55 * severity THEN 'masked_' || type ELSE type END AS type, CASE WHEN h < 0.70 * severity THEN '' ELSE text END AS text FROM leaf_lives WHERE lives)"""


def _drawn(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's leaves with what corruption draws for them."""
    return trees.drawn_leaves(turns(spark, folder), F.concat(F.lit("pec|"), F.col("doc_id").cast("string")))


def _bits(condition) -> Column:
    """One bit for each severity: whether ``condition`` of it holds."""
    return sum((F.when(condition(F.lit(s)), F.lit(1 << i)).otherwise(0) for i, s in enumerate(SEVERITIES)), F.lit(0))


def _has(bits: str, i: int) -> Column:
    return F.col(bits).bitwiseAND(1 << i) > 0


@found.add(f"WITH {_DEGRADED_SQL} SELECT * FROM degraded")
def degrade_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's tree, corrupted by each severity."""
    return trees.corrupted(_drawn(spark, folder), F.explode(F.array(*map(F.lit, SEVERITIES))))


@found.add(f"""WITH {_DEGRADED_SQL}, o AS (SELECT DISTINCT doc_id, type FROM leaves), d AS (SELECT DISTINCT doc_id, severity, type FROM degraded),
score AS (SELECT o.doc_id, s.severity, count(d.type) / count(*) AS pec FROM o CROSS JOIN s LEFT JOIN d ON d.doc_id = o.doc_id AND d.severity = s.severity AND d.type = o.type GROUP BY o.doc_id, s.severity)
SELECT severity, count(*) AS sample_count, round(avg(pec), 6) AS value, round(avg(pec) - 1.0, 6) AS delta, round(coalesce(stddev_samp(pec), 0), 6) AS std, round(min(pec), 6) AS low, round(max(pec), 6) AS high FROM score GROUP BY severity""")
def sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """How completeness falls with the severity of corruption."""
    kinds = _drawn(spark, folder).groupBy("doc_id", "type").agg(F.bit_or(_bits(lambda s: trees.survives(s) & ~trees.masked(s))).alias("seen"))
    shares = [F.struct(F.lit(s).alias("severity"), (F.count_if(_has("seen", i)) / F.count("*")).alias("pec")) for i, s in enumerate(SEVERITIES)]
    score = kinds.groupBy("doc_id").agg(F.array(*shares).alias("shares")).select("doc_id", F.inline("shares"))
    return score.groupBy("severity").agg(F.count("*").alias("sample_count"), F.round(F.avg("pec"), 6).alias("value"), F.round(F.avg("pec") - 1.0, 6).alias("delta"), F.round(F.coalesce(F.stddev_samp("pec"), F.lit(0.0)), 6).alias("std"), F.round(F.min("pec"), 6).alias("low"), F.round(F.max("pec"), 6).alias("high"))


@found.add(f"""WITH {_DEGRADED_SQL}, truth AS (SELECT DISTINCT doc_id, lower(text) AS name FROM leaves WHERE type IN ('word', 'mixed')), guess AS (SELECT DISTINCT doc_id, severity, lower(text) AS name FROM degraded WHERE type IN ('word', 'mixed') AND text <> ''),
t AS (SELECT doc_id, count(*) AS n FROM truth GROUP BY doc_id), g AS (SELECT doc_id, severity, count(*) AS n FROM guess GROUP BY ALL), b AS (SELECT doc_id, severity, count(*) AS n FROM guess JOIN truth USING (doc_id, name) GROUP BY ALL),
q AS (SELECT a.doc_id, s.severity, coalesce(b.n, 0) AS tp, coalesce(g.n, 0) AS n_guess, coalesce(t.n, 0) AS n_truth FROM (SELECT DISTINCT doc_id FROM leaves) a CROSS JOIN s LEFT JOIN t USING (doc_id) LEFT JOIN g ON g.doc_id = a.doc_id AND g.severity = s.severity LEFT JOIN b ON b.doc_id = a.doc_id AND b.severity = s.severity)
SELECT doc_id, severity, tp, n_guess - tp AS fp, n_truth - tp AS fn, round(CASE WHEN n_guess + n_truth = 0 THEN 1 WHEN n_guess = 0 THEN 0 ELSE tp / n_guess END, 6) AS precision, round(CASE WHEN n_guess + n_truth = 0 THEN 1 WHEN n_truth = 0 THEN 0 ELSE tp / n_truth END, 6) AS recall,
  round(CASE WHEN n_guess + n_truth = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (n_guess + n_truth) END, 6) AS f1 FROM q""")
def identifier_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of the names that survive corruption; all 1 where neither tree has any."""
    # A corrupted tree has no name that the whole one lacks.
    named = F.col("type").isin("word", "mixed") & (F.col("text") != "")
    names = _drawn(spark, folder).groupBy("doc_id", F.when(named, F.lower("text")).alias("name")).agg(F.bit_or(_bits(lambda s: trees.survives(s) & ~trees.masked(s) & ~trees.blanked(s))).alias("seen"))
    hits = [F.struct(F.lit(s).alias("severity"), F.count_if(F.col("name").isNotNull() & _has("seen", i)).alias("n_guess")) for i, s in enumerate(SEVERITIES)]
    q = names.groupBy("doc_id").agg(F.count("name").alias("n_truth"), F.array(*hits).alias("hits")).select("doc_id", "n_truth", F.inline("hits")).withColumn("tp", F.col("n_guess"))
    none = F.col("n_guess") + F.col("n_truth") == 0
    rate = lambda n: F.round(F.when(none, 1.0).otherwise(F.coalesce(F.try_divide("tp", n), F.lit(0.0))), 6)
    return q.select("doc_id", "severity", "tp", (F.col("n_guess") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), rate(F.col("n_guess")).alias("precision"), rate(F.col("n_truth")).alias("recall"), F.round(F.when(none, 1.0).otherwise(2.0 * F.col("tp") / (F.col("n_guess") + F.col("n_truth"))), 6).alias("f1"))


@found.add(f"""WITH {TURNS_SQL}, names AS (SELECT doc_id, line, lower(text) AS src, lead(lower(text)) OVER (PARTITION BY doc_id, line ORDER BY pos) AS dst FROM leaves WHERE type IN ('word', 'mixed')),
edges AS (SELECT DISTINCT conv_id, turn, src, dst FROM names JOIN turns USING (doc_id) WHERE dst IS NOT NULL), size AS (SELECT conv_id, turn, count(*) AS n FROM edges GROUP BY ALL),
hits AS (SELECT a.conv_id, a.turn, count(*) AS tp FROM edges a JOIN edges b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.src = b.src AND a.dst = b.dst GROUP BY a.conv_id, a.turn)
SELECT l.conv_id, l.turn, coalesce(tp, 0) AS tp, r.n - coalesce(tp, 0) AS fp, l.n - coalesce(tp, 0) AS fn, round(coalesce(tp, 0) / r.n, 6) AS precision, round(coalesce(tp, 0) / l.n, 6) AS recall, round(2.0 * coalesce(tp, 0) / (l.n + r.n), 6) AS f1
FROM size l JOIN size r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1 LEFT JOIN hits h ON h.conv_id = l.conv_id AND h.turn = l.turn""")
def edge_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from each name to the next one in its line: those of a turn against those of the following turn."""
    from pyspark.sql import Window

    talk = turns(spark, folder)
    names = trees.leaves(talk, keep=["conv_id", "turn"]).where(F.col("type").isin("word", "mixed"))
    follow = F.lead(F.lower("text")).over(Window.partitionBy("doc_id", "line").orderBy("pos"))
    edges = names.select("conv_id", "turn", F.lower("text").alias("src"), follow.alias("dst")).where("dst IS NOT NULL").distinct()
    size = edges.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    back = lambda r: r.withColumn("turn", F.col("turn") - 1)
    hits = edges.join(back(edges), ["conv_id", "turn", "src", "dst"]).groupBy("conv_id", "turn").agg(F.count("*").alias("tp"))
    q = size.withColumnRenamed("n", "n1").join(back(size).withColumnRenamed("n", "n2"), ["conv_id", "turn"]).join(hits, ["conv_id", "turn"], "left").na.fill(0, ["tp"])
    return q.select("conv_id", "turn", "tp", (F.col("n2") - F.col("tp")).alias("fp"), (F.col("n1") - F.col("tp")).alias("fn"), F.round(F.col("tp") / F.col("n2"), 6).alias("precision"), F.round(F.col("tp") / F.col("n1"), 6).alias("recall"), F.round(2.0 * F.col("tp") / (F.col("n1") + F.col("n2")), 6).alias("f1"))
