"""Queries over unified statement trees of conversation turns, each with the same in SQL: unification, sizes, aligned types, paths, features, texts, completeness, corruption."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators import edit_distance as ed
from treeloom.operators import node_tables as nt
from treeloom.operators import reports
from treeloom.plans.common import Queries
from treeloom.plans.statement_queries import LANGUAGES, STATEMENTS_SQL, read_statements, statement_nodes, statement_trees, with_language
from treeloom.plans.tree_queries import SEVERITIES, turns
from treeloom.sources.files import read_trees
from treeloom.sources.sinks import write_trees
from treeloom.sources.tables import kept, shared_dir

found = Queries()

RULES = nt.Rules(aliases={"identifier": "variable", "number": "literal", "block": "function"}, remove=("and", "the", "de", "la", "und"), skip=("expression", "call"))

# Categories of elements and the types that belong to each, beside their aliases; types by name; C#'s narrower TYPE.
CATEGORIES = {
    "VAR": ("variable", "identifier", "field_identifier", "property_identifier", "package_identifier", "scoped_identifier", "statement_identifier", "name", "variable_name", "qualified_name", "instance_variable", "class_variable", "global_variable", "dynamic_variable_name", "label_name"),
    "TYPE": ("type", "number", "string", "boolean", "null", "literal", "int", "integer", "float", "double", "long", "decimal", "bool", "char", "byte", "short", "void", "array", "list", "set", "dictionary", "object"),
    "EXPR": ("expression", "call", "argument", "return", "literal", "number", "string", "boolean", "null", "array", "list", "set", "dictionary", "object", "pattern", "regex", "binary_expression", "unary_expression", "assignment_expression", "member_expression", "selector_expression", "field_expression", "parenthesized_expression", "conditional_expression", "ternary_expression", "await_expression", "yield_expression"),
    "ASSIGN": ("assignment", "=", "assignment_statement", "assignment_expression", "augmented_assignment", "augmented_assignment_expression", "compound_assignment_expr", "operator_assignment", "variable_declaration", "variable_declarator", "local_variable_declaration", "lexical_declaration", "let_declaration", "var_declaration", "short_var_declaration", "const_declaration", "const_spec", "init_declarator", "declaration"),
    "CTRL": ("if", "else", "switch", "case", "default", "for", "while", "break", "continue", "try", "catch", "finally", "with", "throw", "raise", "return", "exit", "elif", "elseif", "elsif", "do_statement", "foreach_statement", "enhanced_for_statement", "match_expression", "match"),
    "SUBP": ("function", "parameter", "method", "method_declaration", "function_declaration", "function_definition", "constructor_declaration", "lambda", "lambda_expression", "anonymous_function", "arrow_function", "generator_function", "generator_function_declaration", "formal_parameter", "formal_parameters", "parameter_list", "parameters", "method_parameters"),
    "OOP": ("class", "class_declaration", "class_definition", "interface_declaration", "struct_declaration", "struct_item", "enum_declaration", "enum_item", "trait_item", "impl_item", "implementation_item", "anonymous_class", "extends", "implements"),
}
BY_LANGUAGE = {"cs": {"TYPE": ("type", "int", "integer", "float", "double", "long", "decimal", "bool", "boolean", "char", "byte", "short", "void", "string")}}
TYPE_TEXTS = ("int", "integer", "float", "double", "long", "decimal", "bool", "boolean", "char", "byte", "short", "void", "string")
VIEWS = {"code": [c for c in CATEGORIES if c != "OOP"], "all": list(CATEGORIES), "oop": ["OOP"]}

_list = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_case = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RULES.aliases.items()) + f" ELSE {c} END"
_CLEAN = r"regexp_replace(lower(regexp_replace(replace(type, '$', ''), '^\s+|\s+$', '', 'g')), ':=', '=', 'g')"
_PLAIN = r"regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), '^\s+|\s+$', '', 'g'), ' {2,}', ' ', 'g')"
_SAID = rf"regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace({_PLAIN}, '[$@]', '', 'g'), '^;+|;+$', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), '^\s+|\s+$', '', 'g'), ' {{2,}}', ' ', 'g')"
UNIFIED_SQL = rf"""{STATEMENTS_SQL},
u_base AS (SELECT doc_id, node_id, last_id, parent_id, type AS raw, {_case(_CLEAN)} AS type, {_SAID} AS text FROM nodes),
u_marked AS (SELECT *, type <> 'type' AND (lower(text) IN ({_list(RULES.remove)}) OR type IN ({_list(RULES.remove)})) AS gone, (lower(raw) IN ({_list(nt.PUNCTUATION)}) AND (text = '' OR text = lower(raw))) OR (text = '' AND type = '') AS hollow FROM u_base),
u_alive AS (SELECT * FROM u_marked n WHERE NOT EXISTS (SELECT 1 FROM u_marked g WHERE g.doc_id = n.doc_id AND g.gone AND n.node_id BETWEEN g.node_id AND g.last_id)),
u_solid AS (SELECT * FROM u_alive n WHERE NOT hollow OR EXISTS (SELECT 1 FROM u_alive s WHERE s.doc_id = n.doc_id AND NOT s.hollow AND s.node_id > n.node_id AND s.node_id <= n.last_id)),
u_counts AS (SELECT doc_id, parent_id AS node_id, count(*) AS n FROM u_solid GROUP BY ALL),
u_counted AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(n, 0) = 1 AND raw IN ({_list(RULES.skip)}) AS through, regexp_replace(regexp_replace(text, '[ \t\n()]', '', 'g'), ';+$', '') AS bare FROM u_solid s LEFT JOIN u_counts USING (doc_id, node_id)),
u_says AS (SELECT p.doc_id, p.node_id, arg_min(c.bare, c.node_id) AS says FROM u_counted p JOIN u_counted c ON c.doc_id = p.doc_id AND c.node_id > p.node_id AND c.node_id <= p.last_id AND NOT c.through WHERE p.n = 1 GROUP BY ALL),
u_left AS (SELECT doc_id, node_id, last_id, CASE WHEN raw IN ({_list(RULES.skip)}) AND n > 0 THEN 'expression' ELSE type END AS type, text FROM u_counted LEFT JOIN u_says USING (doc_id, node_id) WHERE NOT through AND NOT (n = 1 AND type NOT IN ({_list(nt.ROOTS)}) AND coalesce(bare = says, false))),
u_depths AS (SELECT n.doc_id, n.node_id, count(a.node_id) AS depth, max(a.node_id) AS parent_id FROM u_left n LEFT JOIN u_left a ON a.doc_id = n.doc_id AND a.node_id < n.node_id AND n.node_id <= a.last_id GROUP BY ALL),
unified AS (SELECT l.doc_id, l.node_id, l.last_id, depth::INTEGER AS depth, coalesce(parent_id, -1) AS parent_id, (row_number() OVER (PARTITION BY l.doc_id, parent_id ORDER BY l.node_id) - 1)::INTEGER AS pos, type, text,
  NOT coalesce(lead(depth) OVER (PARTITION BY l.doc_id ORDER BY l.node_id) > depth, false) AS leaf FROM u_left l JOIN u_depths USING (doc_id, node_id))"""
_PATHS_SQL = """o_paths AS (SELECT doc_id, node_id, type, '' AS place, type AS line, n_children = 0 AS leaf FROM nodes WHERE depth = 0 UNION ALL SELECT c.doc_id, c.node_id, c.type, p.place || '.' || c.pos, p.line || '>' || c.type, c.n_children = 0 FROM o_paths p JOIN nodes c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id),
u_paths AS (SELECT doc_id, node_id, type, '' AS place, type AS line, leaf FROM unified WHERE depth = 0 UNION ALL SELECT c.doc_id, c.node_id, c.type, p.place || '.' || c.pos, p.line || '>' || c.type, c.leaf FROM u_paths p JOIN unified c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id)"""


def unified_nodes(nodes: DataFrame) -> DataFrame:
    """Unified statement trees; written once."""
    return kept(nt.unify(nodes, "doc_id", RULES), "unified-statements")


@found.add(f"WITH {UNIFIED_SQL} SELECT doc_id, node_id, last_id, depth, type, text, leaf FROM unified")
def unify_statements(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the turns' unified statement trees."""
    return nt.unify(statement_nodes(spark, folder), "doc_id", RULES).select("doc_id", "node_id", "last_id", "depth", "type", "text", "leaf")


_WORDS_SQL = r"sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT"


@found.add(f"""WITH {UNIFIED_SQL}, o AS (SELECT doc_id, count(*) AS n, {_WORDS_SQL} AS a FROM nodes GROUP BY doc_id), u AS (SELECT doc_id, count(*) AS n, {_WORDS_SQL} AS a FROM unified GROUP BY doc_id)
SELECT doc_id, o.n AS n_original, coalesce(u.n, 0) AS n_unified, round_even(coalesce(u.n, 0) / o.n, 4) AS compression_ratio, round_even(1 - coalesce(u.n, 0) / o.n, 4) AS compression_gain, o.a AS attributes_original, coalesce(u.a, 0) AS attributes_unified,
  CASE WHEN o.a = 0 THEN 0.0 ELSE round_even(1 - coalesce(u.a, 0) / (o.a + 1e-9), 4) END AS attribute_loss FROM o LEFT JOIN u USING (doc_id)""")
def statement_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Compression and loss of words by unification, of each turn's tree."""
    nodes = statement_nodes(spark, folder)
    u = nt.attributes(unified_nodes(nodes), "doc_id", "attributes_unified").withColumnRenamed("n_nodes", "n_unified")
    both = nt.attributes(nodes, "doc_id", "attributes_original").withColumnRenamed("n_nodes", "n_original").join(u, "doc_id", "left").na.fill(0)
    ratio, loss = F.col("n_unified") / F.col("n_original"), 1 - F.col("attributes_unified") / (F.col("attributes_original") + 1e-9)
    return both.select("doc_id", "n_original", "n_unified", F.bround(ratio, 4).alias("compression_ratio"), F.bround(1 - ratio, 4).alias("compression_gain"), "attributes_original", "attributes_unified", F.when(F.col("attributes_original") == 0, 0.0).otherwise(F.bround(loss, 4)).alias("attribute_loss"))


@found.add(f"""WITH RECURSIVE {UNIFIED_SQL}, {_PATHS_SQL}
SELECT o.doc_id, o.type AS removed_type, count(*) AS n FROM o_paths o LEFT JOIN u_paths u USING (doc_id, place) WHERE u.type IS NULL OR u.type <> o.type GROUP BY o.doc_id, o.type""")
def statement_removed_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types whose place holds another type, or nothing, after unification."""
    nodes = statement_nodes(spark, folder)
    return nt.changed_types(nodes, unified_nodes(nodes), "doc_id")


@found.add(f"""WITH RECURSIVE {UNIFIED_SQL}, {_PATHS_SQL}, sets AS (SELECT DISTINCT doc_id, line FROM u_paths WHERE leaf), n AS (SELECT t.doc_id, count(line) AS n FROM turns t LEFT JOIN sets USING (doc_id) GROUP BY t.doc_id),
shared AS (SELECT a.doc_id, count(*) AS s FROM sets a JOIN sets b ON b.doc_id = a.doc_id + 1 AND b.line = a.line GROUP BY a.doc_id)
SELECT a.doc_id, round(CASE WHEN a.n + b.n = 0 THEN 1.0 ELSE coalesce(s, 0) / (a.n + b.n - coalesce(s, 0)) END, 6) AS path_jaccard FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 LEFT JOIN shared s ON s.doc_id = a.doc_id""")
def statement_path_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Shared paths of types of each turn's unified tree and the next one's."""
    sets = turns(spark, folder).select("doc_id").join(nt.path_sets(nt.unify(statement_nodes(spark, folder), "doc_id", RULES), "doc_id"), "doc_id", "left")
    sets = kept(sets, "path-sets")
    pairs = sets.join(sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("paths").alias("next")), "doc_id")
    return pairs.select("doc_id", F.round(nt.jaccard(F.col("paths"), F.col("next")), 6).alias("path_jaccard"))


@found.add(f"WITH RECURSIVE {UNIFIED_SQL}, {_PATHS_SQL}, counted AS (SELECT doc_id, line, count(*) AS n FROM u_paths WHERE leaf GROUP BY ALL) SELECT line AS path, count(*) AS turns, sum(n)::BIGINT AS n FROM counted GROUP BY line")
def statement_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of types from the roots to the leaves of the unified trees."""
    paths = nt.label_paths(nt.unify(statement_nodes(spark, folder), "doc_id", RULES), "doc_id")
    return paths.groupBy("path").agg(F.count("*").alias("turns"), F.sum("n").alias("n"))


_TOKEN = r"coalesce(nullif(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'empty')"


@found.add(rf"""WITH {UNIFIED_SQL}, said AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM unified)
SELECT doc_id, string_agg(type || CASE WHEN leaf AND t <> '' THEN ' ' || t ELSE '' END, ' ' ORDER BY node_id) AS flat, string_agg('node_' || {_TOKEN.format('type')} || CASE WHEN leaf AND t <> '' THEN ' leaf_' || {_TOKEN.format('t')} ELSE '' END, ' ' ORDER BY node_id) AS labelled FROM said GROUP BY doc_id""")
def statement_flat_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Both one-line forms of the unified trees."""
    nodes = unified_nodes(statement_nodes(spark, folder))
    return nt.flat_texts(nodes, "doc_id").join(nt.flat_texts(nodes, "doc_id", labelled=True, to="labelled"), "doc_id")


@found.add(rf"""WITH {STATEMENTS_SQL}, led AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY node_id), 0) AS following, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM nodes)
SELECT doc_id, string_agg(repeat('  ', depth) || type, chr(10) ORDER BY node_id) AS indented, max(text) FILTER (depth = 0) AS root_text, string_agg(text, '' ORDER BY node_id) FILTER (n_children = 0) AS leaf_texts,
  string_agg(CASE WHEN depth > 0 THEN ' ' ELSE '' END || CASE WHEN n_children > 0 THEN '(' || type ELSE CASE WHEN type IN ('variable', 'integer', 'number') THEN type || ':' || t WHEN t <> '' THEN t ELSE type END || repeat(')', depth - following) END, '' ORDER BY node_id) AS bracketed FROM led GROUP BY doc_id""")
def statement_prints(spark: SparkSession, folder: str) -> DataFrame:
    """The turns' trees indented, in brackets, and as the texts they stand for, with and without the root's."""
    nodes = statement_nodes(spark, folder)
    bare = nt.source_text(nodes.withColumn("text", F.when(F.col("depth") == 0, "").otherwise(F.col("text"))), "doc_id", "leaf_texts")
    # A root alone has no other leaf than itself.
    alone = nodes.where("depth = 0").select("doc_id", (F.col("n_children") == 0).alias("alone"), F.col("text").alias("own"))
    shown = nt.indented(nodes, "doc_id").join(nt.bracketed(nodes, "doc_id"), "doc_id").join(nt.source_text(nodes, "doc_id", "root_text"), "doc_id").join(bare, "doc_id").join(alone, "doc_id")
    return shown.select("doc_id", "indented", "bracketed", F.when(F.col("own") == "", "").otherwise(F.col("root_text")).alias("root_text"), F.when(F.col("alone"), F.col("own")).otherwise(F.col("leaf_texts")).alias("leaf_texts"))


@found.add(rf"""WITH {STATEMENTS_SQL}, p AS (SELECT c.*, p.type AS p1, p.parent_id AS g, {_TOKEN.format('c.type')} AS k, {_TOKEN.format('p.type')} AS kp FROM nodes c LEFT JOIN nodes p ON p.doc_id = c.doc_id AND p.node_id = c.parent_id),
up AS (SELECT n.doc_id, n.node_id, string_agg({_TOKEN.format('a.type')}, '_' ORDER BY a.node_id) AS path FROM nodes n JOIN nodes a ON a.doc_id = n.doc_id AND n.node_id BETWEEN a.node_id AND a.last_id WHERE n.n_children = 0 GROUP BY ALL),
f AS (SELECT doc_id, unnest([ 'node_' || k, 'depth_' || least(depth, 8) || '_' || k, 'arity_' || k || '_' || least(n_children, 8)]) AS feature FROM p UNION ALL SELECT doc_id, 'edge_' || kp || '_' || k FROM p WHERE depth > 0 UNION ALL SELECT doc_id, 'path_' || path FROM up),
counted AS (SELECT doc_id, feature, count(*) AS n FROM f GROUP BY ALL) SELECT feature, count(*) AS turns, sum(n)::BIGINT AS n FROM counted GROUP BY feature""")
def statement_features(spark: SparkSession, folder: str) -> DataFrame:
    """Structural features of the turns' statement trees."""
    features = nt.structural_features(statement_nodes(spark, folder), "doc_id")
    return features.groupBy("feature").agg(F.count("*").alias("turns"), F.sum("n").alias("n"))


_CATEGORY_ROWS = nt.category_rows(CATEGORIES, BY_LANGUAGE)
_TABLE_SQL = "categories(language, type, category) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _CATEGORY_ROWS) + ")"


def _found_sql(name: str, source: str, kind: str) -> str:
    raw = _CLEAN.replace("type", f"n.{kind}", 1)
    canonical = f"CASE WHEN {_case(raw)} = 'program' THEN 'module' ELSE {_case(raw)} END"
    typed = f"lower(n.text) IN ({_list(TYPE_TEXTS)}) AND ({_case(raw)} = 'type' OR {raw} IN ({_list(TYPE_TEXTS)}) OR {raw} LIKE '%\\_type' ESCAPE '\\')"
    return f"""{name}_kinds AS (SELECT DISTINCT n.doc_id, CASE WHEN t.language = 'cs' THEN 'cs' ELSE '' END AS language, {raw} AS raw, {canonical} AS canonical, {typed} AS typed FROM {source} n JOIN turns t USING (doc_id)),
{name} AS (SELECT DISTINCT k.doc_id, c.category FROM {name}_kinds k JOIN categories c ON c.language = k.language AND c.type IN (k.raw, k.canonical) UNION SELECT doc_id, 'TYPE' FROM {name}_kinds WHERE typed)"""


def _views_sql() -> str:
    parts = []
    for view, wanted in VIEWS.items():
        w = f"category IN ({_list(wanted)})"
        score = f"CASE WHEN count(*) FILTER (o AND {w}) = 0 THEN 1.0 ELSE count(*) FILTER (o AND u AND {w}) / count(*) FILTER (o AND {w}) END"
        parts.append(f"""count(*) FILTER (o AND {w})::INTEGER AS had_{view}, count(*) FILTER (o AND u AND {w})::INTEGER AS kept_{view}, round_even({score}, 4) AS pec_{view}, round_even(1 - ({score}), 4) AS loss_{view},
  coalesce(string_agg(category, ',' ORDER BY category) FILTER (o AND NOT u AND {w}), '') AS lost_{view}, coalesce(string_agg(category, ',' ORDER BY category) FILTER (u AND NOT o AND {w}), '') AS extra_{view}""")
    return ", ".join(parts)


_PEC_SQL = f"{_TABLE_SQL}, {_found_sql('had', 'nodes', 'type')}, {_found_sql('has', 'unified', 'type')}"


@found.add(f"""WITH {UNIFIED_SQL}, {_PEC_SQL}, both_sides AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.category, b.category) AS category, a.doc_id IS NOT NULL AS o, b.doc_id IS NOT NULL AS u FROM had a FULL JOIN has b ON a.doc_id = b.doc_id AND a.category = b.category),
grid AS (SELECT t.doc_id, b.category, coalesce(o, false) AS o, coalesce(u, false) AS u FROM turns t LEFT JOIN both_sides b USING (doc_id)) SELECT doc_id, {_views_sql()} FROM grid GROUP BY doc_id""")
def statement_pec(spark: SparkSession, folder: str) -> DataFrame:
    """Completeness of the unified trees by the categories of each turn's language: without classes, with them, and of them alone."""
    nodes = statement_nodes(spark, folder)
    table = spark.createDataFrame(_CATEGORY_ROWS, "language string, type string, category string")
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    spoken = turns(spark, folder).select("doc_id", F.try_element_at(named, F.col("role")).alias("language"))
    of = lambda rows: nt.table_categories(rows.join(spoken, "doc_id"), "doc_id", table, RULES.aliases, TYPE_TEXTS, F.col("language"))
    return nt.completeness(of(nodes), of(unified_nodes(nodes)), "doc_id", VIEWS).drop("strange")


_DEGRADED_SQL = rf"""{STATEMENTS_SQL}, d_paths AS (SELECT doc_id, node_id, []::BIGINT[] AS place FROM nodes WHERE depth = 0 UNION ALL SELECT c.doc_id, c.node_id, list_append(p.place, c.pos) FROM d_paths p JOIN nodes c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id),
d_text AS (SELECT doc_id, node_id, '(' || array_to_string(place, ', ') || CASE WHEN len(place) = 1 THEN ',' ELSE '' END || ')' AS path FROM d_paths),
d_drawn AS (SELECT n.*, ('0x' || substr(sha256('pec|turns|' || doc_id || '|' || path || '|drop'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS dropped, ('0x' || substr(sha256('pec|turns|' || doc_id || '|' || path || '|node'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS h FROM nodes n JOIN d_text USING (doc_id, node_id)),
d_each AS (SELECT *, unnest([{", ".join(map(str, SEVERITIES))}])::DOUBLE AS severity FROM d_drawn),
d_marked AS (SELECT *, depth > 0 AND dropped < severity AND NOT (max(dropped) OVER w < severity AND row_number() OVER (PARTITION BY doc_id, severity, parent_id ORDER BY dropped, pos) = 1) AS dead FROM d_each WINDOW w AS (PARTITION BY doc_id, severity, parent_id)),
degraded AS (SELECT doc_id, severity, node_id, depth, CASE WHEN depth > 0 AND h < 0.55 * severity THEN 'masked_' || {_TOKEN.format('type').replace("'empty'", "'node'")} ELSE type END AS type, CASE WHEN h < 0.70 * severity THEN '' ELSE text END AS text
  FROM d_marked n WHERE NOT EXISTS (SELECT 1 FROM d_marked g WHERE g.doc_id = n.doc_id AND g.severity = n.severity AND g.dead AND n.node_id BETWEEN g.node_id AND g.last_id))"""


def _degraded(nodes: DataFrame) -> DataFrame:
    """Statement trees, corrupted by each severity."""
    return nt.degraded(nodes, "doc_id", SEVERITIES, F.concat(F.lit("pec|turns|"), F.col("doc_id").cast("string")), ordered=True)


@found.add(f"WITH RECURSIVE {_DEGRADED_SQL} SELECT doc_id, severity, node_id, depth, type, text FROM degraded")
def degrade_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's statement tree, corrupted by each severity."""
    return _degraded(read_statements(spark, folder)).select("doc_id", "severity", "node_id", "depth", "type", "text")


@found.add()
def statement_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Completeness and similarity to the next turn's tree, of each corrupted turn: means by severity, and how far below no corruption."""
    # Of texts, only those that name a type count.
    texts = F.when(F.lower("text").isin(*TYPE_TEXTS), F.col("text")).otherwise("")
    read = read_statements(spark, folder).withColumn("text", texts)
    nodes = kept(read.select("doc_id", "node_id", "depth", "type", "text"), "typed-nodes")
    bad = kept(_degraded(read).select("doc_id", "severity", "node_id", "depth", "type", "text"), "degraded")
    table = spark.createDataFrame(_CATEGORY_ROWS, "language string, type string, category string")
    # A root is never lost, so each tree has all severities.
    tree = F.struct("doc_id", "severity").alias("tree")
    levels = F.explode(F.array(*[F.lit(s).cast("double") for s in SEVERITIES]))
    had = nt.table_categories(nodes, "doc_id", table, RULES.aliases, TYPE_TEXTS).withColumn("severity", levels).select(tree, "found", "strange")
    bad = bad.select(tree, "node_id", "depth", "type", "text")
    pec = nt.completeness(had, nt.table_categories(bad, "tree", table, RULES.aliases, TYPE_TEXTS), "tree", {"all": list(CATEGORIES)}).select("tree", F.lit("pec").alias("metric"), F.col("pec_all").alias("value"))
    whole = nt.sequences(nodes, "doc_id", to="other").select((F.col("doc_id") - 1).alias("doc_id"), "other")
    pairs = nt.sequences(bad, "tree", to="own").withColumn("doc_id", F.col("tree.doc_id")).join(whole, "doc_id")
    like = ed.edit_similarity(pairs, "tree", "own", "other").select("tree", F.lit("clsa").alias("metric"), F.col("similarity").alias("value"))
    rows = kept(pec.unionByName(like).select("metric", F.col("tree.doc_id").alias("doc_id"), F.col("tree.severity").alias("severity"), "value"), "sensitivity")
    base = rows.where("severity = 0").select("metric", "doc_id", F.col("value").alias("baseline"))
    each = rows.join(base, ["metric", "doc_id"]).withColumn("delta", F.col("value") - F.col("baseline"))
    return each.groupBy("metric", "severity").agg(F.count("*").alias("sample_count"), F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("delta"), 6).alias("delta"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))


@found.add(f"""WITH {STATEMENTS_SQL} SELECT language, type, count(*) AS n_nodes, count(DISTINCT doc_id) AS n_trees, sum(depth)::BIGINT AS depths, sum(strlen(nodes.text))::BIGINT AS n_bytes FROM nodes JOIN turns USING (doc_id) GROUP BY language, type""")
def tree_files(spark: SparkSession, folder: str) -> DataFrame:
    """All turns' statement trees written as JSON files by language, read back and flattened: nodes by language and type."""
    path = f"{shared_dir(spark)}/treeloom/trees-{uuid.uuid4().hex}"
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    made = statement_trees(turns(spark, folder)).withColumn("language", F.try_element_at(named, F.col("role")))
    write_trees(made.select("doc_id", "tree", "language"), path, "doc_id", "tree", ["language"])
    read = read_trees(spark, path, "doc_id").select(F.struct("language", "doc_id").alias("turn"), "tree")
    nodes = nt.read_nodes(read, "turn", "tree", "json")
    return nodes.groupBy("turn.language", "type").agg(F.count("*").alias("n_nodes"), F.countDistinct("turn.doc_id").alias("n_trees"), F.sum("depth").cast("long").alias("depths"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@found.add(f"""WITH {UNIFIED_SQL}, o AS (SELECT doc_id, count(*) AS n, {_WORDS_SQL} AS a, string_agg(repeat('  ', depth) || type, chr(10) ORDER BY node_id) AS shown FROM nodes GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n, {_WORDS_SQL} AS a, string_agg(repeat('  ', depth) || type, chr(10) ORDER BY node_id) AS shown FROM unified GROUP BY doc_id)
SELECT 'conversations' AS dataset, language, role AS split, doc_id AS row_id, sha256(coalesce(turns.text, '')) AS code_sha256, sha256(o.shown) AS original_sha256, sha256(coalesce(u.shown, '')) AS unified_sha256,
  '{{"representation":{{"nodes":{{"original":' || o.n || ',"unified":' || coalesce(u.n, 0) || '}},"attributes":{{"original":' || o.a || ',"unified":' || coalesce(u.a, 0) || '}}}}}}' AS summary,
  '{{"measurement_count":1,"runs":[{{"stage":"original","nodes":' || o.n || '}},{{"stage":"unified","nodes":' || coalesce(u.n, 0) || '}}],"columns":{{"nodes":"nodes of a tree","attributes":"words of its texts"}}}}' AS raw_runs
FROM turns JOIN o USING (doc_id) LEFT JOIN u USING (doc_id)""")
def measurement_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn's measurements as nested JSON of a summary and of its runs, beside hashes of its text and of both trees."""
    nodes = statement_nodes(spark, folder)
    unified = unified_nodes(nodes)
    of = lambda rows, p: nt.attributes(rows, "doc_id", f"{p}_words").withColumnRenamed("n_nodes", f"{p}_nodes").join(nt.indented(rows, "doc_id", f"{p}_shown"), "doc_id")
    rows = of(nodes, "o").join(of(unified, "u"), "doc_id", "left").na.fill(0, ["u_nodes", "u_words"]).na.fill("", ["u_shown"])
    return reports.audit_rows(with_language(rows, spark, folder).join(turns(spark, folder).select("doc_id", "role", "text"), "doc_id"), {
        "dataset": F.lit("conversations"), "language": F.col("language"), "split": F.col("role"), "row_id": F.col("doc_id"),
    }, {"code": F.col("text"), "original": F.col("o_shown"), "unified": F.col("u_shown")}, {
        "representation": {"nodes": {"original": F.col("o_nodes"), "unified": F.col("u_nodes")}, "attributes": {"original": F.col("o_words"), "unified": F.col("u_words")}},
    }, [{"stage": F.lit(stage), "nodes": F.col(f"{stage[0]}_nodes")} for stage in ("original", "unified")], {"nodes": "nodes of a tree", "attributes": "words of its texts"})


STAGES = {"types": {"texts": False, "compress": False}, "texts": {"types": False, "compress": False}, "types_texts": {"compress": False}, "full": {}}
_STAGES_SQL = f"""{UNIFIED_SQL}, s_types AS (SELECT doc_id, {_case(_CLEAN)} AS type, {_PLAIN} AS text FROM nodes), s_texts AS (SELECT doc_id, type, {_SAID} AS text FROM nodes),
s_types_texts AS (SELECT doc_id, {_case(_CLEAN)} AS type, {_SAID} AS text FROM nodes), s_full AS (SELECT doc_id, type, text FROM unified),
{_TABLE_SQL}, {_found_sql("had", "nodes", "type")}, {", ".join(_found_sql(f"has_{v}", f"s_{v}", "type") for v in STAGES)},
s_has AS ({" UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM has_{v}" for v in STAGES)}),
s_sizes AS ({" UNION ALL ".join(f"SELECT '{v}' AS variant, doc_id, count(*) AS n, {_WORDS_SQL} AS words FROM s_{v} GROUP BY doc_id" for v in STAGES)}),
s_whole AS (SELECT doc_id, count(*) AS n_original, {_WORDS_SQL} AS words_original FROM nodes GROUP BY doc_id),
s_trees AS (SELECT variant, doc_id, language, n_original, words_original FROM s_whole JOIN turns USING (doc_id), (VALUES {", ".join(f"('{v}')" for v in STAGES)}) v(variant))"""


@found.add(f"""WITH {_STAGES_SQL}, s_pec AS (SELECT s.variant, s.doc_id, {", ".join(f"CASE WHEN count(h.category) FILTER ({w}) = 0 THEN 1.0 ELSE count(x.category) FILTER ({w}) / count(h.category) FILTER ({w}) END AS {v}" for v, w in (("code", "h.category <> 'OOP'"), ("whole", "true")))}
  FROM s_trees s LEFT JOIN had h USING (doc_id) LEFT JOIN s_has x ON x.variant = s.variant AND x.doc_id = h.doc_id AND x.category = h.category GROUP BY s.variant, s.doc_id)
SELECT variant, language, count(*) AS sample_count, round(avg(coalesce(n, 0)), 6) AS avg_nodes, round(avg(coalesce(n, 0) / n_original), 6) AS structure_ratio, round(1 - avg(coalesce(n, 0) / n_original), 6) AS structure_gain,
  round(sum(words_original - coalesce(words, 0)) / greatest(sum(words_original), 1), 6) AS words_lost, round(avg(code), 6) AS pec_code, round(avg(whole), 6) AS pec_all
FROM s_trees JOIN s_pec USING (variant, doc_id) LEFT JOIN s_sizes USING (variant, doc_id) GROUP BY variant, language""")
def statement_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """Means of each stage of unification by the turns' language: nodes, structure, words lost, completeness without and with classes."""
    nodes = statement_nodes(spark, folder)
    spoken = with_language(nodes.select("doc_id").distinct(), spark, folder)
    variant = F.explode(F.array(*map(F.lit, STAGES)))
    stages = [nt.unify(nodes, "doc_id", RULES, **flags).withColumn("variant", F.lit(name)) for name, flags in STAGES.items()]
    left = kept(reduce(DataFrame.unionByName, stages).withColumn("tree", F.struct("variant", "doc_id")), "stages")
    table = spark.createDataFrame(_CATEGORY_ROWS, "language string, type string, category string")
    of = lambda rows, key: nt.table_categories(rows.join(spoken, "doc_id"), key, table, RULES.aliases, TYPE_TEXTS, F.col("language"))
    had = of(nodes, "doc_id").withColumn("variant", variant).withColumn("tree", F.struct("variant", "doc_id")).drop("variant", "doc_id")
    pec = nt.completeness(had, of(left, "tree"), "tree", {v: VIEWS[v] for v in ("code", "all")})
    share = lambda v: F.when(F.col(f"had_{v}") == 0, 1.0).otherwise(F.col(f"kept_{v}") / F.col(f"had_{v}"))
    sizes = nt.attributes(left, "tree", "words").withColumnRenamed("n_nodes", "n")
    whole = nt.attributes(nodes, "doc_id", "words_original").withColumnRenamed("n_nodes", "n_original").join(spoken, "doc_id")
    trees = whole.withColumn("variant", variant).withColumn("tree", F.struct("variant", "doc_id"))
    rows = trees.join(pec, "tree").join(sizes, "tree", "left").na.fill(0, ["n", "words"])
    ratio, lost = F.avg(F.col("n") / F.col("n_original")), F.sum(F.col("words_original") - F.col("words")) / F.greatest(F.sum("words_original"), F.lit(1))
    means = {"avg_nodes": F.avg("n"), "structure_ratio": ratio, "structure_gain": 1 - ratio, "words_lost": lost, "pec_code": F.avg(share("code")), "pec_all": F.avg(share("all"))}
    return rows.groupBy("variant", "language").agg(F.count("*").alias("sample_count"), *[F.round(v, 6).alias(k) for k, v in means.items()])
