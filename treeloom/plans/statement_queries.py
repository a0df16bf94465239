"""Queries over statement trees of conversation turns: five levels, made from each text by rules, read back as JSON.

A turn is a program of lines (functions where they have several clauses, else
blocks); clauses are assignments (with a capital first), calls, expressions, or
the return that ends a function; an assignment's first word is the variable of
its parameter. ``STATEMENTS_SQL`` makes the same node rows in DuckDB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import registered
from treeloom.functions import text as tx
from treeloom.operators import code_trees as ct
from treeloom.operators import node_tables as nt
from treeloom.plans.common import Queries
from treeloom.plans.tree_queries import turns
from treeloom.sources.tables import kept

found = Queries()

CLAUSE = r"[^,;:.!?]*[,;:.!?]+|[^,;:.!?]+"
LANGUAGES = {"user": "python", "assistant": "java", "system": "cs"}
NAMES = ct.Names(reserved={"python": ("and", "as", "in", "is", "not", "or"), "java": ("do", "this", "super"), "cs": ("as", "in", "is", "out", "ref")})

STATEMENTS_SQL = rf"""turns AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, role, text, CASE role WHEN 'user' THEN 'python' WHEN 'assistant' THEN 'java' WHEN 'system' THEN 'cs' END AS language FROM conversations),
t_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, unnest(generate_series(1, len(string_split(text, chr(10))))) AS l FROM turns),
t_clauses AS (SELECT doc_id, l, said, unnest(regexp_extract_all(said, '{CLAUSE}')) AS clause, unnest(generate_series(1, len(regexp_extract_all(said, '{CLAUSE}')))) AS c FROM t_lines),
t_words AS (SELECT doc_id, l, c, said, trim(clause) AS clause, regexp_extract_all(clause, '{tx.LEAF}') AS ts FROM t_clauses),
t_kept AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY l) AS l, row_number() OVER (PARTITION BY doc_id, l ORDER BY c) AS c, count(*) OVER (PARTITION BY doc_id, l) AS n_c, said, clause, ts FROM t_words WHERE len(ts) > 0),
t_typed AS (SELECT *, CASE WHEN c = n_c AND n_c > 1 THEN 'return' WHEN regexp_matches(ts[1], '^\p{{Lu}}') THEN 'assignment' WHEN len(ts) % 3 = 0 THEN 'call' ELSE 'expression' END AS kind FROM t_kept),
t_tokens AS (SELECT doc_id, l, c, kind, unnest(ts) AS word, unnest(generate_series(1, len(ts))) AS k FROM t_typed),
t_all AS (
  SELECT doc_id, 0 AS l, 0 AS c, 0 AS k, 0 AS s, 0 AS depth, 'program' AS type, coalesce(text, '') AS text FROM turns
  UNION ALL SELECT doc_id, l, 0, 0, 0, 1, CASE WHEN n_c > 1 THEN 'function' ELSE 'block' END, said FROM t_typed WHERE c = 1
  UNION ALL SELECT doc_id, l, c, 0, 0, 2, kind, clause FROM t_typed
  UNION ALL SELECT doc_id, l, c, k, 0, 3, 'parameter', word FROM t_tokens WHERE kind = 'assignment' AND k = 1
  UNION ALL SELECT doc_id, l, c, k, 1, CASE WHEN kind = 'assignment' AND k = 1 THEN 4 ELSE 3 END, CASE WHEN regexp_matches(word, '^\p{{L}}+$') THEN 'variable' WHEN regexp_matches(word, '^\p{{N}}+$') THEN 'number' WHEN regexp_matches(word, '[\p{{L}}\p{{N}}_]') THEN 'identifier' ELSE word END, word FROM t_tokens
), t_numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY l, c, k, s) - 1)::INTEGER AS node_id FROM t_all),
t_ends AS (SELECT *, max(node_id) OVER (PARTITION BY doc_id) AS end0, max(node_id) OVER (PARTITION BY doc_id, l) AS end1, max(node_id) OVER (PARTITION BY doc_id, l, c) AS end2, max(node_id) OVER (PARTITION BY doc_id, l, c, k) AS end3,
  min(node_id) OVER (PARTITION BY doc_id, l) AS top1, min(node_id) OVER (PARTITION BY doc_id, l, c) AS top2 FROM t_numbered),
t_parents AS (SELECT doc_id, node_id, (CASE depth WHEN 0 THEN end0 WHEN 1 THEN end1 WHEN 2 THEN end2 ELSE end3 END)::INTEGER AS last_id, (CASE depth WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN top1 WHEN 3 THEN top2 ELSE node_id - 1 END)::INTEGER AS parent_id,
  (CASE depth WHEN 0 THEN 0 WHEN 1 THEN l - 1 WHEN 2 THEN c - 1 WHEN 3 THEN k - 1 ELSE 0 END)::INTEGER AS pos, depth::INTEGER AS depth, type, text FROM t_ends),
t_counts AS (SELECT doc_id, parent_id, count(*)::INTEGER AS n FROM t_parents GROUP BY ALL),
nodes AS (SELECT p.*, coalesce(n, 0)::INTEGER AS n_children FROM t_parents p LEFT JOIN t_counts c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id)"""


def statement_trees(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``tree``, the JSON of each text's statements."""
    words = lambda clause: F.regexp_extract_all(clause, F.lit(tx.LEAF), F.lit(0))
    cut = lambda line: F.filter(F.transform(F.regexp_extract_all(line, F.lit(CLAUSE), F.lit(0)), lambda c: F.struct(F.trim(c).alias("text"), words(c).alias("ts"))), lambda c: F.size(c["ts"]) > 0)
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.struct(x.alias("text"), cut(x).alias("cs"))), lambda x: F.size(x["cs"]) > 0)
    none = F.array().cast("array<struct<type: string, text: string>>")
    kind = lambda t: F.when(t.rlike(r"^\p{L}+$"), F.lit("variable")).when(t.rlike(r"^\p{N}+$"), F.lit("number")).when(t.rlike(r"[\p{L}\p{N}_]"), F.lit("identifier")).otherwise(t)
    leaf = lambda t: F.struct(kind(t).alias("type"), t.alias("text"))

    def clause(c, i, n):
        named = F.when((i == n - 1) & (n > 1), "return").when(F.get(c["ts"], 0).rlike(r"^\p{Lu}"), "assignment").when(F.size(c["ts"]) % 3 == 0, "call").otherwise("expression")
        wrapped = lambda t, k: F.when((named == "assignment") & (k == 0), F.struct(F.lit("parameter").alias("type"), t.alias("text"), F.array(leaf(t)).alias("children"))).otherwise(F.struct(kind(t).alias("type"), t.alias("text"), none.alias("children")))
        return F.struct(named.alias("type"), c["text"].alias("text"), F.transform(c["ts"], wrapped).alias("children"))

    def line(x):
        n = F.size(x["cs"])
        return F.struct(F.when(n > 1, "function").otherwise("block").alias("type"), x["text"].alias("text"), F.transform(x["cs"], lambda c, i: clause(c, i, n)).alias("children"))

    made = rows.withColumn("__lines", lines)
    tree = F.struct(F.lit("program").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.transform("__lines", line).alias("children"))
    return made.withColumn("tree", F.to_json(tree)).drop("__lines")


def read_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of all turns' statement trees, by ``doc_id``, tree after tree in pre-order."""
    made = statement_trees(turns(spark, folder)).select("doc_id", "tree")
    return nt.read_nodes(made, "doc_id", "tree", "json").drop("tree")


def statement_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once."""
    return kept(read_statements(spark, folder), "statement-nodes")


def with_language(nodes: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``nodes`` with the language of their turn, which its role gives."""
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return nodes.join(turns(spark, folder).select("doc_id", F.try_element_at(named, F.col("role")).alias("language")), "doc_id")


def rule_table(spark: SparkSession, names: ct.Names = NAMES) -> DataFrame:
    return spark.createDataFrame(names.rows(), "language string, kind string, word string")


@found.add(f"WITH {STATEMENTS_SQL} SELECT doc_id, node_id, last_id, parent_id, pos, depth, type, text, n_children FROM nodes")
def statement_node_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the turns' statement trees, read from JSON."""
    return statement_nodes(spark, folder)


_listed = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_RULES_SQL = "rules(language, kind, word) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in NAMES.rows()) + ")"
_EVENTS_SQL = rf"""{STATEMENTS_SQL}, {_RULES_SQL},
n AS (SELECT nodes.*, language, type IN (SELECT word FROM rules r WHERE r.language = turns.language AND kind = 'variable') AS var, type = 'call' OR type IN (SELECT word FROM rules r WHERE r.language = turns.language AND kind = 'function') AS fun FROM nodes JOIN turns USING (doc_id)),
events AS (
  SELECT doc_id, language, node_id AS a, 0 AS b, 'variable' AS role, text FROM n WHERE var AND n_children = 0
  UNION ALL SELECT p.doc_id, p.language, p.node_id, c.pos, CASE WHEN p.var THEN 'variable' ELSE 'function' END, c.text FROM n p JOIN n c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id
    WHERE (p.var AND NOT c.var) OR (NOT p.var AND p.fun AND c.var AND NOT regexp_matches(lower(p.text), 'public|private|new'))),
cleaned AS (SELECT doc_id, language, a, b, role, CASE WHEN language = 'cs' AND contains(text, '<') AND contains(text, '>') THEN '' ELSE regexp_replace(text, '[^A-Za-z0-9_:\-]', '', 'g') END AS name FROM events),
named AS (SELECT * FROM cleaned WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_\-]*') AND regexp_matches(name, '[A-Za-z]') AND lower(name) NOT IN ({_listed((*ct.IGNORED, *ct.RESERVED_COMMON, *ct.REMOVED_WORDS))}) AND name NOT IN ({_listed(ct.KEY_WORDS)})
  AND name NOT IN (SELECT word FROM rules WHERE kind = 'function' AND rules.language = cleaned.language)
  AND NOT (role = 'variable' AND (lower(name) IN ({_listed(ct.WRAPPERS)}) OR lower(name) IN (SELECT word FROM rules WHERE kind = 'reserved' AND rules.language = cleaned.language)))),
roles AS (SELECT doc_id, name, arg_min(role, a * 100000 + b) AS role FROM named GROUP BY doc_id, name)"""


@found.add(f"WITH {_EVENTS_SQL} SELECT doc_id, name, role FROM roles")
def statement_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Each name of a turn's tree and whether it first was a variable or a function, by the rules of its language."""
    nodes = with_language(statement_nodes(spark, folder), spark, folder)
    return ct.identifiers(nodes, "doc_id", rule_table(spark))


@found.add(f"""WITH {_EVENTS_SQL} SELECT language, roles.role, count(DISTINCT name) AS n_names, count(*) AS n_uses, round(avg(length(name)), 6) AS avg_length FROM roles JOIN turns USING (doc_id) GROUP BY language, roles.role""")
def identifier_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Names by language and role."""
    nodes = with_language(statement_nodes(spark, folder), spark, folder)
    roles = ct.identifiers(nodes, "doc_id", rule_table(spark)).join(nodes.where("parent_id = -1").select("doc_id", "language"), "doc_id")
    return roles.groupBy("language", "role").agg(F.count_distinct("name").alias("n_names"), F.count("*").alias("n_uses"), F.round(F.avg(F.length("name")), 6).alias("avg_length"))


def _edges_sql(name: str, defines: str, uses: str, sinks: str, parent: bool, words: tuple[str, ...], fold: bool) -> str:
    first = r"regexp_split_to_array(trim(text, chr(9) || chr(10) || chr(13) || ' '), '\s+')[1]"
    ok = f"regexp_full_match({first}, '[a-zA-Z_][a-zA-Z0-9_]*') AND {'lower(' + first + ')' if fold else first} NOT IN ({_listed(words)})"
    sink = f"SELECT s.doc_id, s.node_id AS s_at, s.last_id AS s_last, p.node_id AS a_at, p.last_id AS a_last FROM nodes s JOIN nodes p ON p.doc_id = s.doc_id AND p.node_id = s.{'parent_id' if parent else 'node_id'} WHERE s.type IN ({sinks})"
    return f"""{name}_def AS (SELECT doc_id, {first} AS name, node_id, last_id FROM nodes WHERE type IN ({defines}) AND {ok}),
{name}_use AS (SELECT doc_id, {first} AS name, node_id FROM nodes WHERE type IN ({uses}) AND {ok}),
{name}_sink AS ({sink}),
{name}_below AS (SELECT DISTINCT k.doc_id, u.name AS dst, a_at, a_last FROM {name}_sink k JOIN {name}_use u ON u.doc_id = k.doc_id AND u.node_id BETWEEN s_at AND s_last),
{name} AS (SELECT DISTINCT b.doc_id, d.name AS src, dst FROM {name}_below b JOIN {name}_def d ON d.doc_id = b.doc_id AND (d.node_id > a_last OR a_at BETWEEN d.node_id AND d.last_id) WHERE {'true' if parent else 'd.node_id <> a_at'})"""


_PLAIN_EDGES = _edges_sql("plain", "'parameter', 'variable', 'identifier', 'parameters'", "'identifier', 'variable'", "'return'", False, ct.TYPE_WORDS, True)
_LIVE_EDGES = _edges_sql("live", "'parameter', 'variable'", "'variable'", "'expression', 'return'", True, ct.FLOW_TYPE_WORDS, False)


def _edges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both kinds of edges. Only texts of nodes that may be names are kept."""
    named = F.when(F.col("type").isin("parameter", "variable", "identifier", "parameters"), F.col("text"))
    nodes = kept(read_statements(spark, folder).select("doc_id", "node_id", "last_id", "parent_id", "type", named.alias("text")), "flow-nodes")
    plain = ct.flow_edges(nodes, "doc_id", ("parameter", "variable", "identifier", "parameters"), ("identifier", "variable"), ("return",), False)
    live = ct.flow_edges(nodes, "doc_id", ("parameter", "variable"), ("variable",), ("expression", "return"), True, ct.FLOW_TYPE_WORDS, False)
    return plain, live


@found.add(f"WITH {STATEMENTS_SQL}, {_PLAIN_EDGES}, {_LIVE_EDGES} SELECT doc_id, 'return' AS flow, src, dst FROM plain UNION ALL SELECT doc_id, 'live', src, dst FROM live")
def dfg_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Data-flow edges of each turn's tree: into what is returned, and of live names into expressions and returns."""
    plain, live = _edges(spark, folder)
    return plain.select("doc_id", F.lit("return").alias("flow"), "src", "dst").unionByName(live.select("doc_id", F.lit("live").alias("flow"), "src", "dst"))


@found.add(f"""WITH {STATEMENTS_SQL}, {_PLAIN_EDGES}, {_LIVE_EDGES}, both_edges AS (SELECT doc_id, src, dst, p.src IS NOT NULL AS t, l.src IS NOT NULL AS g FROM plain p FULL JOIN live l USING (doc_id, src, dst)),
counts AS (SELECT doc_id, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT g) AS fn FROM both_edges GROUP BY doc_id)
SELECT doc_id, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM counts""")
def dfg_edge_prf(spark: SparkSession, folder: str) -> DataFrame:
    """How the edges of live names agree with those into returns, in each turn that has any."""
    plain, live = _edges(spark, folder)
    return ct.edge_scores(plain, live, "doc_id")


@found.add(rf"""WITH {STATEMENTS_SQL}, named AS (SELECT doc_id, node_id, type, regexp_split_to_array(trim(text, chr(9) || chr(10) || chr(13) || ' '), '\s+')[1] AS name FROM nodes WHERE type IN ('parameter', 'variable')),
good AS (SELECT * FROM named WHERE regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*') AND lower(name) NOT IN ({_listed(ct.TYPE_WORDS)}))
SELECT u.doc_id, u.name, u.node_id, coalesce(d.node_id, -1) AS def_id FROM (SELECT * FROM good WHERE type = 'variable') u ASOF LEFT JOIN (SELECT * FROM good WHERE type = 'parameter') d ON u.doc_id = d.doc_id AND u.name = d.name AND u.node_id > d.node_id""")
def reaching_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """The last parameter of its name before each variable, -1 where there is none."""
    return ct.reaching_definitions(statement_nodes(spark, folder), "doc_id", ("parameter",), ("variable",)).na.fill(-1, ["def_id"])


def _named_trees(spark: SparkSession, folder: str) -> str:
    """A view of the turns' trees (``doc_id``, ``tree``), and the functions of this library for SQL text; the view's name."""
    registered.register(spark)
    name = f"statement_trees_{uuid.uuid4().hex}"
    kept(statement_trees(turns(spark, folder)).select("doc_id", "text", "tree"), "statement-trees").createOrReplaceTempView(name)
    return name


@found.add(f"WITH {STATEMENTS_SQL} SELECT doc_id, node_id, last_id, parent_id, pos, depth, type, text, n_children FROM nodes WHERE n_children <> 1")
def sql_tree_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with no or several children, by the table function in SQL text."""
    return spark.sql(f"SELECT t.doc_id, n.* FROM {_named_trees(spark, folder)} t, LATERAL tree_flatten(t.tree) n WHERE n.n_children <> 1")


@found.add(rf"""WITH {STATEMENTS_SQL}, led AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY node_id), 0) AS following, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said FROM nodes)
SELECT doc_id, string_agg(CASE WHEN depth > 0 THEN ' ' ELSE '' END || '(' || type || CASE WHEN n_children = 0 AND said <> '' AND said NOT IN ({_listed(nt.PUNCTUATION)}) THEN ' ' || said ELSE '' END || repeat(')', greatest(depth - following + 1, 0)), '' ORDER BY node_id) AS s_expression FROM led GROUP BY doc_id""")
def sql_s_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's tree in brackets, by the scalar function in SQL text."""
    return spark.sql(f"SELECT doc_id, s_expr(tree) AS s_expression FROM {_named_trees(spark, folder)}")


@found.add()
def sql_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Edit similarity, common subsequence and METEOR of each turn and the next one, by scalar functions in SQL text."""
    name = _named_trees(spark, folder)
    return spark.sql(f"""
        SELECT a.doc_id, round(ted_similarity(a.tree, b.tree), 6) AS similarity,
          lcs_len(split(a.text, ' '), split(b.text, ' ')) AS lcs, round(meteor(split(a.text, ' '), split(b.text, ' ')), 6) AS meteor
        FROM {name} a JOIN {name} b ON b.doc_id = a.doc_id + 1""")
