"""Trees as node tables against plain recursion, hand-made values and brute force."""

import json
import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom import catalog
from treeloom.functions import text as tx
from treeloom.operators import edit_distance as ed
from treeloom.operators import evaluation, trees
from treeloom.operators import node_tables as nt


def node(kind, *children, text=""):
    return {"type": kind, "text": text, "children": list(children)}


def walk(tree, depth=0):
    yield depth, tree
    for child in tree["children"]:
        yield from walk(child, depth + 1)


def listed(tree):
    return [d for d, _ in walk(tree)], [n["type"] for _, n in walk(tree)]


T1, T2, T3 = node("a", node("b", node("d")), node("c")), node("a", node("b"), node("c")), node("a", node("c"), node("b", node("e")))


@pytest.mark.parametrize(("a", "b", "distance"), [(T1, T1, 0), (T1, T2, 1), (T1, T3, 3), (T2, T3, 3)])
def test_edit_distance_fixtures(a, b, distance):
    assert ed.distance(listed(a), listed(b)) == distance


def as_tuple(n):
    return n["type"], tuple(map(as_tuple, n["children"]))


@lru_cache(None)
def forest_distance(a, b):
    if not a or not b:
        return sum(1 + forest_distance(x[1], ()) for x in a) + sum(1 + forest_distance((), x[1]) for x in b)
    (ka, ca), (kb, cb) = a[-1], b[-1]
    return min(forest_distance(a[:-1] + ca, b) + 1, forest_distance(a, b[:-1] + cb) + 1, forest_distance(a[:-1], b[:-1]) + forest_distance(ca, cb) + (ka != kb))


def random_tree(rng, n, kinds="abc", texts=("",)):
    made = [node(rng.choice(kinds), text=rng.choice(texts))]
    for _ in range(n - 1):
        made.append(node(rng.choice(kinds), text=rng.choice(texts)))
        rng.choice(made[:-1])["children"].append(made[-1])
    return made[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.integers(1, 8))
def test_edit_distance_brute_force(seed, n, m):
    a, b = random_tree(random.Random(seed), n), random_tree(random.Random(seed + 1), m)
    assert ed.distance(listed(a), listed(b)) == forest_distance((as_tuple(a),), (as_tuple(b),)) == ed.distance(listed(b), listed(a))


def test_edit_similarity_of_missing_trees(spark):
    kind = "array<struct<place: int, depth: int, type: string, text: string>>"
    as_rows = lambda t: [(i, d, k, "") for i, (d, k) in enumerate(zip(*listed(t), strict=True))]
    rows = [(1, None, None), (2, as_rows(T1), None), (3, as_rows(T1), as_rows(T2)), (4, as_rows(T1), as_rows(T3)), (5, [], None)]
    got = {r.k: (r.distance, r.similarity) for r in ed.edit_similarity(spark.createDataFrame(rows, f"k int, a {kind}, b {kind}"), "k", "a", "b").collect()}
    assert got == {1: (None, 1.0), 2: (None, 0.0), 3: (1, pytest.approx(1 - 1 / 7)), 4: (3, 0.625), 5: (None, 1.0)}


RULES = nt.Rules(aliases={"num": "number", "stmt": "statement"}, remove=("comment", "public"), skip=("paren", "group"))


def plain_unify(tree, rules, compress=True):
    """The rules of unification on one tree, from the leaves up: a list of no or one tree."""
    kind = rules.aliases.get(tree["type"].lower(), tree["type"].lower())
    text = tree["text"].translate({36: None, 64: None}).strip(";").strip()
    below = [x for c in tree["children"] for x in plain_unify(c, rules, compress)]
    bare = lambda t: "".join(x for x in t if x not in " ()").rstrip(";")
    if compress:
        if kind in rules.remove or text.lower() in rules.remove:
            return []
        if len(below) == 1 and (bare(text) == bare(below[0]["text"]) and kind not in nt.ROOTS or tree["type"] in rules.skip):
            return below
        if not below and (tree["type"] in nt.PUNCTUATION and text in ("", tree["type"]) or not text and not kind):
            return []
        if below and tree["type"] in rules.skip:
            kind = "expression"
    return [node(kind, *below, text=text)]


def plain_print(tree):
    inner = [plain_print(c) for c in tree["children"]] or ([tree["text"]] if tree["text"] and tree["text"] not in nt.PUNCTUATION else [])
    return "(" + " ".join([tree["type"], *inner]) + ")"


def many_trees(n):
    rng = random.Random(5)
    kinds, texts = ["num", "stmt", "paren", "group", "comment", "(", ";", "", "program", "x"], ["", "", "1", "(1)", "1;", "$1", "public", "a b", ";"]
    made = [random_tree(rng, rng.choice([1, 2, 5, 12, 40]), kinds, texts) for _ in range(n)]
    deep = node("x", text="end")
    for i in range(200):
        deep = node(rng.choice(["x", "paren"]), deep, text=f"t{i}")
    return [*made, deep]


@pytest.fixture(scope="module")
def read(spark):
    made = many_trees(150)
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(made)], "k long, t string")
    return made, nt.read_nodes(rows, "k", "t", "json").cache()


@pytest.mark.parametrize("compress", [True, False])
def test_unify_and_print_equal_plain_recursion(read, compress):
    made, nodes = read
    small = nt.unify(nodes, "k", RULES, compress=compress)
    got = {r.k: r.s_expression for r in nt.s_expressions(small, "k").collect()}
    want = {i: plain_print(x[0]) for i, t in enumerate(made) if (x := plain_unify(t, RULES, compress))}
    assert got == want
    lines = {r.k: r.indented for r in nt.indented(small, "k").collect()}
    assert lines == {i: "\n".join("  " * d + n["type"] for d, n in walk(plain_unify(made[i], RULES, compress)[0])) for i in want}


def test_unify_without_flags_is_the_tree(read):
    made, nodes = read
    got = nt.unify(nodes, "k", RULES, False, False, False).orderBy("k", "node_id").collect()
    assert [(r.k, r.depth, r.type, r.leaf) for r in got] == [(i, d, n["type"], not n["children"]) for i, t in enumerate(made) for d, n in walk(t)]


def test_limits_leave_out_nothing_unless_asked(spark):
    deep = node("x", text="0")
    for i in range(60):
        deep = node("x", deep, text=str(i + 1))
    rows = [(1, json.dumps(deep)), (2, json.dumps(node("x", *[node("y", text=str(i)) for i in range(501)])))]
    nodes = nt.read_nodes(spark.createDataFrame(rows, "k long, t string"), "k", "t", "json")
    count = lambda **limits: {r.k: r["count"] for r in nt.unify(nodes, "k", nt.Rules(), **limits).groupBy("k").count().collect()}
    assert count() == {1: 61, 2: 502}
    assert count(max_depth=50) == {1: 51, 2: 502} and count(max_children=500) == {1: 61} and count(first_children=300) == {1: 61, 2: 301}


def test_deepest_root(spark):
    rows = [(1, json.dumps(node("program", node("source_file", node("f", node("g"), node("h")))))), (2, json.dumps(node("program", node("f"), node("g")))), (3, json.dumps(node("program")))]
    nodes = nt.read_nodes(spark.createDataFrame(rows, "k long, t string"), "k", "t", "json")
    got = nt.deepest_root(nt.unify(nodes, "k", nt.Rules(), compress=False), "k")
    assert {(r.k, r.wrapped, r.s_expression) for r in nt.s_expressions(got, "k").join(got.select("k", "wrapped").distinct(), "k").collect()} == {(1, 2, "(f (g) (h))"), (2, 0, "(program (f) (g))"), (3, 0, "(program)")}


def test_paths_and_features_equal_those_of_flat_trees(spark, read):
    made, nodes = read
    want = {}
    for i, t in enumerate(made):
        stack = []
        for d, n in walk(t):
            stack = [*stack[:d], n["type"]]
            if not n["children"]:
                want[i, ">".join(stack)] = want.get((i, ">".join(stack)), 0) + 1
    assert {(r.k, r.path): r.n for r in nt.label_paths(nodes, "k").collect()} == want
    docs = spark.createDataFrame([(1, "one two, 3\nfour\n\n5 six!"), (2, "a")], "doc_id long, text string")
    flat = trees.nodes(trees.leaves(docs))
    any_depth = flat.select("doc_id", F.col("path").alias("node_id"), "depth", "type", "text", "n_children")
    pick = lambda d: sorted(map(tuple, d.select("doc_id", "feature", "n").collect()))
    assert pick(nt.structural_features(any_depth, "doc_id")) == pick(trees.structural_features(trees.leaves(docs)))


def test_trees_of_equal_keys_stay_apart(spark):
    page = json.dumps(node("a", node("b", node("c")), node("d")))
    nodes = nt.read_nodes(spark.createDataFrame([(1, page), (1, page)], "k long, t string"), "k", "t", "json")
    got = nt.indented(nt.unify(nodes, "tree", nt.Rules(), compress=False), "tree").collect()
    assert [(r.tree.key, r.indented) for r in got] == [(1, "a\n  b\n    c\n  d")] * 2


def test_deep_pages_take_linear_time(spark):
    deep = "<div>" * 30000 + "x"
    nodes = nt.read_nodes(spark.createDataFrame([(1, deep)], "k long, t string"), "k", "t", "html")
    assert nodes.where("last_id = 30001").count() == 30002
    assert nt.placed(nodes, "k").where("size(types) = 7").count() == 29996


def test_read_nodes_of_pages(spark):
    rows = [(1, "<p>a<p>b<br></div><ul><li>c</ul><![if x]>d"), (2, ""), (3, None)]
    got = nt.read_nodes(spark.createDataFrame(rows, "k long, t string"), "k", "t", "html").orderBy("k", "node_id").collect()
    want = [("document", 0, -1, 9, 2), ("p", 1, 0, 2, 1), ("#text", 2, 1, 2, 0), ("p", 1, 0, 9, 4), ("#text", 2, 3, 4, 0), ("br", 2, 3, 5, 0), ("ul", 2, 3, 8, 1), ("li", 3, 6, 8, 1), ("#text", 4, 7, 8, 0), ("#text", 2, 3, 9, 0)]
    assert [(r.type, r.depth, r.parent_id, r.last_id, r.n_children) for r in got if r.k == 1] == want
    assert [r.type for r in got if r.k != 1] == ["document", "document"]
    assert nt.read_nodes(spark.createDataFrame([(1, "[1]"), (2, "{"), (3, None)], "k long, t string"), "k", "t", "json").count() == 0


def test_completeness(spark):
    trees_of = lambda t: nt.read_nodes(spark.createDataFrame([(1, json.dumps(t))], "k long, t string"), "k", "t", "json")
    groups, aliases = {"A": ("x", "y"), "B": ("z", "x"), "C": ("w",)}, {"yy": "y"}
    had = nt.categories(trees_of(node("yy", node("Z "), node("other"), node("t", text="12"))), "k", groups, aliases, {"C": F.col("text").rlike("^[0-9]+$")})
    left = nt.categories(trees_of(node("z")), "k", groups, aliases)
    assert [(r.found, r.strange) for r in had.collect()] == [(["A", "B", "C"], 1)]
    got = nt.completeness(had, left, "k", {"all": "ABC", "core": "AC", "none": "D"}).head()
    assert (got.pec_all, got.pec_core, got.pec_none, got.lost_all, got.loss_core) == (0.3333, 0.0, 1.0, "A,C", 1.0)


@pytest.mark.parametrize("width", [4, 1024])
def test_next_in_order_over_many_ranges(spark, width):
    values = sorted(random.Random(3).sample(range(-5000, 5000), 700))
    got = {r.v: r.next for r in evaluation.next_in_order(spark.createDataFrame([(v,) for v in values], "v long"), "v", width).collect()}
    assert got == dict(zip(values, values[1:] + values[:1], strict=True))


def test_unit_float_fixtures(spark):
    parts = [("s", "()", "node", 0.16653177935810706), ("s", "(0,)", "node", 0.45486683973216235), ("s", "(0,)", "drop", 0.5842339768062328), ("s", "(0, 1)", "drop", 0.9305204691701894)]
    rows = spark.createDataFrame(parts, "a string, b string, c string, want double")
    for got, want in rows.select(tx.unit_float(F.col("a"), F.col("b"), F.col("c")), "want").collect():
        assert got == pytest.approx(want, abs=1e-15)


def test_no_severity_changes_nothing_and_all_severity_keeps_one_leaf(spark):
    docs = spark.createDataFrame([(1, "one two, 3\nfour\n"), (2, ""), (3, None)], "doc_id long, text string")
    rows = trees.leaves(docs)
    same = trees.degraded(rows, F.lit(0.0), F.lit("s")).select("doc_id", "line", "pos", "type", "text")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.select("doc_id", "line", "pos", "type", "text").collect()))
    assert trees.degraded(rows, F.lit(1.0), F.lit("s")).count() == 1


def test_flatten_json(spark):
    rows = spark.createDataFrame([(1, '{"type":"a","children":[{"type":"b","text":"x"},{"type":"c"}]}'), (2, "no json"), (3, None), (4, "[1]")], "k long, t string")
    got = [(r.node_id, r.parent_id, r.path, r.type, r.n_children) for r in trees.flatten_json(rows, "k", "t").orderBy("node_id").collect()]
    assert got == [(0, -1, "", "a", 2), (1, 0, "0000", "b", 0), (2, 0, "0001", "c", 0)]


def test_stage_ablation_has_similarity_and_completeness(spark):
    from treeloom.plans import algebra_queries

    got = {r.variant: r for r in algebra_queries.stage_ablation(spark, "/root/testdata/sf0.001").collect()}
    assert got["none"].similarity == got["none"].pec_all == got["types"].pec_all == 1
    assert all(0 < r.similarity <= 1 and 0 < r.pec_core <= 1 for r in got.values()) and got["all"].similarity < 1


def test_drawn_leaves_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b, c\n\nd 1 e!\n"), (2, ""), (3, None), (4, "\n" + "x " * 40), (None, "a")], "doc_id long, text string")
    seed = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    once = trees.drawn_leaves(docs, seed)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    by_rows = trees.drawn(trees.leaves(docs), seed).select(once.columns)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, by_rows.collect())) and once.count() == 48
    for s in (0.0, 0.3, 0.9, 1.0):
        got = sorted(map(repr, trees.corrupted(once, F.lit(s)).collect()))
        assert got == sorted(map(repr, trees.degraded(trees.leaves(docs), F.lit(s), seed).collect()))


@pytest.mark.parametrize("name", ["degrade_tree", "sensitivity", "identifier_prf"])
def test_corruption_joins_nothing(spark, name):
    """What severities share is drawn once; a join of lines or leaves at each severity was too much for the driver."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_corrupted_trees_are_not_shuffled(spark):
    tree = json.dumps(node("a", node("b", node("c", text="x"), node("d", text="y")), node("e", text="z"), text="all"))
    read = nt.read_nodes(spark.createDataFrame([(1, tree), (2, tree)], "k long, t string"), "k", "t", "json").drop("tree")
    got = nt.degraded(read, "k", (0.0, 0.5, 1.0), F.col("k").cast("string"), ordered=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert sorted((r.k, r.node_id, r.type, r.text, r.leaf) for r in rows if r.severity == 0.0) == sorted((r.k, r.node_id, r.type, r.text, r.n_children == 0) for r in read.collect())
    for k in (1, 2):
        left = [r for r in rows if r.severity == 1.0 and r.k == k]
        # All children are dropped but one of each node that is left, down to a leaf.
        assert sorted(r.depth for r in left) == list(range(len(left))) and left[-1].leaf and all(r.text == "" for r in left)


def test_ablation_compares_a_shape_once(spark, monkeypatch, tmp_path):
    from treeloom.plans import algebra_queries as aq

    rows = [(i, f"u{i}", f"<html><body><h1>t{i}</h1><p>said {i}</p></body></html>") for i in range(9)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    compared = []
    monkeypatch.setattr(aq.ed, "edit_similarity", lambda pairs, *a, f=ed.edit_similarity: compared.append(pairs.count()) or f(pairs, *a))
    got = aq.stage_ablation(spark, str(tmp_path)).collect()
    assert {r.variant: r.sample_count for r in got} == dict.fromkeys(aq.STAGES, 9) and compared[0] <= len(aq.STAGES)
