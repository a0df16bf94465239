"""Names, flows and definitions in statement trees against plain walks of each tree."""

import json
import random
import re

import pytest

from treeloom.operators import code_trees as ct
from treeloom.operators import node_tables as nt
from treeloom.plans import statement_queries as sq


def node(kind, *children, text=""):
    return {"type": kind, "text": text, "children": list(children)}


KINDS = ["program", "function", "call", "variable", "identifier", "parameter", "expression", "return", "block", "comment"]
TEXTS = ["a", "b", "foo", "bar_1", "x-y", "if", "public f", "new", "int x", "String", "9z", "", " spaced name", "loop", "int"]


def random_tree(rng, n):
    made = [node("program")]
    for _ in range(n - 1):
        made.append(node(rng.choice(KINDS), text=rng.choice(TEXTS)))
        rng.choice(made[-8:-1])["children"].append(made[-1])
    return made[0]


@pytest.fixture(scope="module")
def read(spark):
    rng = random.Random(11)
    made = [random_tree(rng, rng.choice([1, 3, 10, 40])) for _ in range(120)]
    languages = [rng.choice(["python", "java", "go", "cs", "php"]) for _ in made]
    rows = spark.createDataFrame([(i, lang, json.dumps(t)) for i, (t, lang) in enumerate(zip(made, languages))], "k long, language string, t string")
    nodes = nt.read_nodes(rows, "k", "t", "json").join(rows.select("k", "language"), "k").cache()
    return made, languages, nodes


def names_of(tree, language, reserved):
    """Roles of names, met one after the other."""
    variables, functions = set(), set()
    v_types, f_types = ct.VARIABLE_TYPES[language], ct.FUNCTION_TYPES[language]

    def clean(text):
        if language == "cs" and "<" in text and ">" in text:
            return ""
        return text if language == "php" else re.sub(r"[^A-Za-z0-9_:-]", "", text)

    def sound(name):
        low = name.lower()
        return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", name) and re.search("[A-Za-z]", name) and low not in {*ct.IGNORED, *ct.RESERVED_COMMON, *ct.REMOVED_WORDS} and name not in {*ct.KEY_WORDS, *f_types}

    def add(name, role):
        if not sound(name):
            return
        if role == "variable" and name not in functions and name.lower() not in {*ct.WRAPPERS, *reserved.get(language, ())}:
            variables.add(name)
        if role == "function" and name not in variables:
            functions.add(name)

    def meet(n):
        if n["type"] in v_types:
            if not n["children"]:
                add(clean(n["text"]), "variable")
            for c in n["children"]:
                if c["type"] not in v_types:
                    add(clean(c["text"]), "variable")
        elif n["type"] in (*f_types, "call") and not re.search("public|private|new", n["text"].lower()):
            for c in n["children"]:
                if c["type"].strip().lower() in v_types:
                    add(clean(c["text"]), "function")
        for c in n["children"]:
            meet(c)

    meet(tree)
    return {v: "variable" for v in variables} | {f: "function" for f in functions}


def test_identifiers_equal_a_walk(spark, read):
    made, languages, nodes = read
    names = ct.Names(reserved={"python": ("bar_1",), "go": ("loop", "foo")})
    got = {}
    for r in ct.identifiers(nodes, "k", sq.rule_table(spark, names)).collect():
        got.setdefault(r.k, {})[r.name] = r.role
    want = {i: w for i, (t, lang) in enumerate(zip(made, languages)) if (w := names_of(t, lang, names.reserved))}
    assert got == want
    assert {r for w in want.values() for r in w.values()} == {"variable", "function"}


def clean_flow(text, words, fold):
    parts = text.strip().split() if fold else [text.strip().split(" ")[0]]
    first = parts[0] if parts else ""
    return first if re.fullmatch("[a-zA-Z_][a-zA-Z0-9_]*", first) and (first.lower() if fold else first) not in words else None


def used(tree, types, words, fold):
    found = {clean_flow(tree["text"], words, fold)} if tree["type"] in types else set()
    return found.union(*(used(c, types, words, fold) for c in tree["children"])) - {None}


def return_edges(tree):
    defined, edges = set(), set()

    def meet(n):
        if n["type"] in ("parameter", "variable", "identifier", "parameters"):
            defined.add(clean_flow(n["text"], ct.TYPE_WORDS, True))
        elif n["type"] == "return":
            edges.update((d, u) for d in defined - {None} for u in used(n, ("identifier", "variable"), ct.TYPE_WORDS, True))
        for c in reversed(n["children"]):
            meet(c)

    meet(tree)
    return edges


def live_edges(tree):
    defined, edges = set(), set()

    def meet(n, live):
        if n["type"] in ("parameter", "variable"):
            defined.add(clean_flow(n["text"], ct.FLOW_TYPE_WORDS, False))
        if n["type"] in ("expression", "return"):
            edges.update((d, u) for d in live - {None} for u in used(n, ("variable",), ct.FLOW_TYPE_WORDS, False))
        now = live | defined
        for c in reversed(n["children"]):
            meet(c, now)

    meet(tree, set())
    return edges


def test_flow_edges_equal_a_walk(read):
    made, _, nodes = read
    plain, live = sq._edges(nodes.withColumnRenamed("k", "doc_id"))
    for found, walk in ((plain, return_edges), (live, live_edges)):
        got = {}
        for r in found.collect():
            got.setdefault(r.doc_id, set()).add((r.src, r.dst))
        want = {i: w for i, t in enumerate(made) if (w := walk(t))}
        assert got == want and len(want) > 10


def test_edge_scores(spark):
    a = spark.createDataFrame([(1, "x", "y"), (1, "x", "z"), (2, "p", "q")], "k long, src string, dst string")
    b = spark.createDataFrame([(1, "x", "y"), (3, "m", "n")], "k long, src string, dst string")
    got = {r.k: tuple(r)[1:] for r in ct.edge_scores(a, b, "k").collect()}
    assert got == {1: (1, 0, 1, 1.0, 0.5, 0.666667), 2: (0, 0, 1, 0.0, 0.0, 0.0), 3: (0, 1, 0, 0.0, 0.0, 0.0)}


def test_reaching_definitions(spark):
    tree = node("program", node("parameter", node("variable", text="a"), text="a"), node("call", node("variable", text="a"), node("variable", text="b")), node("parameter", text="a"), node("variable", text="a"))
    nodes = nt.read_nodes(spark.createDataFrame([(1, json.dumps(tree))], "k long, t string"), "k", "t", "json")
    got = {r.node_id: r.def_id for r in ct.reaching_definitions(nodes, "k", ("parameter",), ("variable",)).collect()}
    assert got == {2: 1, 4: 1, 5: None, 7: 6}


def test_statement_trees_of_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n,;"), (4, "One two.\nthree")], "doc_id long, text string")
    nodes = nt.read_nodes(sq.statement_trees(rows), "doc_id", "tree", "json")
    assert {r.doc_id: r["count"] for r in nodes.groupBy("doc_id").count().collect()} == {1: 1, 2: 1, 3: 4, 4: 10}


def test_flow_queries_keep_texts_of_names_alone(spark, monkeypatch):
    from treeloom.plans import statement_queries as sq

    seen = []
    monkeypatch.setattr(sq, "kept", lambda df, name: seen.append(df) or df)
    sq.dfg_edge_prf(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and not seen[0].where("text IS NOT NULL AND type NOT IN ('parameter', 'variable', 'identifier', 'parameters')").count()
    assert "depth" not in seen[0].columns
