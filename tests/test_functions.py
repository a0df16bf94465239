"""Stems, tail probabilities, splits, fitted models and SQL functions against fixtures and plain loops."""

import collections
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.functions import registered, stats, stemming
from treeloom.operators import evaluation as ev
from treeloom.operators import vectors as vec

# Examples of the paper.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "is": "is",
}


def test_stems_of_the_paper():
    assert {w: stemming.stem(w) for w in STEMS} == STEMS


def test_stems_join_back(spark):
    words = spark.createDataFrame([("cats",), ("cats",), ("cat",), ("ties",), (None,)], "w string")
    assert sorted(map(tuple, stemming.stemmed(words).collect()), key=str) == [("cat", "cat"), ("cats", "cat"), ("cats", "cat"), ("ties", "ti"), (None, None)]


def test_rouge_stemmed_equals_counts(spark):
    rows = [(1, "The cats sing happily, cats!", "A cat singing; happily the cats"), (2, None, "x"), (3, "", ""), (4, "Ponies!", "pony ponies é")]
    got = {r.k: (r.rouge1, r.rouge_l) for r in ev.rouge_stemmed(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b").collect()}

    def words(t):
        return [stemming.stem(w) if len(w) > 3 else w for w in __import__("re").findall("[a-z0-9]+", (t or "").lower())]

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for k, a, b in rows:
        r, h = words(a), words(b)
        share = lambda n: round(2 * n / (len(r) + len(h)), 6) if n else 0.0
        assert got[k] == (share(sum((collections.Counter(r) & collections.Counter(h)).values())), share(longest(r, h)))
    assert got[1][0] > 0.7 and got[4][0] == 0.666667


def beta_tail(r, n):
    """The probability by quadrature of the density of a correlation."""
    nodes, weights = np.polynomial.legendre.leggauss(400)
    low, free = math.asin(abs(r)), n - 2
    high = min(math.pi / 2, low + 60 / math.sqrt(free) if free > 3 else math.pi / 2)
    edges = np.linspace(low, high, 41)
    total = sum((b - a) / 2 * np.sum(weights * np.cos((a + b) / 2 + (b - a) / 2 * nodes) ** (free - 1)) for a, b in zip(edges, edges[1:]))
    return 2 * total / math.exp(math.lgamma(0.5) + math.lgamma(free / 2) - math.lgamma(free / 2 + 0.5))


def test_p_values(spark):
    rows = [(r, n) for n in (3, 4, 5, 12, 102, 5002) for r in (0.001, 0.05, 0.2, 0.5, 0.9, -0.3)]
    for r, n, p in spark.createDataFrame(rows, "r double, n long").select("r", "n", stats.correlation_p_value(F.col("r"), F.col("n"))).collect():
        assert p == pytest.approx(beta_tail(r, n), abs=1e-9)
    edge = spark.createDataFrame([(1.0, 5), (-1.0, 5), (0.0, 5), (0.5, 2), (None, 9)], "r double, n long").select(stats.correlation_p_value(F.col("r"), F.col("n")).alias("p"))
    assert [r.p for r in edge.collect()] == [0.0, 0.0, pytest.approx(1.0), None, None]


def test_stratified_split_has_exact_shares(spark):
    rows = [(i, label) for i, label in enumerate(["a"] * 101 + ["b"] * 7 + [None] * 10 + ["c"])] + [(5000, "same")] * 10
    got = ev.stratified_split(spark.createDataFrame(rows, "k long, label string"), "label", "k", 0.7)
    counts = {r.label: (r.n, r["count"]) for r in got.groupBy("label").agg(F.count_if("calibration").alias("n"), F.count("*").alias("count")).collect()}
    assert counts == {"a": (71, 101), "b": (5, 7), None: (7, 10), "c": (1, 1), "same": (7, 10)}
    order = sorted(range(101), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15])
    assert {r.k for r in got.where("label = 'a' AND calibration").collect()} == set(order[:71])


def test_stratified_split_rounds_halves_up(spark):
    for n, want in ((15, 11), (45, 32), (85, 60)):
        got = ev.stratified_split(spark.range(n).selectExpr("id AS k", "'a' AS label"), "label", "k", 0.7)
        assert got.where("calibration").count() == want


def test_top_terms_take_equals_by_letters(spark):
    freq = {"d": 5, "a": 3, "b": 3, "c": 3, "e": 1}
    counts = spark.createDataFrame([(i, t, 1) for t, n in freq.items() for i in range(n)], "k long, term string, tf long")
    for most in (0, 1, 2, 3, 4, 5, 9):
        want = sorted(freq, key=lambda t: (-freq[t], t))[:most]
        assert sorted(r.term for r in vec.top_terms(counts, most).collect()) == sorted(want)


def test_model_leaves_out_unseen_terms(spark):
    train = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "k long, term string, tf long")
    model = vec.fit_tfidf(train, spark.createDataFrame([(2,)], "n long"))
    got = {r.term: r.weight for r in vec.transform_tfidf(spark.createDataFrame([(9, "a", 3), (9, "z", 4)], train.schema), model, ["k"]).collect()}
    assert got == {"a": pytest.approx(3.0)}
    assert {r.term: r.idf for r in model.collect()}["b"] == pytest.approx(math.log(3 / 2) + 1)


def test_sql_functions(spark):
    registered.register(spark)
    tree = json.dumps({"type": "a", "text": "", "children": [{"type": "b", "text": "x"}, {"type": "c", "text": ",", "children": []}]})
    rng = random.Random(4)
    words = [" ".join(rng.choice("ab c".split() + ["d"]) for _ in range(rng.randint(0, 9))) for _ in range(20)]
    spark.createDataFrame([(tree, '{"type": "a"}'), (None, tree), ("[1]", tree)], "t string, u string").createOrReplaceTempView("registered_trees")
    got = spark.sql("SELECT s_expr(t) AS s, ted_distance(t, u) AS d, round(ted_similarity(t, u), 4) AS l FROM registered_trees").collect()
    assert [tuple(r) for r in got] == [("(a (b x) (c))", 2, 0.5), (None, None, None), (None, None, None)]
    nodes = spark.sql("SELECT n.type, n.parent_id, n.last_id FROM registered_trees r, LATERAL tree_flatten(r.t) n").collect()
    assert sorted(map(tuple, nodes)) == [("a", -1, 2), ("b", 0, 1), ("c", 0, 2)]
    spark.createDataFrame([(a.split(), b.split()) for a, b in zip(words, words[1:])], "a array<string>, b array<string>").createOrReplaceTempView("registered_words")
    for r in spark.sql("SELECT a, b, lcs_len(a, b) AS n, meteor(a, b) AS m FROM registered_words").collect():
        assert r.n == ev.lcs_length(r.a, r.b) and r.m == (ev.meteor(r.a, r.b) if r.a and r.b else 0.0)
