"""Text functions, evaluation scores, readers, writers and the queue."""

import collections
import csv
import hashlib
import io
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from treeloom.functions import text as tx
from treeloom.operators import evaluation as ev
from treeloom.operators import reports
from treeloom.operators import vectors as vec
from treeloom.operators.materialized import Materialized
from treeloom.operators.run_record import RunRecord
from treeloom.sources import files, sinks
from treeloom.streaming import queue


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).head()[0]


def test_text_functions(spark):
    assert one(spark, tx.normalize_text(F.col("t")), t=" a\r\nb\t\tc  d \n") == "a\nb c d"
    assert one(spark, tx.normalize_text(F.col("t")), t=None) == ""
    assert one(spark, tx.normalize_token(F.col("t")), t="--Ab c!") == "ab_c"
    assert one(spark, tx.normalize_token(F.col("t")), t="!!") == "empty"
    assert one(spark, tx.first_filled(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, tx.ngrams(tx.tokens(F.col("t")), 2), t="int x = a + b; return x") == ["int_x", "x_a", "a_b", "b_return", "return_x"]
    assert one(spark, tx.ngrams(tx.tokens(F.col("t")), 3), t="a b") == []


def test_lcs_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        best = max((n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if is_subsequence(c, b)), default=0)
        assert ev.lcs_length(a, b) == best


def is_subsequence(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_meteor():
    assert ev.meteor("the cat sat".split(), "the cat sat".split()) == pytest.approx(1 - 0.5 / 27)
    assert ev.meteor(["a"], ["b"]) == 0.0


def test_bags():
    from collections import Counter

    assert ev.multiset_cosine(Counter(), Counter()) == 1.0
    assert ev.multiset_cosine(Counter("a"), Counter()) == 0.0
    a, b = Counter("int_x x_a a_b b_return return_x".split()), Counter("var_x x_a a_b b_return return_y".split())
    assert ev.multiset_cosine(a, b) == pytest.approx(0.6)


def test_rouge1(spark):
    rows = spark.createDataFrame([(1, "the cat sat", "the cat"), (2, "", "x"), (3, None, None)], "k long, r string, h string")
    got = {r.k: (r.rouge1, r.exact) for r in ev.rouge1(rows, "k", "r", "h").collect()}
    assert got == {1: (0.8, 0), 2: (0.0, 0), 3: (0.0, 1)}


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.8), (1, 1, 0.8), (1, 0, 0.1)], "g int, label int, score double")
    assert ev.ranking_metrics(rows, ["g"]).head()["roc_auc"] == 0.875


def test_upper_median_and_ranks(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 7.0), ("b", 7.0), ("b", 9.0)], "g string, v double")
    got = {r.g: r.m for r in reports.order_statistics(rows, ["g"], "v", {"m": F.floor(F.col("__all") / 2)}).collect()}
    assert got == {"a": 3.0, "b": 7.0}
    ranks = sorted((r.g, r.v, r.r) for r in reports.average_ranks(rows, ["g"], "v", "r").collect())
    assert ranks[-3:] == [("b", 7.0, 1.5), ("b", 7.0, 1.5), ("b", 9.0, 3.0)]


def test_ranges_are_cut_once(spark):
    """Approximate percentiles differ by the order in which parts arrive: a second evaluation would put rows into other ranges."""
    rows = spark.createDataFrame([(None if v % 3 else "a", float(v)) for v in range(30)], "g string, v double")
    sums = reports.cumulative(rows, ["g"], "v", {"n": F.lit(1)})
    assert "percentile_approx" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert {r.g: r.m for r in reports.order_statistics(rows, ["g"], "v", {"m": F.floor(F.col("__all") / 2)}).collect()} == {"a": 15.0, None: 16.0}


def test_correlations_of_a_null_group(spark):
    rows = spark.createDataFrame([(g, float(i), float(i * i)) for g in (None, "a") for i in range(9)], "g string, x double, y double")
    assert {r.g: (r.n, r.spearman_r) for r in reports.correlation_tests(rows, ["g"], "x", "y").collect()} == {None: (9, 1.0), "a": (9, 1.0)}


def test_correlation_guards(spark):
    rows = spark.createDataFrame([("two", 1.0, 2.0), ("two", 2.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "g string, x double, y double")
    assert all(r.pearson_r is None and r.spearman_r is None for r in reports.correlations(rows, ["g"], "x", "y").collect())


def test_next_in_order_is_cyclic(spark):
    rows = spark.createDataFrame([(i,) for i in (3, 1500, 4, 9000)], "id long")
    assert {r.id: r.next for r in ev.next_in_order(rows, "id").collect()} == {3: 4, 4: 1500, 1500: 9000, 9000: 3}


def test_dense_top_k_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id long, v array<double>")
    got = [(r.query_id, r.id, r["rank"]) for r in vec.dense_top_k(rows, F.col("id") == 0, 5, "id", "v").orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    new = spark.createDataFrame([("b", 5), ("c", 7), ("c", 6)], "k string, n int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(sinks.insert_absent(old, new, ["k"], ["n"])) == [("a", 1), ("b", 2), ("c", 6)]
    assert rows(sinks.upsert(old, new.where("n < 7"), ["k"])) == [("a", 1), ("b", 5), ("c", 6)]
    sinks.write_partitions(old, f"{tmp_path}/p", "k")
    sinks.write_partitions(new.where("k = 'b'"), f"{tmp_path}/p", "k")
    assert rows(spark.read.parquet(f"{tmp_path}/p").select("k", "n")) == [("a", 1), ("b", 5)]


def test_csv_has_one_header_and_holds_any_text(spark, tmp_path):
    path, kind = f"{tmp_path}/c", "k string, n int, t string"
    said = [("a", 1, ' "x",\n y\r\nz '), ("", None, None), (None, 2, ""), ("k", 3, "n"), ("ü", 4, "\\")]
    for part in (said[:2], said[2:4], said[4:]):
        sinks.append_csv(spark.createDataFrame(part, kind), path)
    assert sorted(map(tuple, sinks.read_csv(spark, path, kind).collect()), key=repr) == sorted(said, key=repr)
    whole = "".join(p.read_text(newline="") for p in sorted((tmp_path / "c").rglob("*.csv")))
    assert whole.startswith("k,n,t\n") and whole.count("k,n,t") == 1
    assert list(csv.reader(io.StringIO(whole, newline="")))[1:][0] in ([("a"), "1", ' "x",\n y\r\nz '], ["", "", ""])


def test_tree_files(spark, tmp_path):
    rows = [("1", '{"type": "a",\n "children": []}', "x"), ('q"uote', '{"type": "b"}', "y"), ("3", None, None)]
    sinks.write_trees(spark.createDataFrame(rows, "key string, tree string, lang string"), f"{tmp_path}/t", "key", "tree", ["lang"])
    got = {r.key: (r.tree and json.loads(r.tree), r.lang) for r in files.read_trees(spark, f"{tmp_path}/t").collect()}
    assert got == {"1": ({"type": "a", "children": []}, "x"), 'q"uote': ({"type": "b"}, "y"), "3": (None, None)}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text('{"type": "a",\n "text": "x"}\n')
    (tmp_path / "one" / "b.json").write_text("no tree")
    got = {r.file.rsplit("/", 1)[1]: r.tree and json.loads(r.tree) for r in files.read_trees(spark, f"{tmp_path}/one", whole=True).collect()}
    assert got == {"a.json": {"type": "a", "text": "x"}, "b.json": None}


def test_export_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b\n c"), (1, None)], "id long, t string")
    path = f"{tmp_path}/x"
    sinks.export_lines(rows.where("id = 1"), path, ["t"], "id")
    sinks.export_lines(rows, path, ["t"], "id")
    assert sorted(r.value for r in spark.read.text(f"{path}/column=t").collect()) == ["", "b c"]


def test_export_keeps_lines_together_where_keys_tie(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"a{i}", f"b{i}") for i in range(300)], "id long, a string, b string").repartition(7)
    sinks.export_lines(rows, f"{tmp_path}/x", ["a", "b"], "id")
    got = files.read_parallel(spark, {c: f"{tmp_path}/x/column={c}" for c in ("id", "a", "b")}, "s", r"part-(\d+)").collect()
    assert sorted((int(r.id), r.a, r.b) for r in got) == sorted((i % 3, f"a{i}", f"b{i}") for i in range(300))


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"repo": "", "repo_name": "r", "tokens": ["a", "b"]}), "", "{bad", json.dumps({"repo": "q\0"})]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    good, bad = files.read_jsonl(spark, str(tmp_path / "f.jsonl"), {"repo": ["repo", "repo_name"], "words": ["tokens"]}, ["tokens"])
    assert sorted((r.repo, r.words) for r in good.collect()) == [("q\0", ""), ("r", "a b")]
    assert [r.value for r in bad.collect()] == ["{bad"]


def test_parallel_lines(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x\0 \n\nz\n")
    (tmp_path / "b").write_bytes(b"1\n2\n\xff3\n")
    got = sorted((r.func_name, r.a, r.b) for r in files.read_parallel(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, "train").collect())
    assert [g[:2] for g in got] == [("train_func_1", "x"), ("train_func_3", "z")]


def test_lines_have_their_files_numbers(spark, tmp_path):
    for side in "ab":
        (tmp_path / side).mkdir()
        for name, n in (("x", 5000), ("y", 70)):
            (tmp_path / side / f"{name}.txt").write_text("".join(f"{side}{name}{i}\n" if i % 11 else " \n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.read_parallel(spark, {s: str(tmp_path / s) for s in "ab"}, "t").collect()
        assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(f"t_func_{i}", k, i, f"a{name}{i}", f"b{name}{i}") for k, name, n in (("1", "x", 5000), ("2", "y", 70)) for i in range(1, n + 1) if i % 11]
    assert sorted(map(tuple, got)) == sorted(want)


def test_refresh_reads_its_batch_and_equals_a_full_run(spark, tmp_path):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), ("a", 8.0), ("c", 2.0), (None, 5.0)]
    table = lambda part: spark.createDataFrame(part, "g string, v double")
    parts, whole = (Materialized(spark, f"{tmp_path}/{n}", ["g"], ["v"]) for n in ("parts", "whole"))
    with pytest.raises(ValueError, match="never"):
        parts.result()
    assert parts.refresh(table(rows[:3]), "one") == 1
    assert [parts.refresh(table(rows[3:]), "two") for _ in range(2)] == [2, 2]
    whole.refresh(table(rows), "all")
    pick = lambda m: sorted(map(tuple, m.result().collect()), key=str)
    assert pick(parts) == pick(whole)
    assert ("a", 3, 4.0, 3.6056, 1.0, 8.0) in pick(parts) and ("b", 1, None, None, None, None) in pick(parts)
    assert parts.current()[0] == 2 and parts.has("one") and not parts.has("three")


def test_catalogue_tables(spark, tmp_path):
    name = "store_test"
    assert sinks.create_if_missing(spark, name, "v long, d string", "d", f"file://{tmp_path}/t") and not sinks.create_if_missing(spark, name, "v long, d string")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "v long, d string")
    pick = lambda: sorted(tuple(r) for r in spark.table(name).collect())
    sinks.append(rows, name)
    sinks.replace_partitions(spark.createDataFrame([("x", 9)], "d string, v long"), name)
    assert pick() == [(2, "y"), (9, "x")]
    sinks.truncate(spark, name)
    assert pick() == []
    sinks.replace_all(rows, name)
    sinks.replace_all(rows.where("v = 1"), name)
    assert pick() == [(1, "x")]
    spark.sql(f"DROP TABLE {name}")


def test_run_record(spark, tmp_path):
    record = RunRecord(spark)
    record.step("a", spark.range(5), lambda d: d.write.parquet(f"{tmp_path}/a"), total=F.sum("id"))
    row = record.row("s", "d", {"k": 1}, [__file__, "/none"]).head()
    step, env = json.loads(row.steps)["a"], json.loads(row.environment)
    assert (step["n_rows"], step["total"]) == (5, 10) and step["seconds"] > 0
    assert len(env["scripts"]["test_text_and_files.py"]) == 64 and env["scripts"]["none"] is None and env["packages"]["pyspark"]
    record.steps["b"] = {"seconds": 2 * step["seconds"]}
    assert record.overhead("b", "a") == 100.0


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one").write_bytes(b"abc")
    (tmp_path / "d" / ".two").write_bytes(b"x")
    rows = files.manifest(spark, str(tmp_path / "d")).collect()
    assert [(r.path, r.size, r.sha256) for r in rows] == [("one", 3, hashlib.sha256(b"abc").hexdigest())]
    (tmp_path / "d" / "in").mkdir()
    (tmp_path / "d" / "in" / "a").write_bytes(b"xy")
    (tmp_path / "d" / "empty").write_bytes(b"")
    lines = "".join(f"{p}\t{len(b)}\t{hashlib.sha256(b).hexdigest()}\n" for p, b in (("in/a", b"xy"), ("one", b"abc")))
    assert tuple(files.manifest_totals(files.manifest(spark, str(tmp_path / "d"))).head()) == (2, 5, hashlib.sha256(lines.encode()).hexdigest())


def test_audit_rows(spark):
    rows = spark.createDataFrame([(1, "x", 2), (2, None, None)], "k int, t string, n int")
    got = reports.audit_rows(rows, {"row_id": F.col("k")}, {"code": F.col("t")}, {"a": {"n": F.col("n")}}, [{"n": F.col("n")}], {"n": "nodes"}).orderBy("row_id").collect()
    assert [r.code_sha256 for r in got] == [hashlib.sha256(t).hexdigest() for t in (b"x", b"")]
    assert json.loads(got[0].summary) == {"a": {"n": 2}} and json.loads(got[1].summary) == {"a": {}}
    assert json.loads(got[0].raw_runs) == {"measurement_count": 1, "runs": [{"n": 2}], "columns": {"n": "nodes"}}


def test_windows_hold_rows_that_come_late(spark, tmp_path):
    schema = "ts timestamp, kind string, value double"
    for i, day in enumerate((20, 21, 22, 1, 2, 20)):
        spark.createDataFrame([(f"2024-01-{day:02d} 10:00:00", "a", 1.0)], "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    stream = queue.read_queue(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, files_a_batch=1)
    queue.collect_windows(queue.windowed_counts(stream, "ts", "kind"), f"{tmp_path}/out", f"{tmp_path}/state")
    latest = spark.read.parquet(f"{tmp_path}/out").groupBy("start").agg(F.max_by("n", "batch").alias("n")).collect()
    assert {r.start.day: r.n for r in latest} == {20: 2, 21: 1, 22: 1, 1: 1, 2: 1}


def test_sparse_search_equals_brute_force(spark):
    import math

    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("a b c dd ee f g h i".split()) for _ in range(rng.randint(0, 12))) for i in range(60)}
    texts[7], texts[8] = "", texts[9]
    rows = spark.createDataFrame([(i, t or None, i % 10 == 0, True) for i, t in texts.items()], "id long, text string, query boolean, target boolean").repartition(5)
    grams = {i: collections.Counter(w := t.split()) + collections.Counter(zip(w, w[1:])) for i, t in texts.items()}
    df = collections.Counter(g for c in grams.values() for g in c)
    weight = {i: {g: n * (math.log(61 / (1 + df[g])) + 1) for g, n in c.items()} for i, c in grams.items()}
    norm = {i: math.sqrt(sum(x * x for x in w.values())) for i, w in weight.items()}
    score = lambda a, b: round(sum(x * weight[b].get(g, 0) for g, x in weight[a].items()) / (norm[a] * norm[b]), 6) if norm[a] and norm[b] else 0
    blocks = vec.sparse_blocks(rows, (1, 2), block=7)
    got = {}
    for r in vec.sparse_top_k(blocks, 4, skip_own=True).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.target_id, r.score))
    for q in range(0, 60, 10):
        want = sorted((-score(q, t), t) for t in texts if t != q and score(q, t) > 0)[:4]
        assert [t for t, _ in got.get(q, [])] == [t for _, t in want] and all(abs(s + x[0]) < 2e-6 for (_, s), x in zip(got.get(q, []), want))
    pos = spark.createDataFrame([(q, q + 7) for q in range(0, 60, 10) if q + 7 in texts], "query_id long, target_id long")
    for r in vec.sparse_ranks(blocks, pos, 60).collect():
        p = score(r.query_id, r.query_id + 7)
        others = [(t, score(r.query_id, t)) for t in texts if t != r.query_id]
        above, ties = sum(s > p for _, s in others), sum(s == p and t < r.query_id + 7 for t, s in others)
        assert (r["rank"], r.best_rank) == ((60, 60) if p == 0 else (1 + above + ties, 1 + above))


def test_running_counts_stand_far_values(spark):
    values = [0.001 * i for i in range(2000)] + [1e12, -1e12] + [5.0] * 50
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.n_upto for r in reports.cumulative(rows, [], "v", {"n": F.lit(1)}).collect()}
    ordered = sorted(values)
    assert got == {v: ordered.index(v) for v in set(values)}


def test_queue_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    rows.write.parquet(f"{tmp_path}/in")
    run = lambda: queue.drain(queue.read_queue(spark, f"{tmp_path}/in", rows.schema), lambda d: d, f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    rows.withColumn("id", F.col("id") + 2).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]


def test_sparse_blocks_meet_without_a_join(spark):
    """A row of two blocks for each pair of them was too much for an executor, and copies of queries grew with the targets."""
    rows = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} c{i % 5}", i % 10 == 0, True) for i in range(90)], "id long, text string, query boolean, target boolean")
    found = vec.sparse_top_k(vec.sparse_blocks(rows, (1,), block=2), 2, skip_own=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 18
