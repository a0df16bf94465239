"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). In the flow network each pattern offers its words once at cost 0, once
more at cost 1, and so on up to ``max_repeats`` times, so that costs are convex
in the number of repeats; an arc leads from a pattern to each of its sources,
and each source takes up to its quota. The cheapest maximal flow gives each
pattern a number of words. Its documents, in seeded order, then supply whole
passes over the pattern and a last part of a pass; the document at the edge of
that part is cut there, so that the words taken equal the flow. Sources that share
no document need no flow; the others are solved by groups that share some.

Nulls, ties, edges: a null source is a source of its own, sorted last; a null
or empty text has size 0 and nothing is taken of it. The seeded order is by a
hash of key and seed, then key, then a hash of the whole row; rows equal in all
columns are ordered arbitrarily, which changes no result. An empty table gives
no rows. Columns named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import prepare, stored

BUCKETS = 4096
MAX_PATTERNS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(blank, " "), lambda w: w != "")), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> dict:
    """Shares of all words by weight (repeating, in the order of ``sizes``); where one is above ``most`` times its source, it stops there and the excess is shared again."""
    total = float(sum(sizes.values()))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(sizes)}
    fixed: dict = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: fixed[s] if s in fixed else share[s] for s in sizes}
        for s in over:
            fixed[s] = most * sizes[s]
        if len(over) == len(free):
            return {s: fixed[s] for s in sizes}


def _components(patterns: Iterable[tuple]) -> list[list[tuple]]:
    """Patterns in groups that share no source with each other."""
    parent: dict = {}

    def root(s):
        while parent.setdefault(s, s) != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for p in patterns:
        for s in p[1:]:
            parent[root(s)] = root(p[0])
    groups: dict = {}
    for p in patterns:
        groups.setdefault(root(p[0]), []).append(p)
    return list(groups.values())


def _push(spare: list[int], room: list[int], near: list[list[int]], sent: list[dict[int, int]]) -> None:
    """Raise the flow ``sent`` from patterns (nodes below ``len(spare)``) to sources (the others) to its maximum, by blocking flows.

    What a pattern can still send is ``spare``, what a source still takes ``room``.
    A step from a source to a pattern takes back what that pattern sends to it.
    """
    n = len(spare)
    while True:
        depth = [-1] * len(near)
        front, reached = [p for p in range(n) if spare[p]], False
        for p in front:
            depth[p] = 0
        while front and not reached:
            found = []
            for a in front:
                for b in near[a]:
                    if depth[b] < 0 and (a < n or sent[b].get(a)):
                        depth[b] = depth[a] + 1
                        found.append(b)
                        reached = reached or (b >= n and room[b - n] > 0)
            front = found
        if not reached:
            return
        tried = [0] * len(near)
        for p in range(n):
            path = [p] if spare[p] and depth[p] == 0 else []
            while path:
                a = path[-1]
                if a >= n and room[a - n]:
                    back = list(zip(path[1::2], path[2::2], strict=False))
                    amount = min(spare[p], room[a - n], *(sent[q][s] for s, q in back))
                    for s, q in back:
                        sent[q][s] -= amount
                    for q, s in zip(path[::2], path[1::2], strict=True):
                        sent[q][s] = sent[q].get(s, 0) + amount
                    spare[p] -= amount
                    room[a - n] -= amount
                    path = [p] if spare[p] else []
                    continue
                while tried[a] < len(near[a]):
                    b = near[a][tried[a]]
                    if depth[b] == depth[a] + 1 and (a < n or sent[b].get(a)):
                        path.append(b)
                        break
                    tried[a] += 1
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, max_repeats: int = 3) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources: a maximal flow of least repetition cost.

    Only the arcs into patterns cost something, the n-th pass over a pattern
    n - 1; no path of a flow comes back to the start, so paths of equal cost are
    those through patterns with words left in the same pass, and the cheapest flow
    is found pass by pass, each by blocking flows on top of those before. A source
    that shares no document with another has one pattern and takes what it can.
    """
    flow: dict[tuple, dict] = {}
    for group in _components(patterns):
        if len(group) == 1 and len(group[0]) == 1:
            (p,) = group
            flow[p] = {p[0]: min(int(patterns[p]) * max_repeats, int(quotas[p[0]]))}
            continue
        n, names = len(group), list(dict.fromkeys(s for p in group for s in p))
        node = {s: n + i for i, s in enumerate(names)}
        near: list[list[int]] = [[node[s] for s in p] for p in group] + [[] for _ in names]
        for i, p in enumerate(group):
            for s in p:
                near[node[s]].append(i)
        spare, room = [0] * n, [int(quotas[s]) for s in names]
        sent: list[dict[int, int]] = [{} for _ in group]
        for _ in range(max_repeats):
            spare = [left + int(patterns[p]) for left, p in zip(spare, group, strict=True)]
            _push(spare, room, near, sent)
        for p, to in zip(group, sent, strict=True):
            flow[p] = {s: to.get(node[s], 0) for s in p}
    return flow


def mix(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, seed: int = 0, size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size`` and ``target`` (of its first source) and ``taken``, in words.

    ``sources`` is an array of the sources a document belongs to, ``size`` its
    words (counted in ``text`` by default). What is planned on is written and read
    again: the sums, and the rows where they hold no texts. Patterns and
    sources are few (at most ``MAX_PATTERNS``, else an error), so the flow is
    solved on the driver; all else is grouped and cumulated by Spark: running
    sums within a pattern go through ``BUCKETS`` hash ranges, so that a pattern
    with any share of the rows is never one task.
    """
    spark = prepare(docs.sparkSession)
    kept = docs.drop("size", "source_size", "target", "taken")
    order = F.xxhash64(F.col(key), F.lit(seed))
    sized = kept.withColumns({
        "__sources": F.array_sort(F.array_distinct(sources), lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0)),
        "size": word_count(F.col(text)) if size is None else size.cast("long"), "__order": order, "__tie": F.xxhash64(*[F.col(f.name) for f in kept.schema.fields if not isinstance(f.dataType, T.MapType)]),
    }).withColumn("__bucket", F.shiftrightunsigned("__order", 52).cast("int"))
    if text not in kept.columns:
        sized = stored(sized, "sized")  # no copy of the texts
    cells = stored(sized.groupBy("__sources", "__bucket").agg(F.sum("size").alias("words")), "cells")
    per_pattern = cells.groupBy("__sources").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(per_pattern) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    by_code = lambda s: (s is None, [] if s is None else [ord(c) for c in s])
    patterns = {tuple(r["__sources"]): int(r["words"] or 0) for r in per_pattern if r["__sources"]}
    patterns = {p: patterns[p] for p in sorted(patterns, key=lambda p: list(map(by_code, p)))}  # of equally cheap flows always the same
    names = sorted({s for p in patterns for s in p}, key=by_code)
    sizes = dict.fromkeys(names, 0)
    for p, words in patterns.items():
        for s in p:
            sizes[s] += words
    targets = capped_targets(sizes, weights, max_repeats)
    flow = min_cost_flow(patterns, {s: round(t) for s, t in targets.items()}, max_repeats)
    plan = [(list(p), sizes[p[0]], float(targets[p[0]]), *divmod(sum(flow[p].values()), max(words, 1))) for p, words in patterns.items()]
    sources_type = sized.schema["__sources"].dataType
    plan_df = spark.createDataFrame(plan, T.StructType([T.StructField("__sources", sources_type), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("__passes", T.LongType()), T.StructField("__rest", T.LongType())]))
    same = lambda a, b: a["__sources"].eqNullSafe(b["__sources"])
    # Bounded: at most MAX_PATTERNS rows of plan; at most BUCKETS cells a pattern, of which the one with the edge is kept.
    upto = cells.withColumn("__before", F.coalesce(F.sum("words").over(Window.partitionBy("__sources").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = upto.join(F.broadcast(plan_df.select("__sources", "__rest")), same(upto, plan_df)).drop(plan_df["__sources"])
    edge = edge.where((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("words"))).select("__sources", F.col("__bucket").alias("__edge"), F.col("__rest") - F.col("__before"))
    edge = edge.toDF("__sources", "__edge", "__edge_rest")
    plan_df = plan_df.join(F.broadcast(edge), same(plan_df, edge), "left").drop(edge["__sources"])
    planned = sized.join(F.broadcast(plan_df), same(sized, plan_df), "left").drop(plan_df["__sources"])
    at_edge = F.coalesce(F.col("__bucket") == F.col("__edge"), F.lit(False))
    running = F.sum("size").over(Window.partitionBy("__sources", "__bucket").orderBy("__order", key, "__tie").rowsBetween(Window.unboundedPreceding, -1))
    inside = planned.where(at_edge).withColumn("__part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__edge_rest") - F.coalesce(running, F.lit(0)))))
    outside = planned.where(~at_edge).withColumn("__part", F.when(F.col("__bucket") < F.coalesce(F.col("__edge"), F.lit(-1)), F.col("size")).otherwise(F.lit(0)).cast("long"))
    taken = (F.coalesce(F.col("__passes"), F.lit(0)) * F.col("size") + F.col("__part")).cast("long")
    return outside.unionByName(inside).select(*kept.columns, "size", "source_size", "target", taken.alias("taken"))


def take(mixed: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The rows of a mix: a document as often as it is taken, always whole. A last part counts as once more from half a document on, so that a source keeps to its target but for half of the document at its edge."""
    columns = list(columns) or [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    copies = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return mixed.where("taken > 0").withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to the weights 1, 2, 3 of their sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix(docs, F.array("source"), size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")
