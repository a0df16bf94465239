"""Ordered labelled trees of any depth as rows of nodes.

A node is a row: the key of its tree, ``node_id`` (its place in pre-order, from
0), ``last_id`` (the last node below it, or its own id), ``parent_id`` (-1 for a
root), ``pos`` among its siblings, ``depth``, ``type``, ``text`` and
``n_children``. A node is below another where its id lies between that one's and
its ``last_id``, so that whole subtrees are found by windows over a tree's rows,
whatever its depth. Only reading a source is done row by row.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import text as tx
from treeloom.operators import trees

# Wrapper types, types that never give way to a child, punctuation leaves.
WRAPPERS = ("compilation_unit", "program", "source_file", "translation_unit")
ROOTS = ("module", "program", "source_file")
PUNCTUATION = tuple("\" ' < > ( ) { } [ ] , . : ; ... =".split())
NODE_COLUMNS = {"node_id": pa.int32(), "last_id": pa.int32(), "parent_id": pa.int32(), "pos": pa.int32(), "depth": pa.int32(), "type": pa.string(), "text": pa.string(), "n_children": pa.int32()}


_MASK = (1 << 64) - 1
NODES = 1 << 15  # of trees that are read into one batch, before the last tree


@lru_cache(1 << 14)
def _text_hash(text: str | None) -> int:
    raw = (text or "").encode()
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


@dataclass(frozen=True)
class Rules:
    """What unification renames (``aliases``), removes with all below (types or lower-cased texts) and skips (types)."""

    aliases: Mapping[str, str] = field(default_factory=dict)
    remove: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()


def expanded(names: Mapping[str, str]) -> dict[str, str]:
    """A map with a key for each of the comma-separated names of ``names``'s keys; of equal ones the last counts."""
    return {part.strip(): value for keys, value in names.items() for part in keys.split(",") if part.strip()}


class _Elements(HTMLParser):
    """Depth, name and text of a page's elements and texts in page order; stray end tags are dropped."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, str]] = [(0, "document", "")]
        self.open = ["document"]

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and self.open[-1] == "p":
            self.open.pop()
        self.found.append((len(self.open), tag, ""))
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open[1:]:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if text := " ".join(data.split()):
            self.found.append((len(self.open), "#text", text))


def _html(source: str | None) -> Iterable[tuple[int, str, str]]:
    page = _Elements()
    page.feed(source or "")
    page.close()
    return page.found


def _json(source: str | None) -> Iterator[tuple[int, str, str]]:
    try:
        root = json.loads(source) if source else None
    except ValueError:
        return
    waiting = [(0, root)] if isinstance(root, dict) else []
    while waiting:
        depth, node = waiting.pop()
        yield depth, str(node.get("type") or ""), str(node.get("text") or "")
        waiting.extend((depth + 1, c) for c in reversed(node.get("children") or []) if isinstance(c, dict))


READERS = {"html": _html, "json": _json}


def flattened(kind: str, source: str | None) -> list[list]:
    """The nodes of one source in pre-order, as lists of the columns of a node."""
    out: list[list] = []
    above: list[list] = []
    for i, (depth, name, text) in enumerate(READERS[kind](source)):
        for closed in above[depth:]:
            closed[1] = i - 1
        del above[depth:]
        up = above[-1] if above else None
        out.append([i, i, up[0] if up else -1, up[7] if up else 0, depth, name, text, 0])
        if up:
            up[7] += 1
        above.append(out[-1])
    for closed in above:
        closed[1] = len(out) - 1
    return out


def s_expression(source: str | None) -> str | None:
    """One JSON tree as ``s_expressions`` writes it; null for what is no tree."""
    nodes = flattened("json", source)
    if not nodes:
        return None
    out = []
    for (_, _, _, _, depth, name, text, n), following in zip(nodes, [*(x[4] for x in nodes[1:]), 0], strict=True):
        said = text.strip()
        shown = f" {said}" if n == 0 and said and said not in PUNCTUATION else ""
        out.append((" " if depth else "") + f"({name}{shown}" + ")" * max(0, depth - following + 1))
    return "".join(out)


def read_nodes(rows: DataFrame, key: str, source: str, kind: str) -> DataFrame:
    """The nodes of the trees that ``source`` holds as ``kind`` (``html`` or ``json`` of ``{type, text, children}``).

    ``tree`` (the key and the row's number) tells trees of equal keys apart; the
    operators below take it, or the key where it is unique, as their ``key``. An
    empty or null page is a root alone; what is no JSON object gives no rows.
    """

    def told(batch: pa.RecordBatch, owner: list[int], made: list[list]) -> pa.RecordBatch:
        at = pa.array(owner, pa.int64())
        columns = zip(*made, strict=True) if made else [[] for _ in NODE_COLUMNS]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(v, t) for v, t in zip(columns, NODE_COLUMNS.values(), strict=True))], names=[key, "tree", *NODE_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            made: list[list] = []
            for at, value in enumerate(batch.column(2)):
                found = flattened(kind, value.as_py())
                made += found
                owner += [at] * len(found)
                if len(made) > NODES:  # a batch of large trees is not held as lists at once
                    yield told(batch, owner, made)
                    owner, made = [], []
            yield told(batch, owner, made)

    kind_of = rows.schema[key].dataType.simpleString()
    schema = ", ".join(f"{k} {'string' if t == pa.string() else 'int'}" for k, t in NODE_COLUMNS.items())
    numbered = rows.select(key, F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")).alias("tree"), F.col(source).alias("__source"))
    return numbered.mapInArrow(run, f"{key} {kind_of}, tree struct<key: {kind_of}, row: bigint>, {schema}")


def _within(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (some nodes of each tree, with ``node_id`` and ``last_id``) with ``depth`` and ``leaf`` among themselves."""
    opened = rows.withColumns({"__at": F.col("node_id"), "__step": F.lit(1)})
    closed = rows.select(key, (F.col("last_id") + 1).alias("__at"), F.lit(-1).alias("__step"))
    order = Window.partitionBy(key).orderBy("__at", "__step")
    both = opened.drop("depth").unionByName(closed, allowMissingColumns=True)
    both = both.withColumn("depth", (F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).where("__step = 1")
    following = F.lead("depth").over(Window.partitionBy(key).orderBy("node_id"))
    return both.withColumn("leaf", ~F.coalesce(following > F.col("depth"), F.lit(False))).drop("__at", "__step")


def unify(nodes: DataFrame, key: str, rules: Rules, types: bool = True, texts: bool = True, compress: bool = True, max_depth: int | None = None, max_children: int | None = None, first_children: int | None = None) -> DataFrame:
    """The nodes that are left: ``node_id`` and ``last_id`` as before, ``depth`` and ``leaf`` in the new tree, ``type``, ``text``.

    With ``texts``, texts lose ``$``, ``@`` and outer semicolons; with ``types``,
    types get canonical names. With ``compress``, removed types and texts go with
    all below; punctuation and nodes without type and text go where nothing is
    left below; a node that says what its only child says gives way to it; so do
    skipped types, which become ``expression`` above several children. Nodes
    beyond a limit go with all below; by default nothing does.
    """
    plain = tx.normalize_text(F.col("text"))
    said = tx.normalize_text(F.regexp_replace(F.regexp_replace(plain, r"[$@]", ""), r"^;+|;+$", "")) if texts else plain
    raw = F.coalesce(F.col("type"), F.lit(""))
    among = lambda c, values: c.isin(*values) if values else F.lit(False)
    rows = nodes.select(key, "node_id", "last_id", "parent_id", raw.alias("raw"), said.alias("text"), (trees.canonical(raw, dict(rules.aliases)) if types else raw).alias("type"), *[F.col(c).alias(f"__{c}") for c in ("depth", "n_children", "pos")])
    gone = F.lit(False)
    for column, most in (("__depth", max_depth), ("__n_children", max_children), ("__pos", first_children and first_children - 1)):
        gone = gone if most is None else gone | (F.col(column) > most)
    if compress:
        gone = gone | (F.col("type") != "type") & (among(F.lower("text"), rules.remove) | among(F.col("type"), rules.remove))
    order = Window.partitionBy(key).orderBy("node_id")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("__gone", F.max(F.when(gone, F.col("last_id"))).over(upto)).where(F.coalesce("__gone", F.lit(-1)) < F.col("node_id"))
    if compress:
        low = F.lower("raw")
        hollow = among(low, PUNCTUATION) & ((F.col("text") == "") | (F.col("text") == low)) | (F.col("text") == "") & (F.col("type") == "")
        rows = rows.withColumn("__solid", F.min(F.when(~hollow, F.col("node_id"))).over(after)).where(~hollow | (F.col("__solid") <= F.col("last_id")))
        # The next node that is kept is the first child, if it is below at all.
        rows = rows.withColumn("__siblings", F.count("*").over(Window.partitionBy(key, "parent_id")))
        rows = rows.withColumns({"__parent": F.coalesce(F.lead("node_id").over(order) <= F.col("last_id"), F.lit(False)), "__children": F.lead("__siblings").over(order)})
        only, skipped = F.col("__parent") & (F.col("__children") == 1), among(F.col("raw"), rules.skip)
        rows = rows.withColumns({"__through": skipped & only, "__bare": F.regexp_replace(F.regexp_replace("text", r"[ \t\n()]", ""), r";+$", "")})
        says = F.first(F.when(~F.col("__through"), F.col("__bare")), ignorenulls=True).over(after)
        rows = rows.withColumn("__same", only & ~among(F.col("type"), ROOTS) & (F.col("__bare") == says))
        rows = rows.where(~F.col("__through") & ~F.col("__same")).withColumn("type", F.when(skipped & F.col("__parent"), "expression").otherwise(F.col("type")))
    return _within(rows.select(key, "node_id", "last_id", "type", "text"), key)


def deepest_root(nodes: DataFrame, key: str, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """Unified ``nodes`` without the wrappers of an only child at their roots, and how many were left out as ``wrapped``."""
    alone = F.count("*").over(Window.partitionBy(key, "depth")) == 1
    order = Window.partitionBy(key).orderBy("node_id")
    rows = nodes.withColumn("__alone", alone)
    wraps = F.col("__alone") & F.col("type").isin(*wrappers) & F.coalesce(F.lead("__alone").over(order), F.lit(False))
    rows = rows.withColumn("__wraps", F.min(wraps).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("wrapped", F.count_if("__wraps").over(Window.partitionBy(key)).cast("int")).where(~F.col("__wraps"))
    return rows.withColumn("depth", F.col("depth") - F.col("wrapped")).drop("__alone", "__wraps")


def _printed(nodes: DataFrame, key: str, piece: Column, to: str, glue: str = "") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("node_id", piece.alias("t"))))
    return nodes.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), glue).alias(to))


def s_expressions(nodes: DataFrame, key: str, to: str = "s_expression") -> DataFrame:
    """``(type child ...)`` for each tree, a leaf as ``(type text)`` unless its text is punctuation."""
    following = F.coalesce(F.lead("depth").over(Window.partitionBy(key).orderBy("node_id")), F.lit(0))
    text = tx.strip(F.col("text"))
    shown = F.when(F.col("leaf") & (text != "") & ~text.isin(*PUNCTUATION), F.concat(F.lit(" "), text)).otherwise("")
    piece = F.concat(F.when(F.col("depth") == 0, "").otherwise(" "), F.lit("("), F.col("type"), shown, F.repeat(F.lit(")"), F.greatest(F.col("depth") - F.col("__next") + 1, F.lit(0))))
    return _printed(nodes.withColumn("__next", following), key, piece, to)


def indented(nodes: DataFrame, key: str, to: str = "indented") -> DataFrame:
    """A line for each node: its type, two spaces a level."""
    return _printed(nodes, key, F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("type")), to, "\n")


def flat_texts(nodes: DataFrame, key: str, labelled: bool = False, to: str = "flat") -> DataFrame:
    """Each tree in one line, in pre-order: types and texts of leaves, or ``node_`` and ``leaf_`` tokens if ``labelled``."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    leaf = F.col("leaf") if "leaf" in nodes.columns else F.col("n_children") == 0
    if labelled:
        piece = F.concat(F.lit("node_"), tx.normalize_token(F.col("type")), F.when(leaf & (text != ""), F.concat(F.lit(" leaf_"), tx.normalize_token(text))).otherwise(""))
    else:
        piece = F.concat("type", F.when(leaf & (text != ""), F.concat(F.lit(" "), text)).otherwise(""))
    return _printed(nodes, key, piece, to, " ")


def bracketed(nodes: DataFrame, key: str, named: Sequence[str] = ("variable", "integer", "number"), to: str = "bracketed") -> DataFrame:
    """``(type child child)`` for each tree; a leaf is its text (its type if it has none), behind its type and a colon for ``named`` types."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    leaf = F.col("leaf") if "leaf" in nodes.columns else F.col("n_children") == 0
    following = F.coalesce(F.lead("depth").over(Window.partitionBy(key).orderBy("node_id")), F.lit(0))
    label = F.when(F.col("type").isin(*named), F.concat("type", F.lit(":"), text)).when(text != "", text).otherwise(F.col("type"))
    shown = F.when(leaf, F.concat(label, F.repeat(F.lit(")"), F.col("depth") - F.col("__next")))).otherwise(F.concat(F.lit("("), "type"))
    return _printed(nodes.withColumn("__next", following), key, F.concat(F.when(F.col("depth") > 0, " ").otherwise(""), shown), to)


def source_text(nodes: DataFrame, key: str, to: str = "source") -> DataFrame:
    """The text that a tree stands for: the root's, or its leaves' texts in order where the root has none."""
    leaf = F.col("leaf") if "leaf" in nodes.columns else F.col("n_children") == 0
    parts = F.array_sort(F.collect_list(F.when(leaf, F.struct("node_id", F.coalesce("text", F.lit("")).alias("t")))))
    root = F.max(F.when(F.col("depth") == 0, F.coalesce("text", F.lit(""))))
    return nodes.groupBy(key).agg(root.alias("__root"), F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("__leaves")).select(key, F.when(F.col("__root") != "", F.col("__root")).otherwise(F.col("__leaves")).alias(to))


def attributes(nodes: DataFrame, key: str, to: str = "attributes") -> DataFrame:
    """Nodes of each tree as ``n_nodes``, and the words of all their texts."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return nodes.groupBy(key).agg(F.count("*").alias("n_nodes"), F.sum(words).cast("long").alias(to))


def changed_types(original: DataFrame, unified: DataFrame, key: str) -> DataFrame:
    """Types of original nodes whose place in the unified tree holds another type, or nothing, with their numbers ``n``.

    A node's place is its position among its siblings and theirs above it; both
    trees meet in one join on the hash of these.
    """
    left = placed(original, key).select(key, "place", "depth", "type")
    right = placed(unified, key).select(key, "place", "depth", F.col("type").alias("__other"))
    both = left.join(right, [key, "place", "depth"], "left")
    return both.where(F.col("__other").isNull() | (F.col("__other") != F.col("type"))).groupBy(key, F.col("type").alias("removed_type")).agg(F.count("*").alias("n"))


def path_sets(nodes: DataFrame, key: str, to: str = "paths") -> DataFrame:
    """Hashes of the distinct paths of types from the root to the leaves of each tree."""
    leaf = F.col("leaf") if "leaf" in nodes.columns else F.col("n_children") == 0
    return placed(nodes.withColumn("__end", leaf), key).where("__end").groupBy(key).agg(F.collect_set("line").alias(to))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two sets over all; 1 where both are empty or null."""
    none = F.array().cast("array<bigint>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0))


def _fates(rows: DataFrame, severities: Sequence[float]) -> DataFrame:
    """``rows`` (trees in pre-order, each from its root, with ``index_path`` and ``__seed``) with ``__h``, a number drawn for each node, and ``__left``, a bit for each severity at which it is left. A task holds one tree beside its batch."""

    def drawn(seed: str, path: str, kind: str) -> float:
        return int.from_bytes(hashlib.sha256("|".join(x for x in (seed, path, kind) if x is not None).encode()).digest()[:8], "big") / 2.0**64

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ("__seed", "index_path", "node_id", "parent_id", "pos", "depth")
        seeds, paths, nodes, parents, places, depths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
        left, roots = [0] * len(nodes), [i for i, d in enumerate(depths) if d == 0]
        drops = [drawn(seed, path, "drop") for seed, path in zip(seeds, paths, strict=True)]
        for start, end in zip(roots, [*roots[1:], len(nodes)], strict=True):
            ends: dict[int, tuple[float, tuple[float, int]]] = {}
            for i in range(start, end):
                most, least = ends.get(parents[i], (-1.0, (2.0, 0)))
                ends[parents[i]] = max(most, drops[i]), min(least, (drops[i], places[i]))
            gone: dict[int, int] = {}
            for i in range(start, end):
                most, least = ends[parents[i]]
                own = 0 if i == start else sum(1 << n for n, s in enumerate(severities) if drops[i] < s and not (most < s and (drops[i], places[i]) == least))
                gone[nodes[i]] = own | gone.get(parents[i], 0)
                left[i] = ~gone[nodes[i]] & (1 << len(severities)) - 1
        h = [drawn(seed, path, "node") for seed, path in zip(seeds, paths, strict=True)]
        keep = [c for c in batch.schema.names if c not in ("__seed", "index_path")]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(h, pa.float64()), pa.array(left, pa.int32())], names=[*keep, "__h", "__left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            roots = [i for i, d in enumerate(batch.column(batch.schema.get_field_index("depth")).to_pylist()) if d == 0]
            rest.append(batch)
            if roots:
                whole = pa.Table.from_batches([*rest[:-1], batch.slice(0, roots[-1])]).combine_chunks()
                yield from map(told, whole.to_batches())
                rest = [batch.slice(roots[-1])]
        if rest:
            yield from map(told, pa.Table.from_batches(rest).combine_chunks().to_batches())

    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("__seed", "index_path")]).add("__h", T.DoubleType()).add("__left", T.IntegerType())
    return rows.mapInArrow(run, schema)


def degraded(nodes: DataFrame, key: str, severities: Sequence[float], seed: Column, ordered: bool = False) -> DataFrame:
    """``nodes`` after a corruption that any run repeats, at each ``severity``, by numbers from 0 to 1 drawn from ``seed`` and a node's places.

    A type other than the root's is masked below 0.55 of the severity, a text
    emptied below 0.7 of it, and a child goes with all below under the severity;
    where all children would go, the first of the least number stays, so leaves
    stay leaves and no other node becomes one. What is drawn doesn't depend on
    the severity, and is drawn once. ``seed`` rests on ``key`` alone; ``ordered``
    is as in ``placed``: then no node is shuffled.
    """
    carried = [c for c in nodes.columns if c not in ("depth", "type", "text", "leaf")]
    leaf = F.col("leaf") if "leaf" in nodes.columns else F.col("n_children") == 0
    rows = placed(nodes, key, whole=True, ordered=ordered).select(*carried, "depth", "type", "text", leaf.alias("leaf"), "index_path", seed.alias("__seed"))
    s = F.col("severity")
    kind = F.when((F.col("depth") > 0) & (F.col("__h") < 0.55 * s), F.concat(F.lit("masked_"), tx.normalize_token(F.col("type"), "node"))).otherwise(F.col("type"))
    text = F.when(F.col("__h") < 0.70 * s, F.lit("")).otherwise(F.col("text"))
    left = F.array_compact(F.array(*[F.when(F.col("__left").bitwiseAND(1 << i) > 0, F.lit(float(v))) for i, v in enumerate(severities)]))
    return _fates(rows, severities).withColumn("severity", F.explode(left)).select(*carried, "severity", "depth", kind.alias("type"), text.alias("text"), "leaf")


def category_rows(groups: Mapping[str, Sequence[str]], by_language: Mapping[str, Mapping[str, Sequence[str]]]) -> list[tuple[str, str, str]]:
    """A table of categories as rows (language, type, category): ``groups`` for the language ``''``, and for those that have other types in some category."""
    tables = {"": groups} | {language: {**groups, **own} for language, own in by_language.items()}
    return [(language, kind, category) for language, table in tables.items() for category, kinds in table.items() for kind in dict.fromkeys(kinds)]


def table_categories(nodes: DataFrame, key: str, table: DataFrame, aliases: Mapping[str, str], type_texts: Sequence[str] = (), language: Column | None = None) -> DataFrame:
    """``found``, the sorted categories of each tree, by a table of ``language``, ``type`` and ``category``; ``strange`` counts nodes without any.

    A node has the categories of its raw and of its canonical type (a program's
    is module). A text that names a type is a TYPE where the node is of that
    kind. ``language`` is that of the node's tree; one that the table lacks is ``''``.
    """
    raw, canonical = trees.canonical(F.col("type"), {}), trees.canonical(F.col("type"), dict(aliases))
    typed = F.lower("text").isin(*type_texts) & ((canonical == "type") | raw.isin(*type_texts) | raw.endswith("_type")) if type_texts else F.lit(False)
    names = F.array_distinct(F.array(raw, F.when(canonical == "program", "module").otherwise(canonical)))
    known = F.broadcast(table.select(F.col("language").alias("__l")).distinct())  # a row a language
    spoken = nodes.withColumn("__lang", language if language is not None else F.lit("")).join(known, F.col("__l") == F.col("__lang"), "left")
    kinds = spoken.groupBy(key, F.coalesce("__l", F.lit("")).alias("__lang"), names.alias("__names"), F.coalesce(typed, F.lit(False)).alias("__typed")).agg(F.count("*").alias("__n"))
    rows = F.broadcast(table.select(F.col("language").alias("__l"), F.col("type").alias("__t"), "category"))  # a few types for each category
    each = kinds.withColumn("__name", F.explode("__names")).join(rows, (F.col("__lang") == F.col("__l")) & (F.col("__name") == F.col("__t")), "left")
    listed = each.groupBy(key, "__names", "__typed", "__n").agg(F.collect_set("category").alias("__of"))
    have = F.when(F.col("__typed"), F.array_union("__of", F.array(F.lit("TYPE")))).otherwise(F.col("__of"))
    found = listed.withColumn("__have", have).groupBy(key)
    return found.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__have")))).alias("found"), F.sum(F.when(F.size("__have") == 0, F.col("__n")).otherwise(0)).alias("strange"))


def sequences(nodes: DataFrame, key: str, order: str = "node_id", to: str = "nodes") -> DataFrame:
    """The nodes of each tree in pre-order, as structs of ``place``, ``depth``, ``type`` and ``text``."""
    return nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), "depth", "type", "text"))).alias(to))


def placed(nodes: DataFrame, key: str, order: str = "node_id", last: int = 7, whole: bool = False, ordered: bool = False) -> DataFrame:
    """``nodes`` with ``types`` (the ``last`` ones from above down to the node), ``place`` and ``line``, hashes of its places and of its types from the root.

    With ``whole``, also ``label_path`` of leaves (all types, joined by ``>``) and
    ``index_path`` (places below the root as a tuple is written, ``(0, 1)``). A
    task reads its trees in pre-order and holds what is above one node. With
    ``ordered``, a tree's rows already follow each other so, as ``read_nodes``
    makes them, and aren't shuffled.
    """
    extra = {"types": pa.list_(pa.string()), "place": pa.int64(), "line": pa.int64()} | ({"label_path": pa.string(), "index_path": pa.string()} if whole else {})
    leaf = F.col("leaf") if "leaf" in nodes.columns else F.col("n_children") == 0
    sorted_ = nodes.withColumn("__leaf", leaf)
    sorted_ = sorted_ if ordered else sorted_.repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, types, places, below = None, [], [], []
        for batch in batches:
            out: dict[str, list] = {name: [] for name in extra}
            for k, depth, kind, is_leaf in zip(*(batch.column(c).to_pylist() for c in (key, "depth", "type", "__leaf")), strict=True):
                if k != tree or depth == 0:
                    tree, types, places, below = k, [], [], []
                del types[depth:], places[depth:], below[depth + 1 :]
                pos = 0
                if depth:
                    pos = below[depth] if len(below) > depth else 0
                    below[depth:] = [pos + 1]
                else:
                    below = [1]
                types.append(kind)
                up_place, up_line = places[-1] if places else (17, 17)
                places.append(((up_place * 0x9E3779B97F4A7C15 + pos + 1 & _MASK) * 0xBF58476D1CE4E5B9 & _MASK, (up_line * 0x9E3779B97F4A7C15 + _text_hash(kind) & _MASK) * 0x94D049BB133111EB & _MASK))
                out["types"].append(types[-last:])
                for name, h in zip(("place", "line"), places[-1], strict=True):
                    h ^= h >> 31
                    out[name].append(h - (1 << 64) if h >> 63 else h)
                if whole:
                    steps = [n - 1 for n in below[1 : depth + 1]]
                    out["label_path"].append(">".join(types) if is_leaf else None)
                    out["index_path"].append(str(tuple(steps)))
            keep = [c for c in batch.schema.names if c != "__leaf"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, extra[k]) for k, v in out.items())], names=[*keep, *extra])

    kinds = {"types": T.ArrayType(T.StringType()), "place": T.LongType(), "line": T.LongType(), "label_path": T.StringType(), "index_path": T.StringType()}
    schema = T.StructType([f for f in nodes.schema.fields if f.name not in extra])
    for name in extra:
        schema = schema.add(name, kinds[name])
    return sorted_.drop(*extra).mapInArrow(run, schema)


def label_paths(nodes: DataFrame, key: str) -> DataFrame:
    """Distinct paths of types from the root to each leaf, joined by ``>``, with their numbers ``n``."""
    return placed(nodes, key, whole=True).where("label_path IS NOT NULL").groupBy(key, F.col("label_path").alias("path")).agg(F.count("*").alias("n"))


def structural_features(nodes: DataFrame, key: str, last: int = 7, order: str = "node_id") -> DataFrame:
    """Features of all nodes with their counts: type, depth, arity, edge, and for leaves the path of the ``last`` types."""
    kind = lambda c: tx.normalize_token(c)
    own, depth, arity = kind(F.col("type")), F.least("depth", F.lit(8)).cast("string"), F.least("n_children", F.lit(8)).cast("string")
    path = F.array_join(F.transform("types", kind), "_")
    features = F.array_compact(F.array(
        F.concat(F.lit("node_"), own), F.concat(F.lit("depth_"), depth, F.lit("_"), own), F.concat(F.lit("arity_"), own, F.lit("_"), arity),
        F.when(F.col("depth") > 0, F.concat(F.lit("edge_"), kind(F.try_element_at("types", F.lit(-2))), F.lit("_"), own)), F.when(F.col("n_children") == 0, F.concat(F.lit("path_"), path)),
    ))
    return placed(nodes, key, order, last).select(key, F.explode(features).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("n"))


def categories(nodes: DataFrame, key: str, groups: Mapping[str, Sequence[str]], aliases: Mapping[str, str], also: Mapping[str, Column] | None = None) -> DataFrame:
    """``found``, the sorted categories of each tree: those that ``groups`` gives a node's raw or canonical type, or where a condition of ``also`` holds. ``strange`` counts nodes without any."""
    of: dict[str, list[str]] = {}
    for category, names in groups.items():
        for name in names:
            of.setdefault(name, []).append(category)
    table = F.create_map(*[x for name, own in of.items() for x in (F.lit(name), F.array(*map(F.lit, own)))])
    none = F.array().cast("array<string>")
    sets = [F.coalesce(F.try_element_at(table, trees.canonical(F.col("type"), known)), none) for known in ({}, dict(aliases))]
    sets += [F.when(condition, F.array(F.lit(category))).otherwise(none) for category, condition in (also or {}).items()]
    rows = nodes.withColumn("__found", F.array_distinct(F.concat(*sets)))
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__found")))).alias("found"), F.count_if(F.size("__found") == 0).alias("strange"))


def completeness(original: DataFrame, unified: DataFrame, key: str, views: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each view (some categories): the share of the original tree's categories that the unified one has (1 where there are none), its ``loss``, how many there were and are, and which are lost and extra."""
    both = original.select(key, F.col("found").alias("o"), "strange").join(unified.select(key, F.col("found").alias("u")), key, "left").withColumn("u", F.coalesce("u", F.array().cast("array<string>")))
    shown = []
    for name, wanted in views.items():
        only = F.array(*map(F.lit, wanted))
        o, u = F.array_intersect("o", only), F.array_intersect("u", only)
        score = F.coalesce(F.try_divide(F.size(F.array_intersect(o, u)), F.size(o)), F.lit(1.0))
        shown += [F.size(o).alias(f"had_{name}"), F.size(F.array_intersect(o, u)).alias(f"kept_{name}"), F.bround(score, 4).alias(f"pec_{name}"), F.bround(1 - score, 4).alias(f"loss_{name}"), F.array_join(F.array_except(o, u), ",").alias(f"lost_{name}"), F.array_join(F.array_except(u, o), ",").alias(f"extra_{name}")]
    return both.select(key, *shown, "strange")
