"""Ordered labelled trees as rows of nodes.

A document is a tree of three levels: the document, its lines, and their leaves
(runs of letters and digits, or of other signs). ``leaves`` gives a row for each
leaf; ``nodes`` adds lines and roots. The unified tree maps leaf types to
canonical ones, drops punctuation, lower-cases texts, drops lines without
leaves and puts a lone leaf in its line's place. JSON trees of any depth become
the same rows with ``flatten_json``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import text as tx

# Leaf types and their canonical names; punctuation is removed.
CANONICAL = {"word": "identifier", "mixed": "identifier", "number": "literal"}
REMOVED = ("punct",)


def leaf_type(text: Column) -> Column:
    return F.when(text.rlike(r"^\p{L}+$"), "word").when(text.rlike(r"^\p{N}+$"), "number").when(text.rlike(r"[\p{L}\p{N}_]"), "mixed").otherwise("punct")


def leaves(docs: DataFrame, keep: Sequence[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``line`` and ``pos`` (from 1), ``type`` and ``text`` of all leaves, in place of a document's text."""
    lines = docs.select(key, *keep, F.posexplode(F.split(text, "\n", -1)).alias("line", "__words"))
    cut = lines.select(key, *keep, (F.col("line") + 1).alias("line"), F.posexplode(F.regexp_extract_all("__words", F.lit(tx.LEAF), F.lit(0))).alias("pos", "text"))
    return cut.select(key, *keep, "line", (F.col("pos") + 1).alias("pos"), leaf_type(F.col("text")).alias("type"), "text")


def canonical(kind: Column, aliases: dict[str, str] = CANONICAL) -> Column:
    """Canonical name of a node type: without dollar signs and white space, lower case, ``:=`` as ``=``; itself if it has no alias."""
    clean = F.regexp_replace(F.lower(tx.strip(F.regexp_replace(kind, r"\$", ""))), ":=", "=")
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return clean if named is None else F.coalesce(F.try_element_at(named, clean), clean)


def unified(rows: DataFrame) -> DataFrame:
    """Leaves of the unified tree: canonical types, lower-cased texts, no punctuation."""
    return rows.where(~F.col("type").isin(*REMOVED)).withColumns({"type": canonical(F.col("type")), "text": F.lower("text")})


def line_sizes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key, "line").agg(F.count("*").alias("n_line"))


def node_counts(rows: DataFrame, lines: Column, key: str = "doc_id") -> DataFrame:
    """Nodes of each tree: root, lines as ``lines`` counts them (of ``n_line``, leaves in a line), and leaves."""
    return line_sizes(rows, key).groupBy(key).agg((1 + F.sum(lines) + F.sum("n_line")).cast("long").alias("n_nodes"))


def nodes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """All nodes: ``path`` (zero-padded places from the root), ``depth``, ``type``, ``text``, ``parent_type``, ``n_children``."""
    path = lambda *c: F.concat_ws(".", *[F.lpad(x.cast("string"), 6, "0") for x in c])
    sizes = line_sizes(rows, key)
    leaf = rows.select(key, path(F.col("line"), F.col("pos")).alias("path"), F.lit(2).alias("depth"), "type", "text", F.lit("line").alias("parent_type"), F.lit(0).cast("long").alias("n_children"))
    line = sizes.select(key, path(F.col("line")).alias("path"), F.lit(1).alias("depth"), F.lit("line").alias("type"), F.lit("").alias("text"), F.lit("document").alias("parent_type"), F.col("n_line").alias("n_children"))
    root = sizes.groupBy(key).agg(F.count("*").alias("n_children")).select(key, F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit("document").alias("type"), F.lit("").alias("text"), F.lit(None).cast("string").alias("parent_type"), "n_children")
    return leaf.unionByName(line).unionByName(root)


def structural_features(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Features of all nodes with their counts: type, depth, arity, edge and path of the last types."""
    depth, arity = F.least("depth", F.lit(8)).cast("string"), F.least("n_children", F.lit(8)).cast("string")
    kind, parent = tx.normalize_token(F.col("type")), tx.normalize_token(F.col("parent_type"))
    features = F.array_compact(F.array(
        F.concat(F.lit("node_"), kind), F.concat(F.lit("depth_"), depth, F.lit("_"), kind), F.concat(F.lit("arity_"), kind, F.lit("_"), arity),
        F.when(F.col("parent_type").isNotNull(), F.concat(F.lit("edge_"), parent, F.lit("_"), kind)), F.when(F.col("depth") == 2, F.concat(F.lit("path_document_line_"), kind)),
    ))
    grouped = nodes(rows, key).groupBy(key, "type", "parent_type", "depth", "n_children").agg(F.count("*").alias("n"))
    return grouped.select(key, F.explode(features).alias("feature"), "n").groupBy(key, "feature").agg(F.sum("n").alias("n"))


def flat_text(rows: DataFrame, key: str = "doc_id", labelled: bool = False) -> DataFrame:
    """Each tree in one line, in pre-order: types and leaf texts, or ``node_`` and ``leaf_`` tokens if ``labelled``."""
    if labelled:
        leaf = F.concat(F.lit("node_"), tx.normalize_token(F.col("type")), F.lit(" leaf_"), tx.normalize_token(F.col("text")))
        heads = ("node_document", "node_line")
    else:
        leaf, heads = F.concat_ws(" ", "type", "text"), ("document", "line")
    lines = rows.select(key, "line", F.struct("pos", leaf.alias("t")).alias("x")).groupBy(key, "line").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    joined = lines.select(key, F.struct("line", F.concat_ws(" ", F.lit(heads[1]), F.array_join(F.transform("xs", lambda x: x["t"]), " ")).alias("t")).alias("x"))
    return joined.groupBy(key).agg(F.concat_ws(" ", F.lit(heads[0]), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ")).alias("flat"))


def bag_similarity(a: DataFrame, b: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """Sum of the smaller over sum of the larger counts ``n`` of ``label``, for trees that share ``on``."""
    both = a.select(*on, label, F.col("n").alias("na")).join(b.select(*on, label, F.col("n").alias("nb")), [*on, label], "full").na.fill(0, ["na", "nb"])
    return both.groupBy(*on).agg((F.sum(F.least("na", "nb")) / F.sum(F.greatest("na", "nb"))).alias("bag_similarity"))


def flatten_json(trees: DataFrame, key: str, tree: str, max_depth: int | None = None) -> DataFrame:
    """Rows of nodes of JSON trees ``{type, text, children}``: ``node_id`` in pre-order, ``parent_id``, ``pos``, ``depth``, ``path``, ``type``, ``text``, ``n_children``.

    A text that is no JSON object, or null, gives no rows. Nodes deeper than
    ``max_depth`` are left out, by default none.
    """
    kind = trees.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, node_id int, parent_id int, pos int, depth int, path string, type string, text string, n_children int"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            owner: list[int] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                try:
                    root = json.loads(value) if value else None
                except ValueError:
                    root = None
                if not isinstance(root, dict):
                    continue
                stack, number = [(root, -1, 0, 0, "")], 0
                while stack:
                    node, parent, pos, depth, path = stack.pop()
                    children = [c for c in node.get("children") or [] if isinstance(c, dict)] if max_depth is None or depth < max_depth else []
                    for column, v in zip(out, (number, parent, pos, depth, path, str(node.get("type", "")), str(node.get("text") or ""), len(children)), strict=True):
                        column.append(v)
                    owner.append(i)
                    stack.extend((c, number, j, depth + 1, f"{path}.{j:04d}" if path else f"{j:04d}") for j, c in reversed(list(enumerate(children))))
                    number += 1
            types = [pa.int32()] * 4 + [pa.string()] * 3 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=names)

    return trees.select(key, tree).mapInArrow(run, schema)


def _paths(line: Column, pos: Column) -> tuple[Column, Column]:
    """The places of a line and of a leaf below the root, as tuples are written."""
    up = (line - 1).cast("string")
    return F.concat(F.lit("("), up, F.lit(",)")), F.concat(F.lit("("), up, F.lit(", "), (pos - 1).cast("string"), F.lit(")"))


def drawn_leaves(docs: DataFrame, seed: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``leaves`` with what ``drawn`` draws for them, in the task that reads a text: no leaf is shuffled."""
    words = lambda w: F.regexp_extract_all(w, F.lit(tx.LEAF), F.lit(0))
    said = docs.where(F.col(key).isNotNull()).select(key, seed.alias("__seed"), F.transform(F.split(text, "\n", -1), lambda w, i: F.struct((i + 1).alias("line"), words(w).alias("words"))).alias("__lines"))
    own, none = F.col("__seed"), F.lit(1)
    line = lambda x: F.struct(tx.unit_float(own, _paths(x["line"], none)[0], F.lit("drop")).alias("drop"), x["line"].alias("line"), x["words"].alias("words"))
    lines = said.select(key, "__seed", F.transform(F.filter("__lines", lambda x: F.size(x["words"]) > 0), line).alias("__lines"))
    # What holds for all lines of a text, or all leaves of a line, is found before these become rows. An outer explode
    # doesn't make Spark draw all once more to see whether there are any.
    ends = F.transform("__lines", lambda x: F.struct(x["drop"], x["line"]))
    lines = lines.select(key, "__seed", F.array_max(ends).getField("drop").alias("__line_most"), F.array_min(ends).getField("line").alias("__line_least"), "__lines")
    each = lines.select(key, "__seed", "__line_most", "__line_least", F.explode_outer("__lines").alias("x")).where("x IS NOT NULL")
    leaf = F.transform("x.words", lambda w, j: F.struct(tx.unit_float(own, _paths(F.col("x.line"), j + 1)[1], F.lit("drop")).alias("drop"), (j + 1).alias("pos"), w.alias("text")))
    each = each.select(key, "__seed", "__line_most", "x.line", F.col("x.drop").alias("__line_drop"), (F.col("__line_least") == F.col("x.line")).alias("__line_first"), leaf.alias("__leaves"))
    ends = F.transform("__leaves", lambda x: F.struct(x["drop"], x["pos"]))
    drawn_once = [c for c in each.columns if c != "__leaves"]
    each = each.select(*drawn_once, F.array_max(ends).getField("drop").alias("__most"), F.array_min(ends).getField("pos").alias("__least"), "__leaves")
    each = each.select(*drawn_once, "__most", "__least", F.explode_outer("__leaves").alias("x"))
    return each.select(key, "line", "x.pos", leaf_type(F.col("x.text")).alias("type"), "x.text", tx.unit_float(own, _paths(F.col("line"), F.col("x.pos"))[1], F.lit("node")).alias("__h"), "__line_drop", "__line_most", "__line_first", F.col("x.drop").alias("__drop"), "__most", (F.col("__least") == F.col("x.pos")).alias("__first"))


def drawn(rows: DataFrame, seed: Column, key: str = "doc_id") -> DataFrame:
    """``rows`` (leaves) with numbers from 0 to 1 drawn from ``seed`` and path, for the drop of leaf and line and for the node, the largest drop among siblings, and which sibling has the least."""
    line_path, leaf_path = _paths(F.col("line"), F.col("pos"))
    marked = rows.where(F.col(key).isNotNull()).repartition(key).withColumns({"__line_drop": tx.unit_float(seed, line_path, F.lit("drop")), "__drop": tx.unit_float(seed, leaf_path, F.lit("drop")), "__h": tx.unit_float(seed, leaf_path, F.lit("node"))})
    lines, own = Window.partitionBy(key), Window.partitionBy(key, "line")
    first = lambda drop, place, among: F.struct(drop, place) == F.min(F.struct(drop, place)).over(among)
    return marked.withColumns({"__line_most": F.max("__line_drop").over(lines), "__line_first": first("__line_drop", "line", lines), "__most": F.max("__drop").over(own), "__first": first("__drop", "pos", own)})


def survives(severity: Column) -> Column:
    """Whether a drawn leaf is left: neither it nor its line dropped, or each of these the one that stays where all would go."""
    stays = lambda p: (F.col(f"__{p}drop") >= severity) | ((F.col(f"__{p}most") < severity) & F.col(f"__{p}first"))
    return stays("line_") & stays("")


def masked(severity: Column) -> Column:
    """Whether a drawn leaf's type is masked."""
    return F.col("__h") < 0.55 * severity


def blanked(severity: Column) -> Column:
    """Whether a drawn leaf's text is blanked."""
    return F.col("__h") < 0.70 * severity


def corrupted(leaves_drawn: DataFrame, severity: Column, key: str = "doc_id") -> DataFrame:
    """The leaves that are left of drawn ones at each ``severity``: a number, or an explode of several. Nothing that is drawn depends on it."""
    s = F.col("severity")
    rows = leaves_drawn.withColumn("severity", severity).where(survives(s))
    return rows.select(key, "line", "pos", "severity", F.when(masked(s), F.concat(F.lit("masked_"), F.col("type"))).otherwise(F.col("type")).alias("type"), F.when(blanked(s), F.lit("")).otherwise(F.col("text")).alias("text"))


def degraded(rows: DataFrame, severity: Column, seed: Column, key: str = "doc_id") -> DataFrame:
    """Leaves of deterministically corrupted trees.

    By hashes of seed and path: a node's type is masked below 0.55 * severity,
    its text blanked below 0.70 * severity, a child dropped below severity by a
    second hash; where all children of a node would go, the one of the smallest
    hash stays. A dropped line takes its leaves along.
    """
    return corrupted(drawn(rows, seed, key), severity, key)
