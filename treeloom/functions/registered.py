"""Functions for SQL text: ``register`` makes them known to a session.

``tree_flatten(tree)`` is a table function, for use behind LATERAL: the nodes of
a JSON tree. ``ted_distance``, ``ted_similarity``, ``s_expr``, ``lcs_len`` and
``meteor`` are scalar, over Arrow batches; they are null where an argument is,
or is no tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.operators import edit_distance as ed
from treeloom.operators import evaluation as ev
from treeloom.operators import node_tables as nt

_NODE = T.StructType([T.StructField(name, T.StringType() if kind == pa.string() else T.IntegerType()) for name, kind in nt.NODE_COLUMNS.items()])


@F.udtf(returnType=_NODE)
class TreeFlatten:
    """The nodes of a JSON tree in pre-order; none for what is no tree."""

    def eval(self, tree: str) -> Iterator[tuple]:
        yield from nt.flattened("json", tree)


def _listed(tree: str | None) -> tuple[list[int], list[str]] | None:
    found = list(nt.READERS["json"](tree))
    return ([d for d, _, _ in found], [t for _, t, _ in found]) if found else None


def _each(arrays: tuple[pa.Array, ...], f, kind: pa.DataType) -> pa.Array:
    return pa.array([None if any(x is None for x in row) else f(*row) for row in zip(*(a.to_pylist() for a in arrays), strict=True)], kind)


def _moved(a: str, b: str, similar: bool) -> float | int | None:
    one, two = _listed(a), _listed(b)
    if one is None or two is None:
        return None
    moves = ed.distance(one, two)
    return min(1.0, max(0.0, 1 - moves / (len(one[0]) + len(two[0])))) if similar else moves


@F.arrow_udf(T.LongType())
def ted_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each((a, b), lambda x, y: _moved(x, y, False), pa.int64())


@F.arrow_udf(T.DoubleType())
def ted_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each((a, b), lambda x, y: _moved(x, y, True), pa.float64())


@F.arrow_udf(T.StringType())
def s_expr(tree: pa.Array) -> pa.Array:
    return _each((tree,), nt.s_expression, pa.string())


@F.arrow_udf(T.LongType())
def lcs_len(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each((a, b), ev.lcs_length, pa.int64())


@F.arrow_udf(T.DoubleType())
def meteor(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return _each((reference, hypothesis), lambda r, h: ev.meteor(r, h) if r and h else 0.0, pa.float64())


SCALARS = {"ted_distance": ted_distance, "ted_similarity": ted_similarity, "s_expr": s_expr, "lcs_len": lcs_len, "meteor": meteor}


def register(spark: SparkSession) -> None:
    """Make all functions known to ``spark`` by their names."""
    spark.udtf.register("tree_flatten", TreeFlatten)
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
