"""Exact top-k inner products by M-trees and best-first search.

Vectors become points of a metric space by one more component, sqrt(M^2 - |x|^2)
with M the largest norm; a query's is 0. Then the squared distance of a query and
a vector is |q|^2 + M^2 - 2 <q, x>, so that the nearest points have the largest
inner products and the triangle inequality holds.

Seeded pivots (at most ``PIVOTS``) deal the points to groups of near ones, and a
group above ``TREE_ROWS`` is dealt to several trees. A tree is loaded in bulk:
halved between two far points until a page holds at most ``PAGE`` points. A page
has a routing point (a member), its covering radius and its distance to the
root's routing point; each entry has its distance to the page's.

A query first goes through the tree it belongs to, which gives its first k-th
best. Then blocks of queries meet shelves of trees, but only those whose balls
can hold something better. There pages are visited in waves, each query's most
promising first; the distances stored with pages and entries rule out most
distances and inner products by the triangle inequality before they are
computed, and each wave lowers the k-th best distance for the next.
All inner products are exact integers; bounds have a slack for rounding.

Nulls, ties, edges: vectors that are null, of another length than most, or that
hold null or non-finite components take no part; zero vectors do. Equal scores
are ordered by id. Rows with a query's own id are no candidates of it. Rows that
repeat an id are separate candidates; as queries they count once (the first by
their components). Fewer than k candidates are all returned. Norms must stay
below 2^31, so that products fit 64 bits; larger ones are an error. Empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import prepare, stored

PIVOTS = 4096
TREE_ROWS = 1024
PAGE = 32
SHELF_TREES = 16
QUERY_BLOCK = 16384
WAVES = (1, 3, 8)  # pages a query visits in the first waves; the last takes all that are left


@dataclass
class Tree:
    """Points in page order, with the numbers of their pages and of the root."""

    ids: np.ndarray
    x: np.ndarray
    starts: np.ndarray  # where each page begins, and the end
    routers: np.ndarray  # the place of each page's routing point
    radii: np.ndarray
    to_root: np.ndarray  # distance of each page's routing point to the root's
    to_page: np.ndarray  # distance of each point to its page's routing point
    root: int
    radius: float

    def pack(self) -> list[bytes]:
        return [v.tobytes() for v in (self.ids, self.x, self.starts, self.routers, self.radii, self.to_root, self.to_page, np.array([self.root, self.radius], float))]

    @classmethod
    def unpack(cls, parts: list[bytes], dims: int, kind: np.dtype) -> Tree:
        ids, x, starts, routers, radii, to_root, to_page, top = (np.frombuffer(p, t) for p, t in zip(parts, (np.int64, kind, np.int32, np.int32, float, float, float, float), strict=True))
        return cls(ids, x.reshape(-1, dims), starts, routers, radii, to_root, to_page, int(top[0]), float(top[1]))


_FIELDS = ["ids", "x", "starts", "routers", "radii", "to_root", "to_page", "top"]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Points of ``x`` with the component that gives all the norm ``sqrt(most)``."""
    x = x.astype(float)
    return np.column_stack((x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))))


def _apart(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(1))


def _central(points: np.ndarray) -> int:
    return int(_apart(points, points.mean(0)).argmin())


def load_tree(ids: np.ndarray, x: np.ndarray, most: float, page: int = PAGE) -> Tree:
    """An M-tree of two levels over ``x``, loaded in bulk."""
    points = lifted(x, most)
    waiting, pages = [np.argsort(ids, kind="stable")], []
    while waiting:
        own = waiting.pop()
        if len(own) <= page:
            pages.append(own)
            continue
        first = own[_apart(points[own], points[own[0]]).argmax()]
        near = _apart(points[own], points[first])
        order = np.argsort(near - _apart(points[own], points[own[near.argmax()]]), kind="stable")
        half = -(-len(own) // page) // 2 * page  # full pages on one side
        waiting += [own[order[half:]], own[order[:half]]]
    order = np.concatenate(pages)
    points = points[order]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in pages]))).astype(np.int32)
    root = _central(points)
    routers, to_page = np.zeros(len(pages), np.int32), np.zeros(len(order))
    for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        routers[i] = lo + _central(points[lo:hi])
        to_page[lo:hi] = _apart(points[lo:hi], points[routers[i]])
    radii = np.maximum.reduceat(to_page, starts[:-1])
    return Tree(ids[order], x[order], starts, routers, radii, _apart(points[routers], points[root]), to_page, root, float(_apart(points, points[root]).max()))


class Nearest:
    """The k best of each query of a block so far: scores and ids, best first; below ``floor`` nothing is looked for."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, most: float, floor: np.ndarray, wide: bool):
        self.kind = np.int64 if wide else float  # floats hold integers below 2^53
        self.q, self.ids, self.k, self.floor = queries.astype(self.kind), ids, k, floor.astype(np.int64).copy()
        q = queries.astype(float)
        self.lift = (q * q).sum(1) + most
        self.slack = 1e-7 * (1 + np.sqrt(self.lift))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        self._reach()

    def _reach(self) -> None:
        """The distance of the k-th best, beyond which nothing counts."""
        self.reach = np.sqrt(np.maximum(self.lift - 2 * self.floor.astype(float), 0)) + self.slack

    def far(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Distances of queries to routing points."""
        return np.sqrt(np.maximum(self.lift[rows, None] - 2 * (self.q[rows] @ x.astype(self.kind).T).astype(float), 0))

    def settle(self) -> None:
        """Take in what was found: the k best of each query, and its new k-th best."""
        if not self.found:
            return
        at, ids, score = (np.concatenate(c) for c in zip(self.kept, *self.found, strict=True))
        self.found = []
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        best = nth < self.k
        self.kept = at[best], ids[best], score[best]
        last = nth == self.k - 1
        self.floor[at[last]] = np.maximum(self.floor[at[last]], score[last])
        self._reach()

    def visit(self, tree: Tree, rows: np.ndarray) -> None:
        """Search ``tree`` for the queries ``rows``, page by page in waves."""
        to_root = self.far(rows, tree.x[[tree.root]])[:, 0]
        near = to_root - tree.radius <= self.reach[rows]
        rows, to_root = rows[near], to_root[near]
        if not len(rows):
            return
        # By the stored distances alone, then by those to the pages' routing points that are left.
        bound = np.abs(to_root[:, None] - tree.to_root) - tree.radii
        open_ = bound <= self.reach[rows, None]
        some_rows, some_pages = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        rows, bound, open_ = rows[some_rows], bound[np.ix_(some_rows, some_pages)], open_[np.ix_(some_rows, some_pages)]
        if not len(rows):
            return
        to_page = self.far(rows, tree.x[tree.routers[some_pages]])
        bound = np.where(open_, np.maximum(bound, to_page - tree.radii[some_pages]), np.inf)
        turn = np.argsort(np.argsort(bound, axis=1), axis=1)
        begin = 0
        for many in (*WAVES, len(some_pages)):
            due = (turn >= begin) & (turn < begin + many) & (bound <= self.reach[rows, None])
            for p in np.flatnonzero(due.any(0)).tolist():
                asked = np.flatnonzero(due[:, p])
                self._page(tree, int(some_pages[p]), rows[asked], to_page[asked, p])
            self.settle()
            begin += many
            if begin >= len(some_pages):
                break

    def _page(self, tree: Tree, page: int, rows: np.ndarray, to_page: np.ndarray) -> None:
        entries = np.arange(tree.starts[page], tree.starts[page + 1])
        near = np.abs(to_page[:, None] - tree.to_page[entries]) <= self.reach[rows, None]
        used = near.any(0)
        entries, near = entries[used], near[:, used]
        score = (self.q[rows] @ tree.x[entries].astype(self.kind).T).astype(np.int64)
        near &= score >= self.floor[rows, None]
        near &= tree.ids[entries] != self.ids[rows, None]
        i, j = np.nonzero(near)
        if len(i):
            self.found.append((rows[i], tree.ids[entries[j]], score[i, j]))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``x`` (floors of 256 times the components) of the rows that take part."""
    whole = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = whole.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0)).select("id", F.transform("v", lambda v: F.floor(256 * v).cast("double")).alias("x"))


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", tree_rows: int = TREE_ROWS, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, shelf_trees: int = SHELF_TREES) -> DataFrame:
    """The ``k`` rows of largest integer inner product for each row that ``is_query`` (of the key as ``id``) names: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = prepare(vectors.sparkSession)
    numbered = usable(vectors, key, vector).select("id", "x", F.monotonically_increasing_id().alias("row"), is_query.alias("asked"))
    rows = stored(numbered, "points")
    about = rows.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.max(F.array_max(F.transform("x", F.abs))), F.max(F.size("x"))).head()
    n, most, high, dims = about
    if not n or not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if most >= 2.0**62:
        raise ValueError("norms of 2^31 or more: inner products would not fit 64 bits")
    wide, kind = most >= 2.0**52, np.dtype(np.int16 if high < 1 << 15 else np.int32 if high < 1 << 31 else np.int64)
    # A bounded number of pivots, the same for any order of the rows.
    wanted = min(pivots, max(1, -(-n // tree_rows)))
    seeds = rows.select("id", "x").orderBy(F.xxhash64(F.lit(7), "id"), "id", "x").limit(wanted).toPandas()
    centres = lifted(np.stack(seeds["x"].to_numpy()), most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, dims)
            pivot = (lifted(x, most) @ centres.T).argmax(1)
            packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, batch.column("row"), batch.column("asked"), pa.array(pivot.astype(np.int32))], names=["id", "x", "row", "asked", "pivot"])

    placed = stored(rows.mapInArrow(place, "id long, x binary, row long, asked boolean, pivot int"), "placed")
    sizes = dict(placed.groupBy("pivot").count().collect())  # a row a pivot
    parts = np.ones(wanted, np.int64)
    for pivot, count in sizes.items():
        parts[pivot] = -(-count // tree_rows)
    shares, before = (F.array(*map(F.lit, v.tolist())) if len(v) <= 64 else F.from_json(F.lit(str(v.tolist())), "array<long>") for v in (parts, np.cumsum(parts) - parts))
    tree = F.get(before, F.col("pivot")) + F.pmod(F.xxhash64("row"), F.get(shares, F.col("pivot")))
    n_trees = int(parts.sum())

    def load(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), kind).reshape(-1, dims)
        ids = group.column("id").to_numpy()
        made = load_tree(ids, x, most)
        asked = np.flatnonzero(group.column("asked").to_numpy())
        best = Nearest(x[asked], ids[asked], k, most, np.full(len(asked), -(1 << 62)), wide)
        best.visit(made, np.arange(len(asked)))
        at, found, score = best.kept
        upto = np.searchsorted(at, np.arange(len(asked) + 1)).astype(np.int32)
        list_of = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        firsts = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(found), pa.array(score)], names=["vec_id", "score"]))
        queries = pa.StructArray.from_arrays([pa.array(ids[asked]), pa.array([r.tobytes() for r in x[asked]], pa.binary()), pa.array(best.floor), firsts], names=["id", "x", "floor", "best"])
        return pa.table([group.column("tree").slice(0, 1), *(pa.array([p], pa.binary()) for p in made.pack()), list_of(queries)], names=["tree", *_FIELDS, "queries"])

    query_type = "array<struct<id: bigint, x: binary, floor: bigint, best: array<struct<vec_id: bigint, score: bigint>>>>"
    loaded = placed.select("id", "x", "asked", tree.alias("tree")).groupBy("tree").applyInArrow(load, f"tree long, {', '.join(f'{f} binary' for f in _FIELDS)}, queries {query_type}")
    loaded = stored(loaded, "trees")
    each = loaded.select("tree", F.inline("queries"))
    queries = stored(each.groupBy("id").agg(F.min(F.struct("x", "tree", "floor", "best")).alias("q")).select("id", "q.*"), "queries")
    blocks = max(1, -(-queries.count() // query_block))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            raw, floor = b"".join(table.column("x").to_pylist()), table.column("floor").to_numpy()
            q = np.frombuffer(raw, kind).reshape(-1, dims).astype(float)
            centre = q.mean(0)
            reach = np.sqrt(np.maximum((q * q).sum(1) + most - 2 * floor.astype(float), 0))
            numbers = [table.column("id").to_numpy().tobytes(), raw, floor.tobytes(), table.column("tree").to_numpy().tobytes()]
            about = np.append(centre, [np.sqrt(((q - centre) ** 2).sum(1)).max(), reach.max()])
            return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in (*numbers, about.tobytes())], names=["q_ids", "q_x", "floor", "home", "about"])

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, query_block):
                part = batch.slice(lo, query_block)
                if size + part.num_rows > query_block:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield out()

    near = queries.select("id", "x", "floor", "tree").repartitionByRange(blocks, "tree").sortWithinPartitions("tree")
    packed = near.mapInArrow(block, "q_ids binary, q_x binary, floor binary, home binary, about binary")
    packed = stored(packed.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    # A row for each block of queries: one for 50 * QUERY_BLOCK vectors or more.
    balls = [(r["block"], np.frombuffer(r["about"])) for r in packed.select("block", "about").collect()]
    shelves = max(-(-n_trees // shelf_trees), min(n_trees, 64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                top = np.frombuffer(batch.column("top")[i].as_py())
                point = lifted(np.frombuffer(batch.column("x")[i].as_py(), kind).reshape(-1, dims)[[int(top[0])]], most)[0]
                met = [b for b, ball in balls if np.sqrt(((point[:-1] - ball[:-2]) ** 2).sum() + point[-1] ** 2) - top[1] - ball[-2] <= ball[-1] * (1 + 1e-9) + 1e-6]
                if met:
                    again = pa.array(np.full(len(met), i))
                    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), *(batch.column(c).take(again) for c in ("tree", *_FIELDS))], names=["block", "tree", *_FIELDS])

    dealt = loaded.drop("queries").mapInArrow(deal, f"block long, tree long, {', '.join(f'{f} binary' for f in _FIELDS)}").withColumn("shelf", F.pmod(F.xxhash64("tree"), F.lit(shelves)))
    asked = packed.drop("about").withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long"))))

    def search(trees: pa.Table, block_: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not trees.num_rows or not block_.num_rows:
            return empty
        row = block_.to_pylist()[0]
        ids, floor, home = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "floor", "home"))
        best = Nearest(np.frombuffer(row["q_x"], kind).reshape(-1, dims), ids, k, most, floor, wide)
        for i in range(trees.num_rows):
            made = Tree.unpack([trees.column(f)[i].as_py() for f in _FIELDS], dims, kind)
            best.visit(made, np.flatnonzero(home != trees.column("tree")[i].as_py()))
        at, found, score = best.kept
        return pa.table([pa.array(ids[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = dealt.groupBy("block", "shelf").cogroup(asked.groupBy("block", "shelf")).applyInArrow(search, "query_id long, vec_id long, score long")
    own = queries.select(F.col("id").alias("query_id"), F.inline("best"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark, sf_dir: str, k: int = 5) -> DataFrame:
    """The 5 largest integer inner products of all ``embeddings`` for those whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, k)


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM usable q JOIN usable v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
