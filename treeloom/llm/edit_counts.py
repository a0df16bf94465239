"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens: leaves are blocks of
pre-tokens with their lengths in characters and tokens, inner nodes hold the
sums of their subtrees. An edit finds its place by descending the tree. It
scans again from one pre-token before the one it touches (a match may look one
pre-token ahead) until a boundary of the new text falls on one of the old, from
where on both split alike; only what lies between is encoded again, and the
sums above the touched blocks are updated.

Trees are kept: ``build_trees`` gives each document its tree as a binary column,
to be stored beside the text; ``apply_edits`` takes texts and trees, and returns
them as they are after the edits, so that a later run starts from there and
encodes no more than what its own edits touch.

Nulls, ties, edges: a null text is an empty one; null edits, and null fields of
an edit, are no edit, position 0, length 0 or no text. Positions and lengths are
cut to the text as it is when the edit is made; edits apply in array order. A
null tree, or one of another number of characters than its text has, is built
anew, which counts as encoded.
Repeated rows are counted one by one. An empty table gives no rows. Columns
named as an output are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import prepare

BLOCK = 64


class Counter:
    """Pre-tokens of a text and the tokens of each, by byte-level BPE; frequent pre-tokens are remembered."""

    def __init__(self, ranks_path: str, pattern: str, cache: int = 500_000):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("treeloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.limit = cache

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        found = list(map(known.get, pieces))
        for i, n in enumerate(found):
            if n is None:
                if len(known) >= self.limit:
                    known.clear()
                found[i] = known[pieces[i]] = len(self.encoding.encode_ordinary(pieces[i]))
        return found


@functools.lru_cache(2)
def counter(ranks_path: str, pattern: str) -> Counter:
    """One counter for all tasks of a Python worker."""
    return Counter(ranks_path, pattern)


def _mark(text: str) -> list[int]:
    """64 bits that tell a text from others, as two numbers."""
    return np.frombuffer(hashlib.blake2b(text.encode(), digest_size=8).digest(), np.uint32).tolist()


class TokenTree:
    """A segment tree over blocks of pre-tokens."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.text, self.encoded = counter, text, 0
        pieces = counter.pattern.findall(text)
        self._build(list(map(len, pieces)), counter.counts(pieces))

    @classmethod
    def kept(cls, text: str, packed: bytes | None, counter: Counter) -> TokenTree:
        """The tree of ``text`` as ``packed`` holds it; built anew where it doesn't."""
        if packed:
            numbers = np.frombuffer(zstandard.decompress(packed), np.uint32).tolist()
            mark, n, numbers = numbers[:2], numbers[2], numbers[3:]
            ends = [0, *itertools.accumulate(numbers[:n])]
            chars, tokens = numbers[n : n + ends[-1]], numbers[n + ends[-1] :]
            if mark == _mark(text):
                tree = cls.__new__(cls)
                tree.counter, tree.text, tree.encoded = counter, text, 0
                tree._sum([(chars[a:b], tokens[a:b]) for a, b in itertools.pairwise(ends)])
                return tree
        tree = cls(text, counter)
        tree.encoded = len(text)
        return tree

    def pack(self) -> bytes:
        """A mark of the text, the numbers of blocks and of their pre-tokens, then characters and tokens of all these."""
        parts = [_mark(self.text), [len(self.blocks)], [len(c) for c, _ in self.blocks], *(c for c, _ in self.blocks), *(t for _, t in self.blocks)]
        return zstandard.compress(np.array(list(itertools.chain(*parts)), np.uint32).tobytes(), 1)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self._sum([(chars[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(chars), BLOCK)] or [([], [])])

    def _sum(self, blocks: list[tuple[list[int], list[int]]]) -> None:
        self.blocks = blocks
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (c, t) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(c), sum(t)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _set(self, block: int) -> None:
        i = self.width + block
        self.chars[i], self.tokens[i] = map(sum, self.blocks[block])
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """Block and place of the pre-token that holds the character at ``place``, and where it starts."""
        i, at = 1, 0
        while i < self.width:
            i *= 2
            if place - at >= self.chars[i]:
                at += self.chars[i]
                i += 1
        block = i - self.width
        for k, n in enumerate(self.blocks[block][0]):
            if place - at < n:
                return block, k, at
            at += n
        return block, len(self.blocks[block][0]), at

    def _back(self, block: int, k: int, at: int) -> tuple[int, int, int]:
        """One pre-token back, if there is one."""
        while k == 0:
            if block == 0:
                return 0, 0, 0
            block -= 1
            k = len(self.blocks[block][0])
        return block, k - 1, at - self.blocks[block][0][k - 1]

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` on by ``insert``."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        shift = len(insert) - (stop - start)
        self.text = self.text[:start] + insert + self.text[stop:]
        if not self.chars[1]:
            pieces = self.counter.pattern.findall(self.text)
            self.encoded += len(self.text)
            self._build(list(map(len, pieces)), self.counter.counts(pieces))
            return
        first, head, at = self._back(*self._find(max(start - 1, 0)))
        last, tail, old = first, head, at
        pieces, new = [], at
        while True:
            settled = new >= start + len(insert) and old == new - shift
            if settled:
                break
            if new < len(self.text):
                piece = self.counter.pattern.match(self.text, new).group()
                pieces.append(piece)
                new += len(piece)
            while old < new - shift or old < stop and new >= len(self.text):
                while tail == len(self.blocks[last][0]):
                    last, tail = last + 1, 0
                old += self.blocks[last][0][tail]
                tail += 1
        self.encoded += new - at
        tokens = self.counter.counts(pieces)
        (c, t), (d, u) = self.blocks[first], self.blocks[last]
        self.blocks[first] = (c[:head] + list(map(len, pieces)) + d[tail:], t[:head] + tokens + u[tail:])
        for i in range(first + 1, last + 1):
            self.blocks[i] = ([], [])
        if len(self.blocks[first][0]) > 4 * BLOCK:
            self._build([n for b in self.blocks for n in b[0]], [n for b in self.blocks for n in b[1]])
            return
        for i in range(first, last + 1):
            self._set(i)


OUT = ("n_edits", "tokens_before", "tokens_after", "chars_after", "encoded_again")


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "tree") -> DataFrame:
    """``docs`` with the segment tree of each text as ``to``."""
    prepare(docs.sparkSession)
    rest = docs.drop(to)
    schema = T.StructType([*rest.schema.fields, T.StructField(to, T.BinaryType())])
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(ranks_path, pattern)
        for batch in batches:
            trees = [TokenTree(value or "", tool).pack() for value in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.binary())], names=schema.names)

    return rest.mapInArrow(run, schema)


def apply_edits(docs: DataFrame, edits: Column, ranks_path: str, pattern: str, text: str = "text", tree: str = "tree") -> DataFrame:
    """``docs`` with ``text`` and ``tree`` as they are after the edits, ``tokens_before`` and ``tokens_after``, and ``encoded_again``, the characters that were encoded.

    ``edits`` is an array of structs of ``start``, ``length``, ``insert``.
    """
    prepare(docs.sparkSession)
    rest = docs.drop(text, tree, *OUT)
    schema = T.StructType([*rest.schema.fields, T.StructField(text, T.StringType()), T.StructField(tree, T.BinaryType()), *(T.StructField(x, T.LongType()) for x in OUT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(ranks_path, pattern)
        for batch in batches:
            rows, texts, trees = [], [], []
            for value, packed, changes in zip(*(batch.column(batch.num_columns - i).to_pylist() for i in (3, 2, 1)), strict=True):
                held = TokenTree.kept(value or "", packed, tool)
                before = held.total
                made = [x for x in changes or [] if x is not None]
                for x in made:
                    held.edit(x["start"] or 0, x["length"] or 0, x["insert"] or "")
                rows.append((len(made), before, held.total, len(held.text), held.encoded))
                texts.append(held.text)
                trees.append(held.pack() if held.encoded or made else packed)
            counts = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(OUT)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(texts, pa.string()), pa.array(trees, pa.binary()), *counts], names=schema.names)

    return docs.select(*rest.columns, F.col(text).alias("__text"), F.col(tree).alias("__tree"), edits.alias("__edits")).mapInArrow(run, schema)


def derived_edits(key: Column, text: Column, source: Column) -> Column:
    """Three edits of a document, drawn from its key: its source's name inserted, twelve characters deleted, five replaced."""
    at = lambda seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.coalesce(F.length(text), F.lit(0)) + 1).cast("long")
    edit = lambda start, length, insert: F.struct(start.alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    return F.array(edit(at(1), 0, F.concat(F.lit(" "), F.coalesce(source, F.lit("none")))), edit(at(2), 12, F.lit("")), edit(at(3), 5, F.lit("it's 2024,  ok")))


def op8_edit_counts(spark, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Token counts of all ``documents`` before and after three edits each."""
    import public_tokenizers

    tools = public_tokenizers.path(ranks), public_tokenizers.PATTERN
    trees = build_trees(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), *tools)
    return apply_edits(trees, derived_edits(F.col("doc_id"), F.col("text"), F.col("source")), *tools).select("doc_id", *OUT)
