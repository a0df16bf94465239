"""Packing of tokenised documents into fixed-length sequences, shortest pack first.

A document longer than ``length`` tokens is cut into full sequences and a rest;
rests above ``piece`` tokens are cut again, as short pieces leave less padding.
The histogram of piece lengths is packed longest length first: each goes into
the open packs with the most room (the shortest packs) as long as it fits, and
opens new packs otherwise; packs of one pattern are counted, never listed.
Pieces then find their sequence by their rank among the pieces of their length.

Each piece carries its token ids: those of a sequence's pieces in order of
``offset`` are the sequence.

Nulls, ties, edges: a null text is empty; an empty one holds the end token
alone. Pieces of equal length are ranked by document, start and ids, and
what still ties is the same piece. Repeated rows are packed each on its own.
An empty table gives no rows. Only the key and the text are read.
"""

from __future__ import annotations

import functools
import heapq
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import SMALL_BATCHES, prepare, span_hashes, stored, utf8

SALTS = 256
_SIMPLE = "".join(map(chr, range(256)))
# What a character below U+0100 is to the tokenizer: 0 white space, 1 letter, 2 number, 3 other.
_KIND = np.array([0 if c in "\t\n\x0b\x0c\r \x85\xa0" else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3) for c in _SIMPLE], np.uint8)


class WordTokenizer:
    """Ids of a word-level BPE tokenizer for many texts at once.

    Texts of characters below U+0100 without apostrophes are split by array
    operations, and each distinct word is encoded once; the tokenizer itself
    encodes all other texts. Words, told apart by 64-bit hashes, keep their ids
    for later texts.
    """

    def __init__(self, path: str, cache: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        self.keys, self.base, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, new: list[str]) -> None:
        """Encode ``new`` words as texts of many words; an id that ends a word tells them apart again."""
        texts = [" ".join(new[at : at + 1024]) for at in range(0, len(new), 1024)]
        ids = np.concatenate([np.array(code.ids, np.uint32) for code in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        starts = np.concatenate(([0], ends[:-1]))
        keys, base, size = np.concatenate((self.keys, keys)), np.concatenate((self.base, starts + len(self.pool))), np.concatenate((self.size, ends - starts))
        order = np.argsort(keys, kind="stable")
        self.keys, self.base, self.size, self.pool = keys[order], base[order], size[order], np.concatenate((self.pool, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        simple, raw = [], []
        for i, text in enumerate(texts):
            if "'" not in text:
                try:
                    code = text.lower().encode("latin-1")
                except UnicodeEncodeError:
                    code = None
                if code is not None and (text.isascii() or unicodedata.is_normalized("NFC", text)):
                    simple.append(i)
                    raw.append(code)
                    continue
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        for i, ids in zip(simple, self._encode_simple(raw), strict=True):
            out[i] = ids
        return out

    def _encode_simple(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\n".join(texts)
        chars = np.frombuffer(joined, np.uint8)
        kind = _KIND[chars]
        start = np.ones(len(kind), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(kind))
        inked = kind[starts] != 0
        starts, ends = starts[inked], ends[inked]
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        keys, first, which = np.unique(span_hashes(chars, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            latin = joined.decode("latin-1")
            self._learn(keys[new], [latin[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        place = at[which]
        n = self.size[place]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.repeat(self.base[place] - upto[:-1], n) + np.arange(upto[-1])]
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        edge = upto[np.searchsorted(starts, begins)]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


@functools.lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return WordTokenizer(path)


def cut_lengths(total: int, length: int, piece: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens."""
    full, rest = divmod(total, length)
    cuts = [length] * full
    while rest > piece:
        cuts.append(piece)
        rest -= piece
    return cuts + [rest] * (rest > 0)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", length: int = 2048, piece: int = 512, end_id: int = 1) -> DataFrame:
    """A row for each piece: key, ``start``, ``length``, ``ids`` as little-endian 32-bit integers, ``doc_tokens``."""
    prepare(docs.sparkSession, *SMALL_BATCHES)
    key_type = docs.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            at, start, size, held, total = [], [], [], [], []
            for i, ids in enumerate(tokenizer.encode(texts)):
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                n = len(raw) // 4
                here = 0
                for m in cut_lengths(n, length, piece):
                    at.append(i)
                    start.append(here)
                    size.append(m)
                    held.append(raw[4 * here : 4 * (here + m)])
                    total.append(n)
                    here += m
            start, size, total = (pa.array(x, pa.int64()) for x in (start, size, total))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), start, size, pa.array(held, pa.binary()), total], names=[key, "start", "length", "ids", "doc_tokens"])

    return docs.select(key, text).mapInArrow(cut, f"{key} {key_type.simpleString()}, start long, length long, ids binary, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) with their counts, for ``histogram`` of lengths.

    Longest length first, each into the packs with the most room; a group of
    equal packs is split where the pieces of a length run out.
    """
    rooms: list[int] = []
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if not packs[room]:
            heapq.heappush(rooms, -room)
        packs[room].append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left > 0:
            while rooms and not packs[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < size:
                # Nothing has room: open packs for all that is left, as many as hold it side by side.
                opened = -(-left // max(1, length // size))
                put(length - size, (size,), opened)
                left -= opened
                continue
            pattern, count = packs[room].pop()
            used = min(count, left)
            if used < count:
                packs[room].append((pattern, count - used))
            put(room - size, (*pattern, size), used)
            left -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in packs.values():
        for pattern, count in groups:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the pieces of each length go: ranks from ``first`` on, as many as ``count``, to the sequences from ``sequence`` on, at ``offset``."""
    rows, sequence, used = [], 0, defaultdict(int)
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, used[size], count, sequence, offset))
            used[size] += count
            offset += size
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "count", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, key: str = "doc_id", length: int = 2048) -> DataFrame:
    """``pieces`` (as ``tokenized_pieces`` gives them, stored) with ``sequence_id`` and ``offset``.

    Ranks among the pieces of one length are counted in ``SALTS`` parts, since a
    length may hold a third of all pieces. The histogram has at most ``length``
    rows, the part counts at most ``SALTS * length``; both fit any driver.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(key, "start"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "__salt").count().toPandas().sort_values(["length", "__salt"], ignore_index=True)
    histogram = {int(k): int(v) for k, v in counts.groupby("length")["count"].sum().items()}
    before = np.zeros((length + 1, SALTS), np.int64)
    before[counts["length"], counts["__salt"]] = counts["count"]
    before = np.cumsum(before, axis=1) - before
    slots = slots_of(shortest_pack_first(histogram, length))
    # One sorted key for look-ups: length and first rank.
    wide = np.int64(1) << np.int64(40)
    table = spark.sparkContext.broadcast((before, slots["length"].to_numpy() * wide + slots["first"].to_numpy(), slots[["first", "sequence", "offset"]].to_numpy()))
    # Rows in order are counted as they pass: a window would hold those of a part, beside what sorting takes.
    ranked = salted.repartition("length", "__salt").sortWithinPartitions("length", "__salt", key, "start", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, keys, to = table.value
        part, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size, salt = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "__salt"))
            parts = size * SALTS + salt
            first = np.flatnonzero(np.diff(parts, prepend=-1))
            rank = np.arange(len(parts)) - np.repeat(first, np.diff(first, append=len(parts)))
            if parts[0] == part:
                rank[: first[1] if len(first) > 1 else None] += seen
            part, seen = parts[-1], rank[-1] + 1
            rank = rank + ahead[size, salt]
            at = to[np.searchsorted(keys, size * wide + rank, "right") - 1].reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at[:, 1] + rank - at[:, 0]), pa.array(at[:, 2])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{key} {pieces.schema[key].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", length: int = 2048, piece: int = 512, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row for each piece, with its ids."""
    return pack(stored(tokenized_pieces(docs, tokenizer_path, text, key, length, piece, end_id), "pieces"), key, length)


def op9_packing(spark, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens; ids by their checksum."""
    import public_tokenizers

    made = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(tokenizer))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
