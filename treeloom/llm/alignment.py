"""Alignment of two tokenizers' tokens by merge paths.

A byte-level BPE (A) and a piece BPE with byte fallback (B) cut the same bytes,
a space and the text. The ends of their tokens are two sorted lists; a token's
end in one list falls into exactly one token of the other, so that each step of
merging the lists is a link of two overlapping tokens, but for the second of two
equal ends, which closes a group. The merged list of many texts is cut into
pieces of equal work, wherever texts begin and end: a binary search on each
diagonal finds how many ends of either list come before it. A piece knows the
gap between the last ends before it and the next token of each list, and is
merged without the others. A text within one piece is done there; the open
groups at the edges of a text's pieces are stitched in order.

Links of an id pair are counted over the whole corpus: distinct pairs of a piece
first, then a shuffle by pair. The ``FREQUENT`` commonest pairs and their counts
go to all tasks (about 2 MB, whatever the corpus); the links of all other pairs
are counted by text and meet the counts in a join.

Texts are cut where both tokenizers provably cut (before a space or line feed
between other characters, and after such a line feed); each distinct stretch is
encoded once for a worker.

Nulls, ties, edges: texts that are null, empty, or whose tokens don't give back
their bytes (as with U+2581) have no tokens and only zeros. Strings of special
tokens are plain text. A B id's highest count may belong to several pairs: all
are best. Rows with a null or repeated key are separate texts. An empty table
gives no rows. Only the key and the text are read. A text of any length is
encoded as one, as its row is; its tokens may then lie in many pieces.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import prepare, span_hashes, stored, utf8

PIECE = 1 << 19  # merge steps of a piece, at most
FREQUENT = 1 << 17
BATCH_BYTES = 1 << 20
CACHE = 1 << 19

_WS = np.zeros(256, bool)
_WS[[*range(9, 14), *range(28, 33)]] = True


def _byte_level() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable Latin-1 ones stand for themselves, the others for U+0100 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any kind."""
    ws = _WS[data]
    high = np.flatnonzero(data >= 0xC2)
    high = high[(data[high] == 0xC2) | (data[high] == 0xE1) | (data[high] == 0xE2) | (data[high] == 0xE3)]
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    one, two, three = padded[high], padded[high + 1], padded[high + 2]
    short = high[(one == 0xC2) & ((two == 0x85) | (two == 0xA0))]
    wide = (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F)) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
    ws[short] = ws[short + 1] = True
    for step in range(3):
        ws[high[wide] + step] = True
    return ws


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of texts (each with its leading space) that both tokenizers encode on their own."""
    n = len(data)
    ws = _spaces(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~ws[:-2] & ~ws[2:]
    inner &= ~edge[:-1] & ~edge[1:]
    start = edge.copy()
    start[:-1] |= inner
    start[1:] |= inner & (data == 10)
    at = np.flatnonzero(start)
    return at[:-1], at[1:]


class PairTokenizer:
    """Ids of both tokenizers for many texts at once; stretches, told apart by 64-bit hashes, keep their ids for later texts."""

    def __init__(self, a_path: str, b_path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = _byte_level()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if token in special else bytes(code[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("\n" in p or "▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError("a piece reaches across a space or line feed, so that stretches are not encoded on their own")
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        self.keys, self.sound = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.base, self.size = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.pool = [np.zeros(0, np.uint16)] * 2

    def _ids(self, raw: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both tokenizers of stretches, and which give back their bytes."""
        texts = [x.decode("utf-8", "replace") for x in raw]
        a = [code.ids for code in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a space before a text; a stretch that has none is encoded behind a line feed, which no piece spans.
        b = self.b.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        b = [ids if t[0] == " " else ids[2:] for t, ids in zip(texts, b, strict=True)]
        sound = [b"".join(map(self.a_bytes.__getitem__, x)) == r and b"".join(map(self.b_bytes.__getitem__, y)) == r for x, y, r in zip(a, b, raw, strict=True)]
        return a, b, np.array(sound, bool)

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        *both, sound = self._ids(raw)
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys, self.sound = keys[order], np.concatenate((self.sound, sound))[order]
        for side, ids in enumerate(both):
            size = np.array([len(x) for x in ids], np.int64)
            base = len(self.pool[side]) + np.cumsum(size) - size
            self.base[side], self.size[side] = np.concatenate((self.base[side], base))[order], np.concatenate((self.size[side], size))[order]
            self.pool[side] = np.concatenate((self.pool[side], np.fromiter((i for x in ids for i in x), np.uint16, int(size.sum()))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and B: the ids of all texts, and how many each text has. ``data`` holds each text with its leading space."""
        none = np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        if len(data) == 0:
            return none, none
        starts, ends = stretches(data, offsets)
        # Hashes are made for about a batch of bytes at a time, as one text may be long.
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), BATCH_BYTES)))
        hashes = [span_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in zip(cuts, [*cuts[1:], len(starts)], strict=True) if i < j]
        keys, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit or max(map(len, self.pool)) > 8 * self.limit:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            whole = data.tobytes()
            self._learn(keys[new], [whole[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        place = at[which]
        owner = np.searchsorted(offsets, starts, "right") - 1
        broken = np.bincount(owner, ~self.sound[place], len(offsets) - 1) > 0
        keep = ~broken[owner]
        place, owner = place[keep], owner[keep]
        out = []
        for base, size, pool in zip(self.base, self.size, self.pool, strict=True):
            n = size[place]
            upto = np.concatenate(([0], np.cumsum(n)))
            out.append((pool[np.repeat(base[place] - upto[:-1], n) + np.arange(upto[-1])], np.bincount(owner, n, len(offsets) - 1).astype(np.int64)))
        return tuple(out)


@functools.lru_cache(2)
def pair_tokenizer(a_path: str, b_path: str) -> PairTokenizer:
    """One pair of tokenizers for all tasks of a Python worker."""
    return PairTokenizer(a_path, b_path)


def diagonals(a_ends: np.ndarray, b_ends: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How many of ``a_ends`` are among the first ``steps`` of both lists merged (equal ends of A first), by a binary search on each diagonal."""
    low, high = np.maximum(0, steps - len(b_ends)), np.minimum(steps, len(a_ends))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        before = open_.copy()
        before[open_] = a_ends[mid[open_]] <= b_ends[steps[open_] - 1 - mid[open_]]
        low = np.where(before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    return low


def cut_pieces(a_ids: np.ndarray, b_ids: np.ndarray, a_len: np.ndarray, b_len: np.ndarray, piece: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of at most ``piece`` steps and equal work: the ranges of A and of B, and by how far A's last end before the piece lies behind B's."""
    a_ends, b_ends = np.cumsum(a_len[a_ids]), np.cumsum(b_len[b_ids])
    total = len(a_ids) + len(b_ids)
    steps = np.linspace(0, total, max(1, -(-total // piece)) + 1).astype(np.int64)
    at = diagonals(a_ends, b_ends, steps)
    for i0, i1, k0, k1 in zip(at[:-1].tolist(), at[1:].tolist(), steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        j0, j1 = k0 - i0, k1 - i1
        yield i0, i1, j0, j1, int((a_ends[i0 - 1] if i0 else 0) - (b_ends[j0 - 1] if j0 else 0))


class Merged:
    """A piece, merged. ``a`` and ``b`` may end with the next token behind the piece; texts own runs of ``n_as`` and ``n_bs`` tokens."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_as: np.ndarray, n_bs: np.ndarray, lead: int, a_len: np.ndarray, b_len: np.ndarray):
        n_a, n_b = int(n_as.sum()), int(n_bs.sum())
        a_ends, b_ends = np.cumsum(a_len[a]), np.cumsum(b_len[b]) - lead
        self.a, self.b, self.n_as, self.n_bs = a[:n_a], b[:n_b], n_as, n_bs
        in_b = np.searchsorted(b_ends, a_ends[:n_a])
        in_a = np.searchsorted(a_ends, b_ends[:n_b])
        # Equal ends: the A token is in this piece, or was the last before it.
        ends = np.concatenate((a_ends, [-1]))
        self.closes = (ends[in_a] == b_ends[:n_b]) | (b_ends[:n_b] == 0)
        linked = ~self.closes
        a_of, b_of = self.a, b[in_b] if n_a else b[:0]
        self.pairs = np.concatenate((a_of.astype(np.uint32) << np.uint32(16) | b_of, a[in_a[linked]].astype(np.uint32) << np.uint32(16) | self.b[linked]))
        self.a_upto, self.b_upto = np.concatenate(([0], np.cumsum(n_as))), np.concatenate(([0], np.cumsum(n_bs)))
        shut = np.concatenate(([0], np.cumsum(self.closes)))
        self.n_groups = shut[self.b_upto[1:]] - shut[self.b_upto[:-1]]
        self.n_links = n_as + n_bs - self.n_groups
        self.b_links = np.concatenate(([0], np.cumsum(linked)))[self.b_upto] + n_a
        stops = b_ends[:n_b][self.closes]
        self.a_group, self.b_group = np.searchsorted(stops, a_ends[:n_a]), np.searchsorted(stops, b_ends[:n_b])
        self.shut = shut

    def sums(self, of_links: np.ndarray) -> np.ndarray:
        """Sums over each text's links of a number a link."""
        upto = np.concatenate(([0], np.cumsum(of_links, dtype=np.int64)))
        return upto[self.a_upto[1:]] - upto[self.a_upto[:-1]] + upto[self.b_links[1:]] - upto[self.b_links[:-1]]

    def owners(self) -> np.ndarray:
        """The text of each link."""
        each = np.arange(len(self.n_as))
        return np.concatenate((np.repeat(each, self.n_as), np.repeat(each, np.diff(self.b_links))))

    def written(self) -> tuple[bytes, np.ndarray]:
        """All groups as text (``a1,a2|b1;a3|b2``), and where each text's part begins."""
        n_a, n_b = len(self.a), len(self.b)
        a_at = np.arange(n_a) + np.searchsorted(self.b_group, self.a_group)
        b_at = np.arange(n_b) + np.searchsorted(self.a_group, self.b_group, "right")
        ids, mark = np.zeros(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        if n_a:
            last = np.append(self.a_group[1:] != self.a_group[:-1], True)
            mark[a_at[last]] = ord("|")
        mark[b_at[self.closes]] = ord(";")
        size = 1 + (ids > 9) + (ids > 99) + (ids > 999) + (ids > 9999)
        upto = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.zeros(int(upto[-1]), np.uint8)
        out[upto[1:] - 1] = mark
        here, rest = upto[1:] - 2, ids
        for place in range(5):
            some = size > place
            out[(here - place)[some]] = 48 + rest[some] % 10
            rest = rest // 10
        return out.tobytes(), upto[self.a_upto + self.b_upto]

    def fragment(self, text: int) -> dict:
        """A text that other pieces hold too: ids up to the end of its first group, groups in between, ids of the open group."""
        a, b = (v[u[text] : u[text + 1]] for v, u in ((self.a, self.a_upto), (self.b, self.b_upto)))
        a_group, b_group = (v[u[text] : u[text + 1]] for v, u in ((self.a_group, self.a_upto), (self.b_group, self.b_upto)))
        first, last = int(self.shut[self.b_upto[text]]), int(self.shut[self.b_upto[text + 1]])
        ids = lambda v: ",".join(map(str, v.tolist()))
        inner, at = [], first + 1
        a_from, b_from = np.searchsorted(a_group, np.arange(at, last + 1)), np.searchsorted(b_group, np.arange(at, last + 1))
        for g in range(max(0, last - at)):
            inner.append(ids(a[a_from[g] : a_from[g + 1]]) + "|" + ids(b[b_from[g] : b_from[g + 1]]))
        head = (a[a_group <= first], b[b_group <= first])
        tail = (a[a_group >= last], b[b_group >= last]) if last > first else (a[:0], b[:0])
        return {"closed": last > first, "a1": ids(head[0]), "b1": ids(head[1]), "mid": ";".join(inner), "a2": ids(tail[0]), "b2": ids(tail[1])}


def stitched(fragments: Iterable[dict]) -> str:
    """The groups of a text from its fragments in order."""
    groups, a, b = [], [], []
    for f in fragments:
        a, b = [*a, f["a1"]], [*b, f["b1"]]
        if f["closed"]:
            groups.append("|".join(",".join(filter(None, ids)) for ids in (a, b)))
            if f["mid"]:
                groups.append(f["mid"])
            a, b = [f["a2"]], [f["b2"]]
    return ";".join(groups)


_PIECES = "piece long, lead long, a binary, b binary, uids array<long>, n_as array<int>, n_bs array<int>, wholes array<boolean>"


def tokenized(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, piece: int) -> DataFrame:
    """Pieces of the merged ends of all texts: ids of either side, and the texts they belong to (``uids``, ``keys``)."""
    key_type = docs.schema[key].dataType.simpleString()

    def flush(keys: list[pa.Array], batches: list[tuple], base: int, number: int, tokenizer: PairTokenizer) -> Iterator[pa.RecordBatch]:
        (a_ids, a_n), (b_ids, b_n) = ((np.concatenate([b[s][0] for b in batches]), np.concatenate([b[s][1] for b in batches])) for s in (0, 1))
        names = pa.concat_arrays(keys)
        a_upto, b_upto = np.concatenate(([0], np.cumsum(a_n))), np.concatenate(([0], np.cumsum(b_n)))
        begin, stop = a_upto[:-1] + b_upto[:-1], a_upto[1:] + b_upto[1:]
        done = 0
        for i0, i1, j0, j1, lead in cut_pieces(a_ids, b_ids, tokenizer.a_len, tokenizer.b_len, piece):
            # Texts without tokens go with the first piece that reaches them.
            high = np.searchsorted(begin, i1 + j1, "left") if i1 + j1 < len(a_ids) + len(b_ids) else len(begin)
            at = np.arange(min(done, high), high)
            n_as = np.minimum(a_upto[at + 1], i1) - np.maximum(a_upto[at], i0)
            n_bs = np.minimum(b_upto[at + 1], j1) - np.maximum(b_upto[at], j0)
            whole = (begin[at] >= i0 + j0) & (stop[at] <= i1 + j1)
            done = high - 1 if high and stop[high - 1] > i1 + j1 else high
            lists = [[base + at], [n_as.clip(0)], [n_bs.clip(0)], [whole]]
            arrays = [pa.array([number]), pa.array([lead]), pa.array([a_ids[i0 : i1 + 1].tobytes()], pa.binary()), pa.array([b_ids[j0 : j1 + 1].tobytes()], pa.binary())]
            arrays += [pa.array([v[0].tolist()], pa.list_(t)) for v, t in zip(lists, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)]
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), names.take(pa.array(at, pa.int64()))))
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "lead", "a", "b", "uids", "n_as", "n_bs", "wholes", "keys"])
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = pair_tokenizer(a_path, b_path)
        base = number = TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        encoded: list[tuple] = []
        steps = rows = 0
        for part_keys, data, offsets in gathered(batches):
            keys.append(part_keys)
            encoded.append(tokenizer.encode(data, offsets))
            steps, rows = steps + len(encoded[-1][0][0]) + len(encoded[-1][1][0]), rows + len(part_keys)
            if steps >= piece or rows >= piece:
                for made in flush(keys, encoded, base, number, tokenizer):
                    number += 1
                    yield made
                base, keys, encoded, steps, rows = base + rows, [], [], 0, 0
        if keys:
            yield from flush(keys, encoded, base, number, tokenizer)

    return docs.select(key, text).mapInArrow(run, f"{_PIECES}, keys array<{key_type}>")


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys and texts (bytes and offsets) of at most ``most`` bytes, or of one text, each filled text behind a space."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        keys, parts, sizes = zip(*held, strict=True)
        return pa.concat_arrays(keys), np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most - size, "right")) - 1)
            hi = min(hi, batch.num_rows)
            sizes = np.diff(offsets[lo : hi + 1])
            filled = sizes > 0
            spaced = np.full(int(offsets[hi] - offsets[lo] + filled.sum()), 32, np.uint8)
            spaced[np.arange(offsets[hi] - offsets[lo]) + np.repeat(np.cumsum(filled), sizes)] = data[offsets[lo] : offsets[hi]]
            held.append((batch.column(0).slice(lo, hi - lo), spaced, sizes + filled))
            size, lo = size + len(spaced), hi
            if size >= most or lo < batch.num_rows:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _merged(batch: pa.RecordBatch, i: int, tokenizer: PairTokenizer) -> Merged:
    row = {name: batch.column(name)[i] for name in ("lead", "a", "b", "n_as", "n_bs")}
    a, b = (np.frombuffer(row[s].as_buffer() or b"", np.uint16) for s in ("a", "b"))
    n_as, n_bs = (row[s].values.to_numpy(zero_copy_only=False).astype(np.int64) for s in ("n_as", "n_bs"))
    return Merged(a, b, n_as, n_bs, row["lead"].as_py(), tokenizer.a_len, tokenizer.b_len)


def pair_counts(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each linked id pair (A's id * 2^16 + B's): ``n`` links in all pieces, and whether that is its B id's highest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = pair_tokenizer(a_path, b_path)
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, n = np.unique(_merged(batch, i, tokenizer).pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    partial = pieces.select("lead", "a", "b", "n_as", "n_bs").mapInArrow(count, "pair long, n long")
    pairs = stored(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(0xFFFF)
    best = pairs.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    # One row a B id, and ids have 16 bits.
    return pairs.join(F.broadcast(best), b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", piece: int = PIECE, frequent: int = FREQUENT) -> DataFrame:
    """For each row of ``docs``: its key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    prepare(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()
    pieces = stored(tokenized(docs, a_path, b_path, key, text, piece), "token-pieces")
    counts = stored(pair_counts(pieces, a_path, b_path), "pair-counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")  # at most ``frequent`` rows
    known, known_n, known_best = top["pair"].to_numpy(np.uint32), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)
    rare_type = pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int64())]))
    fragment_type = pa.struct([("closed", pa.bool_()), *((k, pa.string()) for k in ("a1", "b1", "mid", "a2", "b2"))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = pair_tokenizer(a_path, b_path)
        for batch in batches:
            for i in range(batch.num_rows):
                merged = _merged(batch, i, tokenizer)
                wholes = batch.column("wholes")[i].values.to_numpy(zero_copy_only=False)
                uids, names = batch.column("uids")[i].values, batch.column("keys")[i].values
                at = np.searchsorted(known, merged.pairs).clip(0, max(0, len(known) - 1))
                hit = known[at] == merged.pairs if len(known) else np.zeros(len(merged.pairs), bool)
                n = np.where(hit, known_n[at], 0) if len(known) else np.zeros(len(merged.pairs), np.int64)
                best = np.where(hit, known_best[at], 0) if len(known) else np.zeros(len(merged.pairs), np.int64)
                # Links of other pairs, by text.
                left = np.flatnonzero(~hit)
                coded, m = np.unique(merged.owners()[left].astype(np.uint64) << np.uint64(32) | merged.pairs[left], return_counts=True)
                upto = np.searchsorted((coded >> np.uint64(32)).astype(np.int64), np.arange(len(wholes) + 1))
                items = pa.StructArray.from_arrays([pa.array((coded & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(m.astype(np.int64))], names=["pair", "m"])
                rare = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), items)
                whole_text, starts = merged.written()
                shown, fragments = [], []
                for d, (done, tokens) in enumerate(zip(wholes.tolist(), (merged.n_as + merged.n_bs).tolist(), strict=True)):
                    fragments.append(None if done else merged.fragment(d))
                    shown.append(None if not done else "" if not tokens else hashlib.sha256(whole_text[starts[d] : starts[d + 1] - 1]).hexdigest())
                numbers = [merged.n_as, merged.n_bs, merged.n_groups, merged.n_links, merged.sums(best), merged.sums(n)]
                arrays = [uids, names, pa.array(np.full(len(wholes), batch.column("piece")[i].as_py())), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(shown, pa.string()), pa.array(fragments, fragment_type), rare.cast(rare_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", key, "piece", *_NUMBERS, "groups_sha256", "fragment", "rare"])

    schema = f"uid long, `{key}` {key_type}, piece long, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string, fragment struct<closed: boolean, a1: string, b1: string, mid: string, a2: string, b2: string>, rare array<struct<pair: bigint, m: bigint>>"
    rows = stored(pieces.mapInArrow(score, schema), "aligned")

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        digest = hashlib.sha256(stitched(group["fragment"]).encode()).hexdigest()
        return pd.DataFrame({"uid": group["uid"].iloc[:1], key: group[key].iloc[:1], **{c: [group[c].sum()] for c in _NUMBERS}, "groups_sha256": [digest]})

    own = ["uid", key, *_NUMBERS, "groups_sha256"]
    # Texts over several pieces: a few fragments each, that together are one text's ids.
    several = rows.where("fragment IS NOT NULL").groupBy("uid").applyInPandas(stitch, schema.split(", groups_sha256")[0].replace(" piece long,", "") + ", groups_sha256 string")
    texts = rows.where("fragment IS NULL").select(*own).unionByName(several.select(*own))
    rest = rows.select("uid", F.inline("rare")).join(counts, "pair").groupBy("uid").agg(F.sum(F.col("m") * F.col("n")).alias("__sum"), F.sum(F.col("m") * F.col("best").cast("long")).alias("__best"))
    full = texts.join(rest, "uid", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("__best", F.lit(0))})
    return full.select(key, *_NUMBERS, "groups_sha256")


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and a piece tokenizer aligned in all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
