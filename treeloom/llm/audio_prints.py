"""Chroma fingerprints of audio, and their alignment.

A recording (signed 16-bit mono samples) is cut into overlapping frames; the
spectrum of each is folded into the 12 pitch classes, smoothed over five frames
and scaled to unit length. Sixteen filters compare sums over rectangles of the
frames-by-pitch image, each sum taken from the image's integral in four
look-ups; every filter gives two bits in Gray code, so that a position gives a
32-bit integer.

Two recordings align where ``LEAST_VOTES`` equal integers have one offset. Every
such offset of the histogram has its turn, not only the one of most, and the share
of differing bits decides: over the whole overlap there, or else over the segment
of at least ``PASSAGE`` prints that agrees best. Of the offsets that pass, the one
of most evidence is the match. What agrees must be more than chance gives: its
evidence, in nats,
is n (1 - 2e)^2 / 2 (the bound of Hoeffding) for a share e of differing bits and
n bits, where only prints not met before in the segment count, with the bits that
they change (a held tone tells no more than one print does). It must reach
ln(N / ``CHANCE``), N the number of prints of all recordings: so less than
``CHANCE`` matches by chance are to be expected for a query, whatever the size
of the tables. Recordings with equal prints are one class, searched once; they
match without that.

Nulls, ties, edges: audio that is null or empty takes no part. One too short for
a print is repeated until it has one; where the shorter of two recordings has
fewer prints than votes or overlap are asked for, all of its prints are asked for.
Offsets of equal evidence are ordered by their absolute value, then the smaller.
A query matches its own class only where that has other members. Repeated rows are members of one class.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import prepare, span_hashes, stored, utf8, words

RATE, FRAME, HOP = 2756, 1024, 341
LOWEST, HIGHEST = 60, 1300  # hertz
FRAMES = 32  # whose spectra are made at a time: they fit in a cache
PITCHES, WINDOW = 12, 16
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SHORTEST = FRAME + (WINDOW + len(SMOOTH) - 2) * HOP  # samples of one print
# Kind of comparison, first pitch, pitches, frames of each filter.
FILTERS = [(i % 5, (5 * i) % (PITCHES - 5), 3 + i % 3 if i % 5 != 1 else 4, WINDOW if i % 2 else 8) for i in range(16)]
STEPS = np.array([-0.25, 0.0, 0.25])
GRAY = np.array([0, 1, 3, 2], np.uint32)
LEAST_VOTES, LEAST_OVERLAP, MOST_ERRORS = 2, 8, 0.3
PASSAGE = 2 * WINDOW
CHANCE = 0.1
OWN_BITS = 16  # what a single print tells: its bits come in pairs
BLOCK = 1 << 21  # prints of a block
CELLS = 1 << 20  # pairs of prints that are compared at a time
MANY = 100  # times the prints of two recordings that may be compared one by one


def _pitch_matrix(rate: int = RATE, frame: int = FRAME) -> tuple[slice, np.ndarray]:
    """The bins of the spectrum that are heard, and which pitch class the real and the imaginary part of each adds to."""
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    heard = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
    fold = np.zeros((len(heard), PITCHES), np.float32)
    fold[np.arange(len(heard)), np.round(12 * np.log2(hertz[heard] / 440) + 69).astype(int) % PITCHES] = 1
    return slice(heard[0], heard[-1] + 1), np.repeat(fold, 2, axis=0)


_HEARD, _FOLD = _pitch_matrix()
_TAPER = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Smoothed unit pitch-class vectors of a recording's frames; silence is all zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    image = np.empty((n, PITCHES))
    for lo in range(0, n, FRAMES):
        spectrum = np.fft.rfft(frames[lo : lo + FRAMES] * _TAPER, axis=1)[:, _HEARD]
        image[lo : lo + FRAMES] = np.square(spectrum.view(spectrum.real.dtype)) @ _FOLD
    smooth = sum(w * image[i : len(image) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(size > 1e3, smooth / np.maximum(size, 1e-9), 0.0)


def prints(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each window of ``WINDOW`` frames."""
    n = len(image) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    whole = np.zeros((PITCHES + 1, len(image) + 1))
    whole[1:, 1:] = image.T.cumsum(0).cumsum(1)

    def area(first: int, frames: int, pitch: int, pitches: int) -> np.ndarray:
        tall = whole[pitch + pitches] - whole[pitch]
        return tall[first + frames : first + frames + n] - tall[first : first + n]

    ratios = np.empty((len(FILTERS), 2, n))
    for i, (kind, y, h, w) in enumerate(FILTERS):
        if kind == 0:  # against the rest of the frames
            a, b = area(0, w, y, h), area(0, w, 0, PITCHES) - area(0, w, y, h)
            b = b * h / (PITCHES - h)
        elif kind == 1:  # low against high pitches
            a, b = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
        elif kind == 2:  # early against late
            a, b = area(0, w // 2, y, h), area(w // 2, w // 2, y, h)
        elif kind == 3:  # opposite quarters
            a = area(0, w // 2, y, h // 2) + area(w // 2, w // 2, y + h // 2, h // 2)
            b = area(0, w // 2, y + h // 2, h // 2) + area(w // 2, w // 2, y, h // 2)
        else:  # middle half against both ends in time
            a, b = area(w // 4, w // 2, y, h), area(0, w // 4, y, h) + area(3 * w // 4, w // 4, y, h)
        ratios[i] = a, b
    logs = np.log1p(ratios)
    change = logs[:, 0] - logs[:, 1]
    bits = GRAY[sum((change > step).view(np.uint8) for step in STEPS)]
    return np.bitwise_or.reduce(bits << np.arange(2 * len(FILTERS) - 2, -1, -2, dtype=np.uint32)[:, None], axis=0)


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """``samples`` of ``rate`` at ``RATE``: means over the spans of the new ones, or between the old ones where these are fewer."""
    if rate == RATE or not len(samples):
        return samples
    n = max(1, len(samples) * RATE // rate)
    if rate < RATE:
        return np.interp(np.arange(n) * (rate / RATE), np.arange(len(samples)), samples)
    sums = np.concatenate(([0.0], np.cumsum(samples, dtype=float)))
    return np.diff(np.interp(np.arange(n + 1) * (rate / RATE), np.arange(len(sums)), sums)) * (RATE / rate)


def recording_prints(samples: np.ndarray) -> np.ndarray:
    """The prints of a recording, at least one if it has a sample."""
    return prints(chroma(np.resize(samples, SHORTEST) if 0 < len(samples) < SHORTEST else samples))


def agreement(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int, int] | None:
    """What matches where a's place i meets b's place i + offset, the overlap or else its best segment: first place in a, length, differing bits."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    n = hi - lo
    if n < max(1, min(LEAST_OVERLAP, len(a), len(b))):
        return None
    bits = np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).astype(np.int64)
    if bits.sum() <= MOST_ERRORS * 32 * n:
        return lo, n, int(bits.sum())
    if n < PASSAGE:
        return None
    gain = np.concatenate(([0.0], np.cumsum(MOST_ERRORS * 32 - bits)))
    most = gain[PASSAGE:] - np.minimum.accumulate(gain[: n + 1 - PASSAGE])
    end = int(most.argmax())
    if most[end] < 0:
        return None
    start = int(gain[: end + 1].argmin())
    return lo + start, end + PASSAGE - start, int(bits[start : end + PASSAGE].sum())


def evidence(a: np.ndarray, b: np.ndarray) -> float:
    """Nats against chance that prints ``a`` and ``b`` agree as they do, place by place: the less of what either side's new prints tell."""
    bits = np.bitwise_count(a ^ b).astype(np.int64)
    told = []
    for side in (a, b):
        new = np.sort(np.unique(side, return_index=True)[1])
        n = OWN_BITS + int(np.bitwise_count(side[new[1:]] ^ side[new[1:] - 1]).sum())
        told.append(n * np.square(max(0.0, 1 - 2 * bits[new].sum() / (32 * len(new)))) / 2)
    return min(told)


def spans(queries: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the prints equal to each of ``queries`` begin and end in ``ordered``; looked up in ascending order, as near places are in the cache."""
    order = np.argsort(queries, kind="stable")
    lo, hi = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
    lo[order], hi[order] = (np.searchsorted(ordered, queries[order], side) for side in ("left", "right"))
    return lo, hi


def alignments(query: np.ndarray, ordered: np.ndarray, owner: np.ndarray, place: np.ndarray, sizes: np.ndarray, span: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recording, offset and count of equal prints, for every offset with at least ``LEAST_VOTES`` of them, or as many as the shorter has prints; arguments as for ``align``, ``span`` as ``spans`` gives it."""
    lo, hi = spans(query, ordered) if span is None else span
    count = hi - lo
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    offset = place[at] - np.repeat(np.arange(len(query)), count)
    wide = int(np.abs(offset).max(initial=0)) + 1
    key, votes = np.unique(owner[at] * (2 * wide) + offset + wide, return_counts=True)
    who, off = key // (2 * wide), key % (2 * wide) - wide
    enough = votes >= np.minimum(min(LEAST_VOTES, len(query)), sizes[who])
    return who[enough], off[enough], votes[enough]


def overlaps(query: np.ndarray, ends: np.ndarray, who: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place in ``query`` and length (none where it is too short) of its overlap with the recordings ``who`` at ``offset``."""
    size = ends[who + 1] - ends[who]
    lo = np.maximum(0, -offset)
    n = np.minimum(len(query), size - offset) - lo
    return lo, np.where(n >= np.maximum(1, np.minimum(LEAST_OVERLAP, np.minimum(len(query), size))), n, 0)


def _waves(side: np.ndarray, size: int) -> np.ndarray:
    """The spectrum of each bit of the prints ``side``, as 1 or -1."""
    return np.fft.rfft(np.unpackbits(np.ascontiguousarray(side, "<u4").view(np.uint8).reshape(-1, 4), axis=1).T * 2.0 - 1, size)


def overlap_errors(query: np.ndarray, every: np.ndarray, ends: np.ndarray, who: np.ndarray, offset: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Differing bits of whole overlaps, as ``overlaps`` gives them; ``who`` ascends. A recording met at many offsets is correlated with the query at all of them at once."""
    out = np.zeros(len(who), np.int64)
    if not len(who):
        return out
    edge = np.flatnonzero(np.diff(who, prepend=-1, append=-1))
    cells = np.add.reduceat(n, edge[:-1])
    many = cells > MANY * (len(query) + ends[who[edge[:-1]] + 1] - ends[who[edge[:-1]]])
    own: dict[int, np.ndarray] = {}
    for k in np.flatnonzero(many).tolist():
        at, match = slice(edge[k], edge[k + 1]), every[ends[who[edge[k]]] : ends[who[edge[k]] + 1]]
        size = 1 << (len(query) + len(match)).bit_length()
        if size not in own:
            own[size] = _waves(query, size).conj()
        alike = np.fft.irfft((own[size] * _waves(match, size)).sum(0), size)[offset[at] % size]
        out[at] = np.where(n[at] > 0, np.rint((32 * n[at] - alike) / 2), 0)
    few = np.flatnonzero(np.repeat(~many, np.diff(edge)) & (n > 0))
    for at in np.split(few, np.flatnonzero(np.diff(np.cumsum(n[few]) // CELLS)) + 1) if len(few) else []:
        first = np.concatenate(([0], np.cumsum(n[at])))
        mine = np.arange(first[-1]) + np.repeat(lo[at] - first[:-1], n[at])
        bits = np.bitwise_count(query[mine] ^ every[mine + np.repeat(ends[who[at]] + offset[at], n[at])])
        out[at] = np.add.reduceat(bits, first[:-1], dtype=np.int64)
    return out


def last_seen(side: np.ndarray) -> np.ndarray:
    """The place before each print where it was last met, or -1."""
    order = np.argsort(side, kind="stable")
    again = side[order[1:]] == side[order[:-1]]
    out = np.full(len(side), -1)
    out[order[1:][again]] = order[:-1][again]
    return out


def _told(side: np.ndarray, other: np.ndarray, before: np.ndarray, lo: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """What ``side``'s new prints tell from ``lo`` on where place i meets ``other``'s i + offset, for many segments; ``before`` as ``last_seen`` gives it."""
    change = np.bitwise_count(side ^ np.roll(side, 1)).astype(np.int64)
    out = np.empty(len(lo))
    order = np.argsort(lo, kind="stable")
    for at in np.array_split(order, max(1, int(n.sum()) // CELLS)):
        # A print is new in the segments that begin after it was last met, up to its own place.
        since, until = np.searchsorted(lo[at], before, "right"), np.searchsorted(lo[at], np.arange(len(side)), "right")
        count = until - since
        i = np.repeat(np.arange(len(side)), count)
        k = np.arange(len(i)) + np.repeat(since - np.cumsum(count) + count, count)
        inside = i < (lo + n)[at][k]
        i, k = i[inside], k[inside]
        bits = np.bitwise_count(side[i] ^ other[i + offset[at][k]])
        tells = np.bincount(k, np.where(i == lo[at][k], OWN_BITS, change[i]), len(at))
        share = 2 * np.bincount(k, bits, len(at)) / (32 * np.bincount(k, minlength=len(at)))
        out[at] = tells * np.square(np.maximum(0.0, 1 - share)) / 2
    return out


def evidences(query: np.ndarray, every: np.ndarray, ends: np.ndarray, who: np.ndarray, offset: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``evidence`` of whole overlaps, as ``overlaps`` gives them; ``who`` ascends."""
    out = np.empty(len(who))
    if not len(who):
        return out
    edge = np.flatnonzero(np.diff(who, prepend=-1, append=-1))
    before = last_seen(query)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        at, match = slice(a, b), every[ends[who[a]] : ends[who[a] + 1]]
        if b - a < 4:
            out[at] = [evidence(query[x : x + m], match[x + o : x + o + m]) for x, m, o in zip(lo[at].tolist(), n[at].tolist(), offset[at].tolist(), strict=True)]
        else:
            out[at] = np.minimum(_told(query, match, before, lo[at], n[at], offset[at]), _told(match, query, last_seen(match), lo[at] + offset[at], n[at], -offset[at]))
    return out


def agreeing(query: np.ndarray, every: np.ndarray, ends: np.ndarray, who: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Where ``agreement`` finds something, of the recordings ``who`` (cut from ``every`` at ``ends``) at ``offset``."""
    size = ends[who + 1] - ends[who]
    lo = np.maximum(0, -offset)
    n = np.minimum(len(query), size - offset) - lo
    out = np.zeros(len(who), bool)
    able = np.flatnonzero(n >= np.maximum(1, np.minimum(LEAST_OVERLAP, np.minimum(len(query), size))))
    if not len(able):
        return out
    for at in np.split(able, np.flatnonzero(np.diff(np.cumsum(n[able]) // CELLS)) + 1):
        count = n[at]
        first = np.concatenate(([0], np.cumsum(count)))
        own = np.repeat(np.arange(len(at)), count)
        mine = lo[at][own] + np.arange(first[-1]) - first[own]
        bits = np.bitwise_count(query[mine] ^ every[ends[who[at]][own] + mine + offset[at][own]]).astype(np.int64)
        out[at] = np.add.reduceat(bits, first[:-1]) <= MOST_ERRORS * 32 * count
        # Running sums of all segments in one array, each far below those before it, so that minima stay within a segment.
        gain = np.concatenate(([0.0], np.cumsum(MOST_ERRORS * 32 - bits)))
        deep = 64.0 * (first[-1] + 1)
        own = np.repeat(np.arange(len(at)), count + 1)
        begin = first[:-1] + np.arange(len(at))
        inner = np.arange(len(own)) - begin[own]
        sums = gain[first[own] + inner] - gain[first[own]] - deep * own
        low = np.minimum.accumulate(sums)
        end = np.flatnonzero(inner >= PASSAGE)
        good = end[sums[end] - low[end - PASSAGE] >= -1e-3]  # a little less than nothing: the exact test follows
        out[at[np.unique(own[good])]] = True
    return out


def align(query: np.ndarray, ordered: np.ndarray, owner: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Recording, best offset and its count for all recordings with at least ``LEAST_VOTES`` there, or as many as the shorter has prints.

    ``ordered`` holds the prints of recordings in ascending order, ``owner`` and ``place`` whose and where they are, ``sizes`` their numbers of prints.
    """
    who, off, votes = alignments(query, ordered, owner, place, sizes)
    order = np.lexsort((off, np.abs(off), -votes, who))
    first = np.ones(len(order), bool)
    first[1:] = who[order][1:] != who[order][:-1]
    best = order[first]
    return list(zip(who[best].tolist(), off[best].tolist(), votes[best].tolist(), strict=True))


def with_prints(recordings: DataFrame, audio: str, to: str = "prints", rate: int = RATE) -> DataFrame:
    """``recordings`` with the prints of ``audio`` (binary, little-endian 16-bit samples, ``rate`` a second) in its place, as packed integers."""
    prepare(recordings.sparkSession)
    rest = recordings.drop(audio, to)
    schema = T.StructType([*rest.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(batch.num_columns - 1):
                got = recording_prints(resampled(np.frombuffer(raw.as_py(), "<i2", len(raw.as_py()) // 2), rate)) if raw.is_valid else np.zeros(0, np.uint32)
                out.append(got.astype("<u4").tobytes() if len(got) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=schema.names)

    return recordings.select(*rest.columns, F.col(audio).alias("__audio")).mapInArrow(run, schema)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` prints of the ``rows`` (id, name, prints): ids, names, numbers of prints, prints of whole recordings. A block holds the first of a name only."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, tuple[int, bytes]] = {}
        held = 0

        def out():
            ids, prints = zip(*sets.values(), strict=True)
            counts = np.array([len(x) // 4 for x in prints], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), b"".join(sets), counts.tobytes(), b"".join(prints))], names=columns)

        for batch in batches:
            for i, n, p in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if n in sets:
                    continue
                sets[n] = i, p
                held += len(p) // 4
                if held >= size:
                    yield out()
                    sets, held = {}, 0
        if sets:
            yield out()

    columns = [f"{name}_{x}" for x in ("ids", "names", "counts", "prints")]
    return rows.select("id", F.unhex("name"), "prints").mapInArrow(make, ", ".join(f"{x} binary" for x in columns))


NAME = 32  # bytes
HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("match", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("offset", "votes", "start", "overlap", "errors")), T.StructField("evidence", T.DoubleType())])


def named(recordings: DataFrame, is_query: Column, key: str = "id", to: str = "prints") -> DataFrame:
    """``id``, prints, their ``size`` in bytes, ``name`` (a digest of them, null where the row takes no part) and whether it is ``asked`` of all rows, written once."""
    takes_part = F.col(to).isNotNull() & F.col(key).isNotNull()
    return stored(recordings.select(F.col(key).alias("id"), F.when(takes_part, F.sha2(to, 256)).alias("name"), F.col(to).alias("prints"), F.length(to).alias("size"), is_query.alias("asked")), "prints")


def merged(rows: DataFrame) -> DataFrame:
    """The classes of equal prints among ``named`` rows: ``name``, smallest ``id``, ``copies``, ``size`` and whether a query is among them (``asked``)."""
    return stored(rows.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("asked").alias("asked")), "print-classes")


def search(recordings: DataFrame, is_query: Column, key: str = "id", to: str = "prints", k: int | None = None) -> DataFrame:
    """Alignments of the classes of the rows that ``is_query`` names with all classes, or the ``k`` of most evidence for each.

    ``query_id`` and ``match_id`` are the smallest ids of their classes, ``copies`` is the number of recordings of the match,
    ``offset`` its place less the query's, ``votes`` the equal prints there; ``start`` (in the query) and ``overlap`` say
    which prints agree, with ``errors`` differing bits. ``matches`` counts all of the query's. A class matches itself only
    where it has ``copies``. Equal evidence is ordered by ``match_id``.
    """
    rows = named(recordings, is_query, key, to)
    classes = merged(rows)
    hits = matches(rows, classes).join(classes.select(F.col("id").alias("match_id"), "copies"), "match_id").where("query_id <> match_id OR copies > 1")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("evidence"), "match_id"))).withColumn("matches", F.count("*").over(Window.partitionBy("query_id")))
    return (hits if k is None else hits.where(F.col("rank") <= k)).select("query_id", "rank", "match_id", "copies", "offset", "votes", "start", "overlap", "errors", "evidence", "matches")


def links(recordings: DataFrame, is_query: Column, key: str = "id", to: str = "prints") -> DataFrame:
    """A row for each recording: its class (``class_id``, the smallest id, and ``copies``) and how that is linked with others.

    ``links`` counts the other classes that match its class where one of the two has a row that ``is_query`` names: the
    pairs that ``search`` lists. The best of these (most evidence, then the smaller ``best_id``) is told with its
    ``evidence``, ``votes``, ``overlap``, ``errors`` and ``offset`` (its place less the row's). Rows that take no part have no class.
    """
    rows = named(recordings, is_query, key, to)
    classes = merged(rows)
    told = ["evidence", "votes", "overlap", "errors"]
    found = stored(matches(rows, classes).where("query_id <> match_id"), "matches")
    both = found.select(F.col("query_id").alias("class_id"), F.col("match_id").alias("other"), "offset", *told)
    both = both.unionByName(found.select(F.col("match_id").alias("class_id"), F.col("query_id").alias("other"), (-F.col("offset")).alias("offset"), *told))
    # Two classes that are both queries found each other twice, maybe at different offsets of equal evidence.
    order = F.struct("evidence", (-F.col("other")).alias("less"), (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("low"), *told[1:])
    both = both.groupBy("class_id", "other").agg(F.max(order).alias("best"))
    best = both.groupBy("class_id").agg(F.count("*").alias("links"), F.max("best").alias("best"))
    classes = classes.select("name", F.col("id").alias("class_id"), "copies").join(best, "class_id", "left")
    return rows.select("id", "name").join(classes, "name", "left").select(
        "id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), (-F.col("best.less")).alias("best_id"), (-F.col("best.low")).alias("offset"), *[F.col(f"best.{x}") for x in told]
    )


def matches(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``HIT`` with ``match_id`` for every pair of an asked class and a class, the same one too, that agree; arguments as ``named`` and ``merged`` give them.

    Blocks are cut from the rows where they lie: a class that lies in several blocks is found in each, alike, and
    listed once. Blocks and queries are read side by side from files; no prints but the queries' go through a shuffle.
    """
    count, asked_for = classes.agg(F.sum("size"), F.sum(F.when(F.col("asked"), F.col("size")))).head()
    least = float(np.log(max(1, (count or 0) // 4) / CHANCE))
    full = max(1, -(-(asked_for or 0) // (4 * BLOCK)))  # as few blocks of queries as there can be: each meets all others
    questions = rows.where("asked AND name IS NOT NULL").groupBy("name").agg(F.first("prints").alias("prints")).join(classes.select("name", "id"), "name")
    asked = stored(_blocks(questions.coalesce(full), BLOCK, "q"), "query-blocks")
    held = stored(_blocks(rows.where("name IS NOT NULL"), BLOCK, "v"), "print-blocks")

    def opened(ids: bytes, names: bytes, counts: bytes, raw: bytes):
        ends = np.concatenate(([0], np.cumsum(np.frombuffer(counts, np.int64))))
        return np.frombuffer(ids, np.int64), [names[i : i + NAME] for i in range(0, len(names), NAME)], ends, np.frombuffer(raw, "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q_names, q_ends, q_all = opened(*(row[f"q_{x}"] for x in ("ids", "names", "counts", "prints")))
                _, names, ends, every = opened(*(row[f"v_{x}"] for x in ("ids", "names", "counts", "prints")))
                own = {n: j for j, n in enumerate(names)}
                owner = np.repeat(np.arange(len(names)), np.diff(ends))
                place = np.arange(len(every)) - ends[owner]
                order = np.argsort(every, kind="stable")
                ordered, owner, place = every[order], owner[order], place[order]
                low, high = spans(q_all, ordered)
                sizes = np.diff(ends)
                found = []
                for i, q_id in enumerate(q_ids):
                    at = slice(q_ends[i], q_ends[i + 1])
                    query, mine = q_all[at], own.get(q_names[i], -1)
                    who, offsets, votes = alignments(query, ordered, owner, place, sizes, (low[at], high[at]))
                    other = who != mine
                    who, offsets, votes = who[other], offsets[other], votes[other]
                    lo, n = overlaps(query, ends, who, offsets)
                    errors = overlap_errors(query, every, ends, who, offsets, lo, n)
                    whole = np.flatnonzero((n > 0) & (errors <= MOST_ERRORS * 32 * n))
                    told = evidences(query, every, ends, who[whole], offsets[whole], lo[whole], n[whole])
                    whole, told = whole[told >= least], told[told >= least]
                    first = np.lexsort((offsets[whole], np.abs(offsets[whole]), -told, who[whole]))
                    first = first[np.flatnonzero(np.diff(who[whole][first], prepend=-1))]
                    best: dict[int, tuple] = {}
                    for c, x in zip(whole[first].tolist(), told[first].tolist(), strict=True):
                        offset = int(offsets[c])
                        best[int(who[c])] = (x, -abs(offset), -offset), (offset, int(votes[c]), int(lo[c]), int(n[c]), int(errors[c]), x)
                    # Where the overlap does not agree, a passage of it may.
                    part = np.flatnonzero((n >= PASSAGE) & (errors > MOST_ERRORS * 32 * n))
                    for c in part[agreeing(query, every, ends, who[part], offsets[part])].tolist():
                        j, offset = int(who[c]), int(offsets[c])
                        match = every[ends[j] : ends[j + 1]]
                        if (agreed := agreement(query, match, offset)) is None:
                            continue
                        start, n, errors = agreed
                        told = evidence(query[start : start + n], match[start + offset : start + offset + n])
                        if told >= least and (j not in best or (told, -abs(offset), -offset) > best[j][0]):
                            best[j] = (told, -abs(offset), -offset), (offset, int(votes[c]), start, n, errors, told)
                    found += [(q_id, names[j], *hit) for j, (_, hit) in best.items()]
                    if mine >= 0:
                        found.append((q_id, names[mine], 0, len(query), 0, len(query), 0, evidence(query, query)))
                columns = list(zip(*found, strict=True)) or [()] * len(HIT)
                kinds = {"match": pa.binary(), "evidence": pa.float64()}
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(f.name, pa.int64())) for x, f in zip(columns, HIT, strict=True)], names=HIT.names)

    hits = held.crossJoin(asked).mapInArrow(run, HIT).distinct()
    return hits.join(classes.select(F.unhex("name").alias("match"), F.col("id").alias("match_id")), "match").drop("match")


CHORD = 3  # notes
NOTE = 0.5  # seconds of a sentence: a print then hears about six


def _scale(note: float) -> np.ndarray:
    """The samples of one note of each pitch, as loud as a chord allows."""
    t = np.arange(int(RATE * note)) / RATE
    return np.array([9000 / CHORD * np.sin(2 * np.pi * 440 * 2 ** ((n - 69) / 12) * t) for n in range(45, 81)]).astype("<i2")


_SENTENCE = np.ones(256, bool)
_SENTENCE[list(b".?!\n")] = False


def tunes(texts: pa.Array, scale: np.ndarray) -> Iterator[np.ndarray]:
    """The samples of each text's tune: a chord of ``CHORD`` notes for each sentence, their pitches by a hash of it; none for a text without any."""
    data, offsets = utf8(texts)
    start, end, own = words(data, offsets, _SENTENCE)
    name = span_hashes(data, start, end)
    pitch = np.stack([(name >> np.uint64(20 * i)) % np.uint64(len(scale)) for i in range(CHORD)], axis=1).astype(np.int64)
    edge = np.searchsorted(own, np.arange(len(texts) + 1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        samples = scale.take(pitch[a:b, 0], axis=0)
        for i in range(1, CHORD):
            samples += scale.take(pitch[a:b, i], axis=0)
        yield samples.ravel()


def derived_audio(docs: DataFrame, key: str = "doc_id", text: str = "text", note: float = NOTE) -> DataFrame:
    """``id`` and ``audio``: the tune of each whole text.

    Sentences end at full stops, question and exclamation marks and line feeds.
    A text without any, or null, gives null audio.
    """
    prepare(docs.sparkSession)
    scale = _scale(note)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audio = [x.tobytes() if len(x) else None for x in tunes(batch.column(1), scale)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(audio, pa.binary())], names=["id", "audio"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(play, "id long, audio binary")


def tune_prints(docs: DataFrame, key: str = "doc_id", text: str = "text", note: float = NOTE) -> DataFrame:
    """``id`` and ``prints``, as ``with_prints`` gives them for ``derived_audio``, one tune at a time: the audio never leaves its task."""
    prepare(docs.sparkSession)
    scale = _scale(note)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [got.astype("<u4").tobytes() if len(got := recording_prints(x)) else None for x in tunes(batch.column(1), scale)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "prints"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, prints binary")


def op2_audio_prints(spark, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``: the class of its tune, and its links among all alignments of the tunes whose id is divisible by 100 with all tunes."""
    return links(tune_prints(spark.read.parquet(f"{sf_dir}/documents.parquet")), F.col("id") % 100 == 0)
