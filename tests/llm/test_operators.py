"""The training-data operators against brute force, round trips and edge cases."""

import collections
import os
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import ann, audio_prints, common, edit_counts, html_text, langid, mixing, near_dedup, packing, quality, sharding

SF = "/root/testdata/sf0.001"
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, class_id long"
EDGES = [
    (1, None, None, None, None, 1.0, 1, 1), (2, "", "en", "a", 0, None, 2, 2), (3, "!!! 123", "en", None, 7, 0.0, None, 3), (4, "the same words here again and again", "en", "a", 35, 0.0, 4, 4),
    (4, "the same words here again and again", "en", "a", 35, 0.0, 4, 4), (None, "ein Satz ohne Schlüssel", "de", "b", 23, 0.0, 5, 5), (6, "wort " * 30000, "de", "b", 150000, 0.0, 6, 6), (7, "日本語 'tis ₂ ΣΑΣ", None, "c", 10, 0.0, 7, 7),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, EDGE_SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Nearest neighbours


def test_ann_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[50:60] = x[49]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(900, [0.0] * 16, ""), (901, None, ""), (902, [float("nan")] * 16, ""), (903, [1.0], ""), (None, [1.0] * 16, "")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("id") % 20 == 0, 7)
    for q, group in got.toPandas().groupby("query_id"):
        exact = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(300), -exact)) if i != q][:7]
        assert group.sort_values("rank").vec_id.tolist() == want
        assert np.allclose(group.sort_values("rank").score, exact[want], atol=1e-12)
    assert got.select("query_id").distinct().count() == 15


def test_ann_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), F.col("id") % 20 == 0, 20).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], schema), F.col("id") % 20 == 0, 20)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 0.0)]


def test_ann_error_bound_holds():
    rng = np.random.default_rng(1)
    x, turn = rng.normal(size=(2000, 32)), ann.rotation(32)
    mean = x.mean(0)
    _, scalars = ann.encode(x, mean, turn)
    signs = np.where(((x - mean) / scalars[:, :1]) @ turn >= 0, 1, -1) / np.sqrt(32)
    q = (x[:50] - mean) @ turn
    error = np.abs(q @ signs.T * (scalars[:, 0] / scalars[:, 1]) - (x[:50] - mean) @ (x - mean).T)
    bound = np.linalg.norm(q, axis=1)[:, None] * (3.0 * scalars[:, 0] * np.sqrt(1 - scalars[:, 1] ** 2) / scalars[:, 1] / np.sqrt(31))
    assert (error <= bound).mean() > 0.99


# Audio


def tune(pitches, note=0.25):
    t = np.arange(int(audio_prints.RATE * note)) / audio_prints.RATE
    return np.concatenate([9000 * np.sin(2 * np.pi * 440 * 2 ** ((p - 69) / 12) * t) for p in pitches]).astype("<i2")


def test_audio_prints_match_plain_sums():
    image = np.random.default_rng(2).random((30, 12))
    got = audio_prints.prints(image)
    assert len(got) == 30 - audio_prints.WINDOW + 1
    for at in (0, 7, 14):
        want = 0
        for kind, y, h, w in audio_prints.FILTERS:
            part = image[at : at + w]
            early, late = part[: w // 2], part[w // 2 : 2 * (w // 2)]
            low, high = slice(y, y + h // 2), slice(y + h // 2, y + 2 * (h // 2) if kind == 3 else y + h)
            if kind == 0:
                a = part[:, y : y + h].sum()
                b = (part.sum() - a) * h / (12 - h)
            elif kind == 1:
                a, b = part[:, low].sum(), part[:, high].sum()
            elif kind == 2:
                a, b = early[:, y : y + h].sum(), late[:, y : y + h].sum()
            elif kind == 3:
                a, b = early[:, low].sum() + late[:, high].sum(), early[:, high].sum() + late[:, low].sum()
            else:
                a = part[w // 4 : w // 4 + w // 2, y : y + h].sum()
                b = part[: w // 4, y : y + h].sum() + part[3 * w // 4 : 3 * w // 4 + w // 4, y : y + h].sum()
            gap = np.log1p(a) - np.log1p(b)
            want = want << 2 | [0, 1, 3, 2][sum(gap > step for step in (-0.25, 0.0, 0.25))]
        assert got[at] == want
    assert {kind for kind, *_ in audio_prints.FILTERS} == set(range(5))


def test_audio_chroma_matches_a_plain_transform():
    rng = np.random.default_rng(21)
    samples = tune(rng.integers(45, 80, 14))
    samples = (samples + rng.normal(0, 100, len(samples))).astype("<i2")
    n = (len(samples) - audio_prints.FRAME) // audio_prints.HOP + 1
    image = np.zeros((n, 12))
    for i in range(n):
        frame = samples[i * audio_prints.HOP : i * audio_prints.HOP + audio_prints.FRAME] * np.hanning(audio_prints.FRAME)
        for k, power in enumerate(np.abs(np.fft.rfft(frame)) ** 2):
            hertz = k * audio_prints.RATE / audio_prints.FRAME
            if audio_prints.LOWEST <= hertz <= audio_prints.HIGHEST:
                image[i, round(12 * np.log2(hertz / 440) + 69) % 12] += power
    smooth = np.array([sum(w * image[i + j] for j, w in enumerate(audio_prints.SMOOTH)) for i in range(n - 4)])
    assert np.allclose(audio_prints.chroma(samples), smooth / np.linalg.norm(smooth, axis=1, keepdims=True), atol=1e-4)
    assert not audio_prints.chroma(np.zeros(20000, "<i2")).any()


def test_audio_offsets_match_a_plain_histogram():
    rng = np.random.default_rng(22)
    sets = [rng.integers(0, 40, n).astype(np.uint32) for n in (1, 5, 30, 60)]
    every, owner = np.concatenate(sets), np.repeat(np.arange(4), [1, 5, 30, 60])
    place = np.concatenate([np.arange(len(x)) for x in sets])
    order = np.argsort(every, kind="stable")
    for query in (rng.integers(0, 40, 25).astype(np.uint32), sets[2][5:], sets[0]):
        want = []
        for j, x in enumerate(sets):
            votes = collections.Counter(b - a for a in range(len(query)) for b in range(len(x)) if query[a] == x[b])
            if votes and (best := min(votes, key=lambda o: (-votes[o], abs(o), o))) is not None and votes[best] >= min(audio_prints.LEAST_VOTES, len(query), len(x)):
                want.append((j, best, votes[best]))
        assert audio_prints.align(query, every[order], owner[order], place[order], np.array([1, 5, 30, 60])) == want


def test_audio_agreement_is_the_best_segment():
    rng = np.random.default_rng(23)
    a, b = (rng.integers(0, 2**32, 120, dtype=np.uint32) for _ in range(2))
    b[50:86] = a[40:76]
    start, n, errors = audio_prints.agreement(a, b, 10)
    bits = np.bitwise_count(a[: 110] ^ b[10:]).astype(int)
    best = max(((0.3 * 32 - bits[i:j]).sum(), i, j) for i in range(110) for j in range(i + audio_prints.PASSAGE, 111))
    assert (start, start + n) == best[1:] and errors == bits[start : start + n].sum()
    assert audio_prints.agreement(a, rng.integers(0, 2**32, 120, dtype=np.uint32), 3) is None
    assert audio_prints.agreement(a, a, 115) is None and audio_prints.agreement(a, a, 0) == (0, 120, 0)


def test_audio_evidence_is_against_chance():
    rng = np.random.default_rng(24)
    least = np.log(1e7 / audio_prints.CHANCE)
    song = audio_prints.recording_prints(tune(rng.integers(45, 80, 40)))
    assert audio_prints.evidence(song, song) > least
    held = audio_prints.recording_prints(tune([60] * 400))
    assert audio_prints.evidence(held, held) < 25 < audio_prints.evidence(song, song) / 2  # one tone, however long
    chance = max(audio_prints.evidence(a[:50], b[:50]) for a, b in ([audio_prints.recording_prints(tune(rng.integers(45, 80, 40))) for _ in range(2)] for _ in range(60)))
    assert chance < least


@pytest.mark.parametrize("many", [0, 100, 1e9])
def test_audio_overlaps_of_repeated_lines_are_judged_at_once(monkeypatch, many):
    monkeypatch.setattr(audio_prints, "MANY", many)
    monkeypatch.setattr(audio_prints, "CELLS", 5000)
    rng = np.random.default_rng(11)
    line = rng.integers(0, 2**32, 9, dtype=np.uint32)
    texts = [np.concatenate((rng.integers(0, 2**32, int(rng.integers(1, 9)), dtype=np.uint32), np.tile(line, int(rng.integers(1, 40))) ^ (rng.random(1) < 0.5).astype(np.uint32))) for _ in range(9)]
    texts += [line[:1], line[:3], np.tile(line[:1], 50)]
    every, ends = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    agreed = 0
    for query in texts:
        who, offset = (np.array(x) for x in zip(*[(j, o) for j, x in enumerate(texts) for o in range(-len(query), len(x) + 1)], strict=True))
        lo, n = audio_prints.overlaps(query, ends, who, offset)
        errors = audio_prints.overlap_errors(query, every, ends, who, offset, lo, n)
        whole = np.flatnonzero((n > 0) & (errors <= audio_prints.MOST_ERRORS * 32 * n))
        told = dict(zip(whole.tolist(), audio_prints.evidences(query, every, ends, who[whole], offset[whole], lo[whole], n[whole]).tolist(), strict=True))
        for c, (j, o) in enumerate(zip(who.tolist(), offset.tolist(), strict=True)):
            got = audio_prints.agreement(query, texts[j], o)
            if c not in told:
                assert got is None or n[c] >= audio_prints.PASSAGE and got[1] <= n[c]
                continue
            assert got == (lo[c], n[c], errors[c])
            assert told[c] == audio_prints.evidence(query[lo[c] : lo[c] + n[c]], texts[j][lo[c] + o : lo[c] + o + n[c]])
            agreed += 1
    assert agreed > 1000


def test_audio_finds_shifted_and_noisy_copies(spark):
    rng = np.random.default_rng(3)
    song, other = rng.integers(45, 80, 60), rng.integers(45, 80, 60)
    noisy = (tune(song) + rng.normal(0, 300, len(tune(song)))).astype("<i2")
    cut = tune(song)[8 * audio_prints.HOP :]
    rows = [(0, tune(song).tobytes()), (1, noisy.tobytes()), (2, cut.tobytes()), (3, tune(other).tobytes()), (4, tune(song).tobytes()), (5, None), (6, b""), (7, b"\0" * 100000)]
    made = audio_prints.with_prints(spark.createDataFrame(rows, "id long, audio binary"), "audio")
    got = {r.match_id: r for r in audio_prints.search(made, F.col("id") == 0).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].copies == 2 and got[0].errors == 0 and got[1].offset == 0 and got[2].offset == -8


def test_audio_prints_of_texts_are_those_of_their_audio(spark, edges):
    apart = audio_prints.with_prints(audio_prints.derived_audio(edges), "audio")
    pick = lambda d: sorted(((r.id is None, r.id, r.prints) for r in d.collect()), key=repr)
    long = spark.createDataFrame([(9, "One. Two! Three? Four.\n" * 40)], "doc_id long, text string")
    assert pick(apart) == pick(audio_prints.tune_prints(edges))
    assert len(audio_prints.tune_prints(long).head()["prints"]) > 400


def test_audio_short_recordings_and_passages_match(spark):
    rng = np.random.default_rng(10)
    song, passage = rng.integers(45, 80, 60), tune(rng.integers(45, 80, 30))
    other = [tune(rng.integers(45, 80, 90)) for _ in range(4)]
    a = np.concatenate((other[0][: 170 * audio_prints.HOP], passage, other[1]))
    b = np.concatenate((other[2][: 150 * audio_prints.HOP], passage, other[3]))
    rows = [(0, tune(song[:1])), (1, tune(song[:1])), (2, tune(song[:12])), (3, tune(song)), (4, a), (5, b)]
    made = audio_prints.with_prints(spark.createDataFrame([(i, x.tobytes()) for i, x in rows], "id long, audio binary"), "audio")
    got = {(r.query_id, r.match_id): r for r in audio_prints.search(made, F.col("id").isin(0, 2, 4)).collect()}
    assert set(got) == {(0, 0), (2, 3), (4, 5)} and got[0, 0].copies == 2
    assert got[2, 3].overlap == 3 and got[4, 5].offset == -20 and got[4, 5].overlap >= audio_prints.PASSAGE


def test_audio_planted_copies_among_tunes(spark, docs):
    rows = docs.where("length(text) > 600").orderBy("doc_id").limit(60).select("doc_id", "text").collect()
    cut = lambda t: ". ".join(t.split(". ")[2:])
    planted = [(10_000 + i, cut(r.text)) for i, r in enumerate(rows) if r.text.count(". ") > 25] + [(20_000 + i, r.text) for i, r in enumerate(rows)]
    made = audio_prints.tune_prints(spark.createDataFrame([(r.doc_id, r.text) for r in rows] + planted, "doc_id long, text string"))
    member = {r.id: r.prints for r in made.collect()}
    first = {}
    for i in sorted(member):
        first.setdefault(member[i], i)
    everything = audio_prints.search(made, F.lit(True)).collect()
    got = {(r.query_id, r.match_id) for r in everything}
    wanted = {(first[member[i]], first[member[rows[i % 10_000].doc_id]]) for i, _ in planted}
    assert len(wanted) > 60 and wanted <= got
    text = dict([(r.doc_id, r.text) for r in rows] + planted)
    notes = {i: set(re.split("[.?!\n]", t)) for i, t in text.items()}
    assert all(notes[a] & notes[b] - {""} for a, b in got)
    edited = [(30_000 + i, re.sub(r"[^.?!\n]+(?=[.?!\n])", lambda m: m.group() if zlib.crc32(m.group().encode()) % 12 else "changed " + m.group(), r.text)) for i, r in enumerate(rows) if len(re.findall("[.?!\n]", r.text)) > 20]
    both = audio_prints.tune_prints(spark.createDataFrame([(r.doc_id, r.text) for r in rows] + edited, "doc_id long, text string"))
    pairs = {(r.query_id, r.match_id) for r in audio_prints.search(both, F.col("id") >= 30_000).collect()}
    found = sum((i, rows[i - 30_000].doc_id) in pairs for i, _ in edited)
    assert len(edited) > 15 and found >= 0.9 * len(edited), (found, len(edited))
    few = audio_prints.search(made, F.lit(True), k=2).collect()
    assert {(r.query_id, r.match_id) for r in few} == {(r.query_id, r.match_id) for r in everything if r["rank"] <= 2}
    assert all(r.matches == sum(x.query_id == r.query_id for x in everything) for r in few)


def test_audio_every_offset_with_enough_votes_is_tried(spark, monkeypatch):
    # Brute force over all offsets of all pairs; where a recording agrees, another offset has more equal prints.
    rng = np.random.default_rng(31)
    monkeypatch.setattr(audio_prints, "CELLS", 500)
    sets = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in rng.integers(1, 90, 40)]
    for i in range(20, 40):  # noisy passages of others, two prints left whole
        a = sets[i - 20]
        flips = np.bitwise_or.reduce(np.uint32(1) << rng.integers(0, 32, (5, len(a))).astype(np.uint32), axis=0)
        flips[rng.integers(0, len(a), 2)] = 0
        sets[i] = np.concatenate((rng.integers(0, 2**32, rng.integers(0, 30), dtype=np.uint32), a ^ flips, a[:1].repeat(3), rng.integers(0, 2**32, 40, dtype=np.uint32)))
        sets[i][-30:-26] = a[:4] if len(a) > 4 else sets[i][-30:-26]  # more equal prints, at an offset that doesn't agree
    rows = [(i, x.astype("<u4").tobytes()) for i, x in enumerate(sets)] + [(50, sets[3].astype("<u4").tobytes()), (51, None), (None, sets[2].astype("<u4").tobytes())]
    least = np.log(sum(map(len, sets)) / audio_prints.CHANCE)
    want = {}
    for q in range(0, 40, 3):
        for d in range(40):
            for off in range(-len(sets[q]), len(sets[d])):
                lo, hi = max(0, -off), min(len(sets[q]), len(sets[d]) - off)
                if q != d and hi > lo and (sets[q][lo:hi] == sets[d][lo + off : hi + off]).sum() >= min(audio_prints.LEAST_VOTES, len(sets[q]), len(sets[d])) and (got := audio_prints.agreement(sets[q], sets[d], off)):
                    told = audio_prints.evidence(sets[q][got[0] : got[0] + got[1]], sets[d][got[0] + off : got[0] + got[1] + off])
                    if told >= least:
                        want[q, d] = max(want.get((q, d), ()), (told, -abs(off), -off))
    table = spark.createDataFrame(rows, "id long, prints binary")
    asked = F.col("id") % 3 == 0
    got = {(r.query_id, r.match_id): (r.evidence, -abs(r.offset), -r.offset) for r in audio_prints.search(table, asked).collect() if r.query_id != r.match_id}
    assert got == want and len(want) > 8
    linked = {r.id: r for r in audio_prints.links(table, asked).collect()}
    partners = collections.defaultdict(set)
    for a, b in want:
        partners[a].add(b)
        partners[b].add(a)
    assert {i: r.links for i, r in linked.items()} == {i: len(partners[3 if i == 50 else i]) for i in [*range(40), 50, 51, None]}
    assert linked[50].class_id == 3 and linked[50].copies == 2 and linked[51].class_id is None
    for i, r in linked.items():
        if r.links:
            me = r.class_id
            assert r.best_id in partners[me] and r.evidence == max(want[p][0] for p in want if me in p)


def test_audio_edges(spark, edges):
    made = audio_prints.tune_prints(edges)
    assert audio_prints.search(made, F.lit(True)).columns == ["query_id", "rank", "match_id", "copies", "offset", "votes", "start", "overlap", "errors", "evidence", "matches"]
    clash = audio_prints.with_prints(spark.createDataFrame([(1, b"\1\2" * 40000, "x", 3)], "id long, audio binary, prints string, votes long"), "audio")
    assert clash.columns == ["id", "votes", "prints"] and clash.head()["prints"] is not None
    assert audio_prints.search(made.where("false"), F.lit(True)).count() == 0


def test_audio_at_another_rate(spark):
    song = np.random.default_rng(11).integers(45, 80, 60)
    t = np.arange(11025 // 4) / 11025
    finer = np.concatenate([9000 * np.sin(2 * np.pi * 440 * 2 ** ((p - 69) / 12) * t) for p in song]).astype("<i2")
    a, b = (audio_prints.recording_prints(x) for x in (audio_prints.resampled(finer, 11025), tune(song)))
    assert abs(len(a) - len(b)) <= 1 and audio_prints.agreement(a, b, 0)[2] < 0.1 * 32 * len(a)


# Sharding


def test_sharding_brute_force_and_overflow(spark):
    rows = [(i, "x" * (i % 37), 5) for i in range(300)] + [(1000, "y" * 90, 0)] * 9 + [(1001, "z" * 500, 0), (None, None, 1)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard_part int"), 200).toPandas()
    assert len(out) == len(rows)
    sums = out.groupby(["shard_depth", "shard_prefix", "shard_part"]).agg(total=("n_bytes", "sum"), said=("shard_bytes", "max"), n=("n_bytes", "size"))
    assert (sums.total == sums.said).all() and ((sums.total <= 200) | (sums.n == 1)).all()
    bits = {i: int(__import__("hashlib").md5(str(i).encode()).hexdigest()[:15], 16) for i in range(300)}
    everything = [(bits.get(r[0]) if r[0] in bits else int(__import__("hashlib").md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16), len(r[1] or "")) for r in rows]
    for r in out[out.doc_id < 300].itertuples():
        total = lambda d: sum(n for b, n in everything if b >> (60 - d) == bits[r.doc_id] >> (60 - d))  # noqa: B023, E731
        assert total(r.shard_depth) <= 200 and (r.shard_depth == 0 or total(r.shard_depth - 1) > 200)


def test_sharding_keeps_texts_of_equal_keys(spark):
    rows = [(i % 3 or None, f"{i} " * 9) for i in range(60)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    assert sorted(r.text for r in out) == sorted(t for _, t in rows) and all(r.n_bytes == len(r.text) for r in out)
    held = collections.Counter()
    for r in out:
        held[r.shard_depth, r.shard_prefix, r.shard_part] += len(r.text)
    assert all(held[r.shard_depth, r.shard_prefix, r.shard_part] == r.shard_bytes <= 100 for r in out)


def test_sharding_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0


# Language ID


def test_ppm_is_a_probability_and_matches_a_plain_walk(spark):
    rows = spark.createDataFrame([("abracadabra " * 20, "a"), ("hokus pokus " * 20, "b")], "text string, lang string")
    model = langid.fit_ppm(rows, max_order=3, min_count=2)
    p = 2.0 ** -model.bits.astype(float)
    unseen = 256 - (model.classes > 0).sum()
    assert np.allclose(p[:, :, 1:].sum(2) + unseen * p[:, :, 0], 1, atol=1e-4)
    text = np.frombuffer(b"abra pok\xff", np.uint8)
    nodes = model.bits.shape[1]
    want = np.zeros(2)
    for i in range(len(text)):
        state = 0
        for k in range(1, model.order + 1):
            before = model.classes[text[i - k]] if i >= k else model.step.shape[1] - 1
            state = model.step[state, before]
        want += model.bits[:, state % nodes, model.classes[text[i]]]
    assert np.allclose(model.code_lengths(text, np.array([0, len(text)]))[0], want, rtol=1e-4)


def plain_code_length(samples, text, order, least):
    """Bits of ``text`` by escapes with exclusion, straight from counts of ``samples``."""
    counts = collections.defaultdict(collections.Counter)
    for sample in set(samples):
        for i, byte in enumerate(sample):
            for k in range(min(i, order) + 1):
                counts[sample[i - k : i]][byte] += 1

    def chances(context):
        below = chances(context[1:]) if context else [1 / 256] * 256
        seen = counts.get(context, {})
        n, d = sum(seen.values()), len(seen)
        if context and n < least:
            return below
        mass = sum(below[b] for b in range(256) if b not in seen)
        if not mass:
            return [seen.get(b, 0) / n for b in range(256)]
        return [seen[b] / (n + d) if b in seen else d / (n + d) * below[b] / mass for b in range(256)]

    return -sum(np.log2(chances(text[max(0, i - order) : i])[byte]) for i, byte in enumerate(text))


def test_ppm_matches_plain_counts(spark):
    samples = {"a": [b"abracadabra, abracadabra", b"a bra and a cad"], "b": [b"hokus pokus, fidibus", b"hokus pokus", b"hokus pokus"]}
    rows = spark.createDataFrame([(t.decode(), k) for k, v in samples.items() for t in v], "text string, lang string")
    model = langid.fit_ppm(rows, max_order=3, min_count=2, max_contexts=None)
    few = langid.fit_ppm(rows, max_order=3, min_count=2, max_contexts=5)
    assert few.bits.shape[1] < model.bits.shape[1] and (langid.fit_ppm(rows, max_order=3, min_count=2).bits == model.bits).all()
    for text in (b"abra", b"hokus", b"a pokus bra\xc3\xa9", b"zz", b"", b"us, a"):
        want = [plain_code_length(v, text, 3, 2) for v in samples.values()]
        assert np.allclose(model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], want, rtol=1e-4, atol=1e-4)


def test_language_held_out(spark, docs):
    got = langid.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark, edges, docs):
    got = langid.predict_language(edges, langid.fit_ppm(docs)).toPandas()
    assert len(got) == len(EDGES)
    assert set(got[got.text.isna() | got.text.isin(["", "!!! 123"])].lang_pred) == {"und"}
    assert got[got.text.str.startswith("wort", na=False)].lang_pred.isin(["de", "en", "es", "fr"]).all()  # an invented text of one word
    none = langid.predict_language(edges, langid.fit_ppm(edges.where("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


# Near-duplicates


def plain_set(text, df, total):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)
    idf = lambda f: np.log((1 + total) / (1 + max(f, near_dedup.FLOOR * total))) + 1
    return {g: n * idf(df.get(g, 0)) for g, n in grams.items()}


def test_near_dedup_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(5000 + i, r.text.replace("the", "Xyz", 1)) for i, r in enumerate(rows[:40])]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    df = collections.Counter(g for _, t in rows for g in plain_set(t, {}, len(rows)))
    sets = {i: plain_set(t, df, len(rows)) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            shared = sum(min(w, b[g]) for g, w in a.items() if g in b)
            total = sum(a.values()) + sum(b.values()) - shared
            if total and shared / total >= 0.8 - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in ids}
    assert len(set(got.values())) < len(ids)


def test_near_dedup_finds_copies_in_larger_groups(spark, tmp_path):
    """What a group's members share is no rarer for them than for a pair of copies: an edit at one of 22 places leaves 0.84 of two texts."""
    rng = np.random.default_rng(5)
    said = [f"w{i}" for i in rng.integers(0, 4000, 120)]
    near = [" ".join([*said[: 5 + 5 * (i % 22)], f"edit{i}", *said[6 + 5 * (i % 22) :]]) for i in range(60)]
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 4000, 30))) for i in range(1500)] + [(2000 + i, t) for i, t in enumerate(near)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dedup.op5_near_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(1500)] == list(range(1500)) and {got[2000 + i] for i in range(60)} == {2000}
    weighed = {r.class_id for r in near_dedup.classes(spark.read.parquet(f"{tmp_path}/documents.parquet"), floor=None).where("doc_id >= 2000").collect()}
    assert len(weighed) > 1


def test_near_dedup_sends_no_table_of_links_through_the_driver(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 5), (7, 9)], "a long, b long")
    plans = []

    def seen(df, name, keep=near_dedup.stored):
        out = keep(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near_dedup, "stored", seen)
        got = {(r.node, r.comp) for r in near_dedup.components(links).collect()}
    assert {x for x in got if x[0] != x[1]} == {(2, 1), (3, 1), (5, 1), (9, 7)}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_near_dedup_merges_in_few_jobs(spark):
    # The driver keeps something of each job, and rounds of merging have many of them.
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long").coalesce(1)
    stars = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21)], "a long, b long").coalesce(1)
    passes = collections.Counter()

    def seen(df, name, keep=near_dedup.stored):
        passes[name] += 1
        return keep(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near_dedup, "stored", seen)
        assert {(r.node, r.comp) for r in near_dedup.components(stars).collect()} == {(i, 0) for i in range(1, 9)} | {(21, 20)}
        assert not passes
        spark.sparkContext.setJobGroup("merging", "merging")
        try:
            merged = near_dedup.components(path)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("merging"))
        assert {(r.node, r.comp) for r in merged.collect()} == {(i, 0) for i in range(1, 31)}
    assert 0 < jobs <= 8 * passes["stars"] and passes["stars"] < 6


def test_kept_texts_take_less_disk(spark, docs, monkeypatch):
    size = {}

    def seen(df, name, keep=near_dedup.stored, **how):
        out = keep(df, name, **how)
        size[name] = [sum(os.path.getsize(f.removeprefix("file://")) for f in t.inputFiles()) for t in (out, keep(df, name))]
        return out

    monkeypatch.setattr(near_dedup, "stored", seen)
    assert near_dedup.keep_one(docs).count() <= docs.count()
    assert size["rows"][0] < 0.85 * size["rows"][1]


def test_near_dedup_by_exact_frequencies(spark, docs, monkeypatch):
    # Copies of one text differ in a word: by exact frequencies what they share counts less, and some aren't similar any more.
    monkeypatch.setattr(near_dedup, "RANGE", 1000)
    monkeypatch.setattr(near_dedup, "RUN", 7)
    rng = np.random.default_rng(13)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("length(text) < 6000").collect()]
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(90)]
        for n in range(25):
            own = list(words)
            for at in rng.integers(0, 90, rng.choice([1, 2, 3])):
                own[at] = f"v{rng.integers(10**9)}"
            rows.append((6000 + 100 * base + n, " ".join(own)))
    rows += [(7000, None), (7001, ""), (7002, "two words"), (7003, "Two words!")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).persist()
    df = collections.Counter(g for _, t in rows for g in plain_set(t, {}, len(rows)))
    shared = near_dedup.shared_shingles(near_dedup.in_runs(table, "text"), "text").collect()
    counts = dict(x for r in shared for x in zip(*(y.tolist() for y in near_dedup.unpack_counts(r.blob)), strict=True))
    assert sorted(counts.values()) == sorted(f for f in df.values() if f > 1) and len({r["__run"] for r in shared}) > 20
    idf = lambda f: np.log((1 + len(rows)) / (1 + f)) + 1
    sets = {i: {g: n * idf(df[g]) / idf(max(df[g], near_dedup.FLOOR * len(rows))) for g, n in plain_set(t, df, len(rows)).items()} for i, t in rows}
    want = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            both = sum(min(w, b[g]) for g, w in a.items() if g in b)
            if a and b and both >= (0.8 - 1e-9) * (sum(a.values()) + sum(b.values()) - both):
                low, high = sorted((want[i], want[j]))
                want = {k: low if x == high else x for k, x in want.items()}
    want[7001] = 7000
    got = {r.doc_id: r.class_id for r in near_dedup.classes(table, floor=None).collect()}
    flat = {r.doc_id: r.class_id for r in near_dedup.classes(table).collect()}
    assert got == want and got != flat


def test_weighted_samples_estimate_similarity():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.sort(keys[:300]), np.sort(keys[60:360])
    w = lambda k: 1.0 + (k % np.uint64(3)).astype(float)
    equal = np.mean([(near_dedup.weighted_samples(common.mix64(a + np.uint64(s)), w(a)) == near_dedup.weighted_samples(common.mix64(b + np.uint64(s)), w(b))).mean() for s in range(30)])
    assert equal == pytest.approx(near_dedup.weighted_jaccard((a, w(a)), (b, w(b))), abs=0.05)


def versions(monkeypatch, own):
    """Texts whose samples agree but for the places that ``own`` gives by their number of shingles, and where only 96 and 97 are similar."""

    def samples(made, weight):
        out = np.arange(near_dedup.SAMPLES, dtype=np.uint32)
        at = own(len(made))
        out[at] = 1000 * len(made) + at
        return out

    monkeypatch.setattr(near_dedup, "weighted_samples", samples)
    return [(n, " ".join(f"w{0 if n > 95 else n}x{i}" for i in range(n + 4))) for n in [*range(30, 54), 96, 97]]


def test_near_dedup_verifies_partners_beyond_the_best(spark, monkeypatch):
    # 27 samples agree with each of the others, 20 with the true partner.
    rows = versions(monkeypatch, lambda n: {96: np.arange(3, 11), 97: np.arange(11, 19)}.get(n, np.array([35])))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: min(n, 96) for n, _ in rows}


def test_near_dedup_in_crowded_buckets(spark, monkeypatch):
    # All share the first band; the true partners agree in two samples of every other one, the others in none.
    monkeypatch.setattr(near_dedup, "BUCKET", 4)
    last = np.arange(5, 36, 3)
    rows = versions(monkeypatch, lambda n: last if n > 95 else np.arange(3, 36))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: min(n, 96) for n, _ in rows}


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    comp = lambda i: 7 if i < 25 else i
    members = spark.createDataFrame([(1, i, 40, comp(i)) for i in range(40)] + [(2, i, 5, i) for i in range(5)], "bucket long, node long, count long, comp long")
    met = collections.Counter()
    rows = near_dedup.in_blocks(members, False).collect()
    for a in rows:
        for b in rows:
            if a.bucket == b.bucket and a.node < b.node and a.comp != b.comp and (a.side < 0 or a.side != b.side):
                met[a.node, b.node, a.bucket == 2] += 1
    assert len(met) == 40 * 39 // 2 - 25 * 24 // 2 + 10 and set(met.values()) == {1}
    first = collections.Counter(r.bucket for r in near_dedup.in_blocks(members, True).collect())
    assert first[2] == 5 and sum(first.values()) == 85 and max(first.values()) < 20


def test_every_pair_has_one_turn():
    node = np.sort(np.random.default_rng(8).integers(-(2**62), 2**62, 300)).view(np.uint64)
    turns, first = collections.Counter(), 0
    while first < len(node):
        last = near_dedup.STEP * max(first, 1)
        for i, j in near_dedup._turns(node, np.full(len(node), float(len(node))), first, last):
            turns.update(zip(i.tolist(), j.tolist(), strict=True))
        if first == 0:
            assert 0.7 < len(turns) / (near_dedup.STEP * len(node) / 2) < 1.3
        first = last
    assert set(turns) == {(i, j) for i in range(300) for j in range(i)} and set(turns.values()) == {1}


@pytest.mark.parametrize("parts", [3, 40])
def test_near_dedup_of_a_large_group(spark, monkeypatch, parts):
    monkeypatch.setattr(near_dedup, "BUCKET", 32)
    rng = np.random.default_rng(12)
    texts = [[f"w{i}" for i in rng.integers(0, 500, 60)]]
    while len(texts) < 240:  # versions of versions, some far from all others
        words = list(texts[rng.integers(len(texts))])
        for at in rng.integers(0, 60, rng.choice([1, 1, 2, 6])):
            words[at] = f"v{rng.integers(10**9)}"
        texts.append(words)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    df = collections.Counter(g for _, t in rows for g in plain_set(t, {}, len(rows)))
    sets, want = [plain_set(t, df, len(rows)) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = sum(min(w, sets[j][g]) for g, w in sets[i].items() if g in sets[j])
            if shared / (sum(sets[i].values()) + sum(sets[j].values()) - shared) >= 0.8 - 1e-9:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert got == dict(enumerate(want)) and 10 < len(set(want)) < 200


def test_frequent_shingles_of_many_small_parts(spark, monkeypatch):
    # Parts of five documents name every shingle; only what may be frequent in all of them reaches the driver.
    monkeypatch.setattr(near_dedup, "MAX_HEAVY", 50, raising=False)
    texts = [" ".join([*("one line in many of them" if i % 3 == 0 else "").split(), *(f"w{i}x{j}" for j in range(40))]) for i in range(60)]
    h, ratio = near_dedup.heavy_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(12), "text")
    sets = [plain_set(t, {}, 60) for t in texts]
    df = collections.Counter(g for s in sets for g in s)
    want = sorted((np.log(61 / (1 + f)) + 1) / (np.log(61 / 4) + 1) for f in df.values() if f > near_dedup.FLOOR * 60)
    assert len(h) == 2 and np.allclose(sorted(ratio), want)


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(9)
    keys = np.sort(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    ruled_out = 0
    for n in (1, 9, 60, 400, 3000):
        for _ in range(60):
            pair = []
            for _ in range(2):
                made = keys[:n][rng.random(n) < rng.choice([0.7, 0.95])]
                pair.append((made, rng.choice([0.31, 1.0, 3.0], p=[0.1, 0.8, 0.1], size=len(made)) if n < 60 else 1.0 + (made % np.uint64(3))))
            total, parts = zip(*((np.array([w.sum()]), np.frombuffer(near_dedup.sketch(m, w), np.uint8)[None, 8:]) for m, w in pair), strict=True)
            may = near_dedup.may_reach(total[0], parts[0], total[1], parts[1], 0.8)[0]
            assert may or near_dedup.weighted_jaccard(*pair) < 0.8
            ruled_out += not may
    assert ruled_out > 50


def test_sets_round_trip():
    made = np.sort(np.random.default_rng(5).integers(0, 2**63, 50).astype(np.uint64))
    keys, weight = near_dedup.unpack_set(near_dedup.pack_set(made, np.arange(50.0)))
    assert (keys == made >> np.uint64(24)).all() and (weight == np.arange(50)).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 9), (4, 5), (5, 6), (10, 11)] + [(20, i) for i in range(21, 60)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 5: 4, 6: 4, 11: 10} | {i: 20 for i in range(21, 60)} | {i: 100 for i in range(101, 131)}


def test_near_dedup_edges(spark, edges):
    got = near_dedup.classes(edges).toPandas()
    assert len(got) == len(EDGES)
    assert near_dedup.keep_one(edges).count() == 6  # null and empty texts are one class, and so are the equal rows
    assert near_dedup.classes(edges.where("false")).count() == 0


# Mixing


def test_capped_targets():
    got = mixing.capped_targets({"a": 100, "b": 10, "c": 890})
    assert got["b"] == 30 and sum(got.values()) == pytest.approx(1000)
    assert got["c"] / got["a"] == pytest.approx(3)


def test_flow_prefers_first_passes_and_serves_overlaps():
    flow = mixing.min_cost_flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 160})
    assert sum(flow[("a",)].values()) == 100
    assert sum(f.get("a", 0) for f in flow.values()) == 150 and sum(f.get("b", 0) for f in flow.values()) == 160
    cost = lambda words, sent: sum(max(0, sent - k * words) for k in (1, 2))
    total = sum(cost({("a",): 100, ("a", "b"): 100, ("b",): 10}[p], sum(f.values())) for p, f in flow.items())
    best = min(cost(100, x + y) + cost(10, 160 - y) + cost(100, 150 - x) for x in range(0, 151, 10) for y in range(130, 161))
    assert total == best


def test_mix_meets_targets_and_agrees(spark, docs):
    mixed = mixing.mix(docs, F.array("source"))
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 1 and r.over <= 0 for r in sums)
    again = mixing.mix(docs.repartition(7), F.array("source"))
    pick = lambda d: sorted(map(tuple, d.select("doc_id", "taken").collect()))
    assert pick(mixed) == pick(again)
    # Documents are taken whole: a source misses its sum by half of a document at most.
    rows = mixing.take(mixed)
    words = {r.source: r.n for r in rows.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    longest = {r.source: r.n for r in mixed.groupBy("source").agg(F.max("size").alias("n")).collect()}
    assert all(abs(words[r.source] - r.taken) <= longest[r.source] / 2 for r in sums)
    assert rows.join(docs, ["doc_id", "text"], "left_anti").isEmpty()


def test_one_long_document_is_taken_whole_or_not(spark):
    long = " ".join(["word"] * 1000)
    docs = spark.createDataFrame([(1, long, "a"), (2, "w " * 300, "b")], "doc_id long, text string, source string")
    taken = mixing.take(mixing.mix(docs, F.array("source"))).select("text").collect()
    assert {r.text for r in taken} <= {long, "w " * 300}


def test_mix_of_overlapping_sources(spark):
    rng = np.random.default_rng(41)
    kinds = [["a"], ["a", "b"], ["b"], ["b", "c", None], ["a", "a"], [], None]
    rows = [(i, "w " * int(rng.integers(0, 60)), kinds[int(rng.integers(len(kinds)))]) for i in range(300)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), F.col("sources")).toPandas()
    pattern = {i: tuple(sorted(set(k), key=lambda x: (x is None, x or ""))) if k else () for i, _, k in rows}
    sizes = collections.Counter()
    for r in mixed.itertuples():
        sizes[pattern[r.doc_id]] += r.size
    sizes.pop((), None)
    by_source = {s: sum(w for p, w in sizes.items() if s in p) for s in ("a", "b", "c", None)}
    targets = mixing.capped_targets(by_source)
    flow = mixing.min_cost_flow({p: sizes[p] for p in [("a",), ("a", "b"), ("b",), ("b", "c", None)]}, {s: round(t) for s, t in targets.items()})
    taken = collections.Counter()
    for r in mixed.itertuples():
        taken[pattern[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size and (not pattern[r.doc_id] or r.target == targets[pattern[r.doc_id][0]])
    assert {p: n for p, n in taken.items() if n} == {p: sum(f.values()) for p, f in flow.items() if sum(f.values())} and taken[()] == 0
    for s, quota in targets.items():
        assert sum(f.get(s, 0) for f in flow.values()) <= round(quota)


def test_flow_is_cheapest_by_brute_force():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        patterns = {("a",): int(rng.integers(1, 4)), ("a", "b"): int(rng.integers(1, 4)), ("b",): int(rng.integers(1, 4))}
        quotas = {"a": int(rng.integers(0, 9)), "b": int(rng.integers(0, 9))}
        price = lambda words, n: sum(min(max(n - words * level, 0), words) * level for level in range(3))
        best = None
        for x in range(3 * patterns["a",] + 1):
            for y in range(3 * patterns["b",] + 1):
                for z in range(3 * patterns["a", "b"] + 1):
                    for to_a in range(z + 1):
                        if x + to_a <= quotas["a"] and y + z - to_a <= quotas["b"]:
                            cost = price(patterns["a",], x) + price(patterns["b",], y) + price(patterns["a", "b"], z)
                            best = max(best or (-1, 0), (x + y + z, -cost))
        sent = {p: sum(f.values()) for p, f in mixing.min_cost_flow(patterns, quotas).items()}
        assert (sum(sent.values()), -sum(price(patterns[p], n) for p, n in sent.items())) == best


def test_flow_of_many_patterns():
    rng = np.random.default_rng(5)
    alone = {(f"s{i}",): int(rng.integers(0, 1000)) for i in range(10_000)}
    quotas = {p[0]: int(rng.integers(0, 2000)) for p in alone}
    began = time.perf_counter()
    assert mixing.min_cost_flow(alone, quotas) == {p: {p[0]: min(3 * n, quotas[p[0]])} for p, n in alone.items()}
    shared = {tuple(f"s{i}" for i in sorted(rng.choice(500, int(rng.integers(1, 4)), replace=False))): int(rng.integers(1, 1000)) for _ in range(10_000)}
    quotas = {s: int(rng.integers(0, 90_000)) for p in shared for s in p}
    flow = mixing.min_cost_flow(shared, quotas)
    assert time.perf_counter() - began < 60
    into = collections.Counter()
    for p, to in flow.items():
        assert set(to) == set(p) and 0 <= sum(to.values()) <= 3 * shared[p] and min(to.values()) >= 0
        into.update(to)
    assert all(into[s] <= quotas[s] for s in quotas)
    # A pattern with words left has no source with room left, so the flow is maximal unless words are moved; a cut proves it.
    open_ = {s for s in quotas if into[s] < quotas[s]}
    grown = True
    while grown:
        more = {s for p, to in flow.items() for s in p if to[s] and open_ & set(p)} - open_
        open_, grown = open_ | more, bool(more)
    assert all(sum(to.values()) == 3 * shared[p] for p, to in flow.items() if open_ & set(p))


def test_mix_edges(spark, edges):
    got = mixing.mix(edges, F.array("source")).toPandas()
    assert len(got) == len(EDGES) and (got[got.text.isna() | (got.text == "")].taken == 0).all()
    assert mixing.mix(edges.where("false"), F.array("source")).count() == 0


def test_word_count_is_the_contract_pattern(spark):
    texts = ["", " a\tb\x0bc\n", "x y z", None, "\x1c a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    assert all(r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.t or "")) for r in rows)


# Quality


def test_quality_held_out(spark):
    got = quality.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()


def plain_features(text):
    raw = text.encode()
    share = lambda which: sum(b in which for b in raw) / max(len(raw), 1)
    found, lines = re.findall(rb"[^ \t\r\x0b\x0c\n]+", raw), re.findall(rb"[^\n]+", raw)
    pairs = list(zip(found[:-1], found[1:], strict=True))
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", bytes(range(128, 256)), b"|", b"#%", b"&$", b"*", b"!", b".,"]
    other = bytes(set(range(256)) - set(b"".join([*kinds, b"\n", b"abcdefghijklmnopqrstuvwxyz"])))
    signs = sum(b in b"|#%&$*!" + other for b in raw)
    n, m = max(len(found), 1), max(len(pairs), 1)
    upper = lambda w: sum(65 <= b <= 90 for b in w) >= 2 and not any(97 <= b <= 122 for b in w)
    return [
        np.log1p(len(raw)), np.log1p(len(found)), np.log1p(len(lines)), *map(share, kinds), share(other), sum(map(len, found)) / n, sum(len(w) > 24 for w in found) / n, len(set(found)) / n,
        sum(a == b for a, b in pairs) / m, len(set(pairs)) / m, len(set(lines)) / max(len(lines), 1), min(signs / n, 8), sum(map(upper, found)) / n,
    ]


def test_quality_features_and_threshold(docs):
    import pyarrow as pa

    texts = ["", " \n", "One, TWO two two!\nOne, TWO two two!\n\n", "日本 é | ## $ 12", "x" * 40, *(r.text for r in docs.limit(40).collect())]
    got = quality.text_features(*common.utf8(pa.array(texts)))
    assert np.allclose(got, [plain_features(t) for t in texts])
    rng = np.random.default_rng(51)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400)
    x[:, 0] += y
    model = quality.fit_bradley_terry(x, y, pairs=5000)
    raw = np.clip((x - model.mean) / model.scale, -6, 6) @ model.weight
    gain = lambda cut: (raw[y == 1] >= cut).mean() + (raw[y == 0] < cut).mean()
    assert gain(model.threshold) == pytest.approx(max(gain(c) for c in raw)) and ((model.scores(x) >= model.cut) == (raw >= model.threshold)).all()


def test_quality_edges(spark, edges):
    features = quality.with_features(edges)
    labels = spark.createDataFrame([(2, 0), (4, 1), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    for model in (quality.learn(features, labels, pairs=500), quality.learn(features, labels.where("false"))):
        assert quality.score(features, model).count() == len(EDGES)
        assert quality.keep_good(edges, model).columns == edges.columns


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4))
    y = (x @ [2, -1, 0, 0.5] + rng.normal(0, 0.1, 500) > 0).astype(int)
    s = quality.fit_bradley_terry(x, y).scores(x)
    assert ((s >= 0.3) == (y == 1)).mean() > 0.95


# Edit-aware counts


def test_edits_equal_full_counts():
    import random

    rng = random.Random(7)
    tool = edit_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "s", "ll", "re", "1", "23", "!", "é", "\t", "日"]
    make = lambda n: "".join(rng.choices(alphabet, k=n))
    for _ in range(500):
        tree = edit_counts.TokenTree(make(rng.choice([0, 1, 5, 60, 900])), tool)
        for _ in range(4):
            tree.edit(rng.randint(-1, len(tree.text) + 2), rng.choice([0, 1, 2, 40]), make(rng.choice([0, 1, 3, 300])))
            assert tree.total == len(tool.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)


def test_edit_work_is_local(spark, edges):
    made = F.array(F.struct(F.lit(70000).alias("start"), F.lit(1).alias("length"), F.lit("x").alias("insert")), F.lit(None))
    tools = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = edit_counts.apply_edits(edit_counts.build_trees(edges, *tools), made, *tools).toPandas()
    assert len(got) == len(EDGES) and got.encoded_again.max() < 50
    assert got[got.doc_id == 6].chars_after.tolist() == [150000]
    assert edit_counts.build_trees(edges.where("false"), *tools).count() == 0


def test_kept_trees_are_edited_again(spark, docs):
    tools = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    whole = edit_counts.Counter(*tools)
    edit = lambda start, n, insert: F.array(F.struct(F.lit(start).alias("start"), F.lit(n).alias("length"), F.lit(insert).alias("insert")))
    held = common.stored(edit_counts.build_trees(docs.select("doc_id", "text"), *tools), "trees")
    for turn, made in enumerate((edit(100, 7, "  Some 12 new words, "), edit(20, 0, "x"), edit(90, 30, ""))):
        held = common.stored(edit_counts.apply_edits(held, made, *tools), f"trees-{turn}")
        rows = held.collect()
        assert all(r.tokens_after == len(whole.encoding.encode_ordinary(r.text)) and r.chars_after == len(r.text) for r in rows)
        assert all(r.encoded_again <= 120 for r in rows) and max(len(r.text) for r in rows) > 5000
    # A tree of another text is built anew, of the same length too.
    other = edit_counts.apply_edits(held.withColumn("text", F.translate("text", "aeiou", "12345")), edit(0, 0, ""), *tools).collect()
    assert all(r.tokens_after == len(whole.encoding.encode_ordinary(r.text)) for r in other)
    again = edit_counts.apply_edits(held.withColumn("text", F.concat("text", F.lit(" more"))), edit(0, 0, ""), *tools).collect()
    assert all(r.tokens_after == len(whole.encoding.encode_ordinary(r.text)) and r.encoded_again >= len(r.text) for r in again)


# Packing


def test_tokens_equal_the_tokenizer(edges):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = packing.WordTokenizer(path)
    texts = ["".join(map(chr, range(1, 256))).replace("'", ""), "don't 'street ''re", "Ça va? ÉTÉ x\x85y\x1cz", "ΣΑΣ İ", "", " ", "a1b22 <|endoftext|>", "é é"] + [r[1] or "" for r in EDGES]
    for _ in range(2):
        for text, ids in zip(texts, tool.encode(texts), strict=True):
            assert ids.tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, docs):
    got = packing.op9_packing(spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in used) < 0.02 * used.sum()
    tool = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for key, rows in got.groupby("doc_id"):
        ids = np.array([*tool.encode(texts[key], add_special_tokens=False).ids, 1], "<u4")
        assert sorted((r.start, r.start + r.length) for r in rows.itertuples())[0][0] == 0 and rows.length.sum() == len(ids) == rows.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows.itertuples())


def test_shortest_pack_first_keeps_counts():
    histogram = {2048: 3, 1100: 7, 700: 5, 300: 11, 40: 2, 1: 1}
    patterns = packing.shortest_pack_first(histogram, 2048)
    found = collections.Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 2048
        for size in pattern:
            found[size] += n
    assert found == histogram


def test_packing_gives_the_sequences(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "a text that comes twice " * 300), (1, "a text that comes twice " * 300), (1, "another one with its key " * 30), (None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).toPandas().sort_values(["sequence_id", "offset"])
    found = np.concatenate([np.frombuffer(x, "<u4") for x in got.ids])
    tool = packing.WordTokenizer(path).tokenizer
    want = np.concatenate([[*tool.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows])
    assert sorted(found) == sorted(want) and [len(x) // 4 for x in got.ids] == got.length.tolist()
    whole = got.groupby("sequence_id").ids.apply(lambda x: len(b"".join(x)) // 4)
    assert whole.max() == 2048 and whole.sum() == len(want)


def test_packing_ranks_rows_as_they_pass(spark):
    rows = [(i % 300, "the same words " * (i % 4)) for i in range(3000)]  # parts of many batches
    pieces = common.stored(packing.tokenized_pieces(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")), "pieces")
    made = packing.pack(pieces)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = made.select("length", "sequence_id", "offset").collect()
    assert len(got) == len({(r.sequence_id, r.offset) for r in got}) == 3000
    ends = collections.defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    assert all(a[1] == b[0] for x in map(sorted, ends.values()) for a, b in zip([(0, 0), *x], x, strict=False))


def test_packing_edges(spark, edges):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(edges, path).toPandas()
    assert got[got.doc_id == 1].length.tolist() == [1] and len(got[got.doc_id == 4]) == 2
    assert packing.pack_documents(edges.where("false"), path).count() == 0


# HTML


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><a href=x>menu</a></nav>
<div id="content"><h2>Real   title</h2><p>First paragraph, with commas, and text that is long enough.</p><div class="adSlot"><p>BUY, NOW, CHEAP</p></div><p>Second &amp; last&nbsp;one &lt;ok&gt;<br>line</p>
<ul><li>item one<li>item two</ul></div><aside><p>side, bar, text</p></aside><div id="comments"><p>Nice, post, really, great</p></div><form><p>Sign up</p></form><footer>foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE, "Real title\nFirst paragraph, with commas, and text that is long enough.\nSecond & last one <ok> line\nitem one\nitem two"),
        ("<main><section><p>One, two.</p></section><section><p>Three.</p></section></main><div class=related><p>x, y, z</p></div>", "One, two.\nThree."),
        ("<article><header><h1>Head</h1></header><p>Body, of text.</p><div class='comment-list'><p>no, no, no</p></div></article>", "Head\nBody, of text."),
        ("plain &copy;", "plain ©"), ("", ""), (None, ""), ("<script>var a='<p>x</p>'</script>", ""), ("<div>" * 3000 + "x", "x"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


PROSE = "Some prose, which is long enough to count as such, for certain."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<div class="page with-sidebar"><article><p>{PROSE}</p></article></div>', PROSE),
        (f'<article class="post category-social tag-search comments-open"><p>{PROSE}</p></article>', PROSE),
        (f'<div class="layout sidebar"><main><p>{PROSE}</p></main></div>', PROSE),
        (f"<div><div><p>Intro.</p></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>Short end.</p></div></div>", f"Intro.\n{PROSE}\n{PROSE}\nShort end."),
        (f"<body><article><p>{PROSE}</p></article><article><p>Second.</p></article></body>", f"{PROSE}\nSecond."),
        (f"<body><div><h1>Title</h1></div><div><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"Title\n{PROSE}\n{PROSE}"),
        (f"<article><header><h1>Title</h1><p>A dek.</p></header><p>{PROSE}</p></article>", f"Title\nA dek.\n{PROSE}"),
        ("<p>Before <script>x</script>after</p><p>a <button>b</button> c <svg><text>t</text></svg>d <label>e</label> f</p>", "Before after\na c d f"),
        (f"<p>{PROSE}</p><![foo[ x ]]><p>b</p>", f"{PROSE}\nb"), (f"<p>{PROSE}</p><![ <p>more</p>", f"{PROSE}\nmore"), ("<p>a<![endif]-->b</p>", "ab"),
        (f"<form><div><h1>T</h1><p>{PROSE}</p></div></form>", f"T\n{PROSE}"), (f'<div class="widget"><p>{PROSE}</p></div>', PROSE),
        (f'<div class="masthead"><h1>Site</h1></div><div><p>{PROSE}</p></div>', PROSE),
        (f'<div><h1>T</h1><p>{PROSE}</p></div><ol class="comment-list"><li><article class="comment"><p>No, no, no, no, no.</p></article></ol>', f"T\n{PROSE}"),
        ('<pre><code>x <span class="comment">// kept</span></code></pre>', "x // kept"),
        (f'<div class="elementor-widget elementor-widget-text"><div class="elementor-widget-container"><p>{PROSE}</p><p>{PROSE}</p></div></div><div><p>Other.</p></div>', f"{PROSE}\n{PROSE}\nOther."),
        (f'<div class="widget"><p>{PROSE}</p><p>{PROSE}</p></div><div class="x"><a href="/">Home</a></div>', f"{PROSE}\n{PROSE}"),
        (f'<article><p>{PROSE}</p><section id="social"><h2>Social issues</h2><p>{PROSE}</p></section><div class="share-price"><p>It rose by a tenth.</p></div></article>', f"{PROSE}\nSocial issues\n{PROSE}\nIt rose by a tenth."),
        (f'<article><p>{PROSE}</p><div class="share-buttons"><a href="/a">Tweet</a></div><div class="newsletter-signup"><h3>News</h3><p>Get it weekly.</p><form><input></form></div><div class="notice"><p>We moved.</p></div></article>', PROSE),
        (f'<div><div><p>{PROSE}</p><p>{PROSE}</p></div><p><a href="/p">Read the paper here</a></p><div><p>The end of it.</p></div></div>', f"{PROSE}\n{PROSE}\nRead the paper here\nThe end of it."),
        (f"<div><h1>T</h1><p>{PROSE}</p><h2>3 comments</h2><ul><li>Nice.</li><li>I think, it is not.</li></ul></div>", f"T\n{PROSE}"),
        (f'<table><tr><td><a href="/">Home</a></td><td><h1>T</h1><p>{PROSE}</p></td></tr></table>', f"T\n{PROSE}"),
        (f'<article><p>{PROSE}</p><table><tr><td><a href="/a">One</a></td><td>1</td></tr></table></article>', f"{PROSE}\nOne\n1"),
    ],
)
def test_main_text_is_whole(html, text):
    assert html_text.main_text(html) == text


def test_main_text_of_generated_pages():
    rng = np.random.default_rng(31)
    say = lambda n: " ".join(rng.choice(["lake", "stone,", "over", "wind", "quiet", "rivers"], n)).capitalize() + "."
    frames = ['<nav><a href="/">Home</a></nav>', "<header><h1>Site</h1><p>Slogan, of it.</p></header>", '<div class="ad-slot"><p>Buy, now, cheap, and more.</p></div>', "<aside><p>Side, by, side.</p></aside>", '<div id="sidebar"><p>About, us, here.</p></div>', '<div class="cookie-banner"><p>We use cookies, ok?</p></div>', "<form><p>Sign up, now.</p><input></form>", "<footer>&copy; us</footer>", '<section class="related-posts"><ul><li><a href="/a">One, two</a></ul></section>', "<script>if (a < b) {}</script>"]
    for _ in range(120):
        article = [(rng.choice(["p", "p", "p", "h2", "blockquote", "pre"]), say(int(rng.integers(1, 40)))) for _ in range(int(rng.integers(2, 9)))]
        blocks = [f"<{t}>{x}</{t}>" for t, x in article]
        title = say(4)
        inner = f"<h1>{title}</h1>" + "".join(b + (rng.choice(["", "", "<!-- x -->", '<div class="advert">Sale, today.</div>', "\n"])) for b in blocks)
        inner = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="page has-sidebar"><article class="post tag-ad">{}</article></div>']).replace("{}", inner)
        around = rng.permutation(frames)
        html = f"<html><body>{''.join(around[:5])}{inner}{''.join(around[5:])}</body></html>"
        assert html_text.main_text(html) == "\n".join([title, *(x for _, x in article)]), html


def test_main_text_takes_any_markup():
    rng = np.random.default_rng(32)
    parts = ["<", ">", "<![", "<!", "]]>", "<p>", "</p", "<div class='ad'>", "&#x", "&amp", "<a href=", "'", '"', "text, more", "<script>", "</script>", "<!--", "-->", "<?", "\0", "<td>", "</html>"]
    for _ in range(3000):
        assert isinstance(html_text.main_text("".join(rng.choice(parts, int(rng.integers(1, 25))))), str)


def test_extract_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "old"), (1, "u", PAGE, "old"), (None, None, "", "old")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)


def test_near_dedup_ranges_are_counted_in_little_memory():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 150_000, dtype=np.uint64)
    runs = [np.unique(rng.choice(pool, 20_000)) for _ in range(20)] + [np.zeros(0, np.uint64), pool[:1]]
    counts = [rng.integers(1, 3, len(x)) for x in runs]
    keys, at = np.unique(np.concatenate(runs), return_inverse=True)
    df = np.bincount(at, np.concatenate(counts)).astype(int)
    blobs = pa.chunked_array([pa.array([near_dedup.pack_counts(k, c) for k, c in zip(runs, counts, strict=True)], pa.binary())])
    tracemalloc.start()
    got = near_dedup.answers(blobs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for run, blob in zip(runs, got, strict=True):
        found, n = near_dedup.unpack_counts(blob)
        want = df[np.searchsorted(keys, run)]
        assert np.array_equal(found, run[want > 1]) and np.array_equal(n, want[want > 1])
    assert peak < 30 * sum(map(len, runs))  # bytes; about 70 where a whole range is sorted at once


def test_texts_come_in_small_batches_where_workers_keep_memory(spark, docs):
    for make in (langid.fit_ppm, lambda d: quality.with_features(d.select("doc_id", "text")), lambda d: packing.tokenized_pieces(d, public_tokenizers.path("word_bpe_49k.json"))):
        make(docs)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 64 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
        common.prepare(spark)


def test_audio_prints_are_not_shuffled_to_be_compared(spark):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**32, 60, dtype=np.uint32) for _ in range(30)]
    rows = [(i, sets[i % 30].tobytes()) for i in range(90)] + [(200, None), (None, sets[0].tobytes())]
    table = spark.createDataFrame(rows, "id long, prints binary").repartition(8)
    named = audio_prints.named(table, F.col("id") == 61)
    found = audio_prints.matches(named, audio_prints.merged(named))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("prints" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line or "SortMergeJoin" in line)
    # Copies in several blocks are one class, listed once.
    assert [(r.query_id, r.match_id, r.overlap) for r in found.collect()] == [(1, 1, 60)]
    assert sorted(r.class_id for r in audio_prints.links(table, F.col("id") == 61).collect() if r.class_id is not None) == sorted(i % 30 for i in range(90))
