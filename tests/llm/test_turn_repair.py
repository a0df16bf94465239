"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
SPACE = " \t\n\x0b\x0c\r"


def best_edits(rows):
    """Cost, audit and repaired lines of the cheapest edits, ASCII-least among equals, by a search in that order."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines, faults
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(heap, (cost + 3, audit + "I", at, due, (*lines, name + ":")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, due, (*lines, f"{name}:{text}")))
                to = state if role == "" else after[state].get(role[0])
                if to is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*lines, f"{role}:{text}")))
    raise AssertionError


def plain_report(rows):
    """All columns of one conversation of damaged (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    cost, audit, lines, faults = best_edits([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind:
            made = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [made] * (2 if kind == 3 else 1)
    return out


def random_rows(convs, most, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "And", "", "  \t", None, "A longer one? ", "open end", "Done.\n", "é."]
    return [(c or None, rng.choice([t, t, t, None]) if rng.random() < 0.1 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.") for c in range(convs) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize(("chunk", "most"), [(64, 12), (1, 12), (3, 40), (5, 200)])
def test_reports_equal_search(spark, chunk, most):
    rows = random_rows(40 if most < 100 else 12, most, chunk)
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    got = {r["conv"]: tuple(r)[1:] for r in tr.reports(table, chunk=chunk).collect()}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if o is None else o, " " if x is None else x) for c, t, o, x in rows if c == conv]
        assert got[str(conv) if conv else ""] == plain_report(own), own
    assert len(got) == len({r[0] for r in rows})


def test_query_equals_search(spark, tmp_path):
    rows = random_rows(60, 9, 9)
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.op11_turn_repair(spark, str(tmp_path)).collect()}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        assert got[conv] == (plain_report(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))
    assert len(got) == len({r[0] for r in rows})


def test_conversations_equal_search(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.op11_turn_repair(spark, folder).collect()}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        assert got[conv] == (plain_report(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello.", ""), (1, 1, "tool", "Result.", ""), (1, 2, "user", "Thanks.", ""), (2, 0, "system", "Be good.", ""), (2, 1, "assistant", "Hi!", ""), (3, 0, "user", " ", "")]
    got = [tuple(r) for r in tr.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv", "place").collect()]
    want = []
    for conv in (1, 2, 3):
        lines = best_edits([(r[2], r[3]) for r in rows if r[0] == conv])[2]
        want += [(str(conv), i, *line.split(":", 1)) for i, line in enumerate(lines)]
    assert got == want


def test_empty_table(spark):
    assert tr.reports(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tr.repaired_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_long_conversation_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"Turn {i}" + rng.choice([".", "", "!"]), "") for i in range(900)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = tr.reports(table, chunk=16).head()
    assert tuple(got)[1:] == plain_report([r[1:4] for r in rows])


def test_fix_up_stops_early():
    rng = np.random.default_rng(2)
    codes, copies, sizes = rng.integers(1, 4, (30, 200)), np.ones((30, 200), np.int64), np.full(30, 200)
    true = tr.back_over(codes, copies, sizes, np.tile(np.array([9, 2, 0, 7]), (30, 1)))
    guess = tr.back_over(codes, copies, sizes, np.zeros((30, 4), np.int64))
    stitched = tr.back_over(codes, copies, sizes, np.tile(np.array([9, 2, 0, 7]), (30, 1)), guess)
    assert (stitched == true).all()
    gap = true - guess
    assert ((gap == gap[:, :, :1]).all(2)[:, 150]).all()
