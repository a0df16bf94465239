"""Repair of conversations by the cheapest edits: Viterbi in parallel chunks by rank convergence.

A conversation's roles shall be an optional system turn and pairs of user and
assistant. Its rows are kept (cost 0), given the role that is due (3) or deleted
(4; blank rows and repetitions must be), and empty turns are inserted anywhere
(3); a truncated row that stays adds 3. Four states tell what may follow; a
row's costs to the end from each state follow from the next row's.

Rows are sorted by ranges of conversation and turn, so that a long conversation
lies in many partitions, and cut into chunks of at most ``CHUNK`` rows. Each
chunk starts from a guess of the costs behind it (the last one knows them), all
chunks of a batch in step. In fix-up passes a chunk takes the first costs of the
next one; where these differ from what it used by more than a constant, it goes
back over its rows until its new costs differ from the old by a constant, which
is added to the rest. Passes end when no chunk's costs change. Tracing forward
takes at each step the ASCII-least edit that keeps to the least cost; edits
determine the states, so it finds the least audit. Chunks are traced from all
four states, the states between chunks found by chaining these, in two levels.

Identical rows of a turn are counted, not listed. Texts are moved once, to the
task that writes or hashes a conversation; it reads them in order and holds one
batch. A digest of one text is sequential by its nature.

Nulls, ties, edges: null roles and texts are one space. Rows are taken by turn,
nulls first, then by role and the text's MD5 digest. A row's first fault counts:
blank, duplicate (role and text seen earlier), truncated. A role that is neither
system, user nor assistant by its first character can't be kept; an empty role
adds nothing to the roles and can. A null key is a conversation of its own. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import prepare, stored

CHUNK = 64
GROUP = 4096  # chunks whose states are chained at a time
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Initials: 0 other, 1 s, 2 u, 3 a, 4 none.
_AFTER_KEEP = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [0, 1, 2, 3]])
_DUE = np.array([2, 2, 3, 2])
_DUE_ROLE = ("user", "user", "assistant", "user")
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_FAR = np.int64(1) << 60
_FORCED, _CUT = 8, 16


def _close(costs: np.ndarray) -> np.ndarray:
    """Costs with insertions: what is due may be inserted first."""
    user, assistant = np.minimum(costs[:, 2], INSERT + costs[:, 3]), np.minimum(costs[:, 3], INSERT + costs[:, 2])
    return np.column_stack((np.minimum(costs[:, 0], INSERT + user), np.minimum(costs[:, 1], INSERT + user), user, assistant))


def step_back(costs: np.ndarray, code: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Costs to the end before a row of each chunk, from those behind it. Copies of a row are deleted."""
    free, extra = (code & _FORCED) == 0, np.where(code & _CUT, TRUNCATED, 0)
    after = _AFTER_KEEP[code & 7]
    kept = np.where(after >= 0, np.take_along_axis(costs, after.clip(0), 1), _FAR) + (KEEP + extra)[:, None]
    stay = np.minimum(kept, costs[:, _DUE] + (REROLE + extra)[:, None])
    return _close(np.minimum(DELETE + costs, np.where(free[:, None], stay, _FAR))) + (DELETE * (copies - 1))[:, None]


def back_over(codes: np.ndarray, copies: np.ndarray, sizes: np.ndarray, ends: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
    """Costs before each row and behind the last, (chunks, rows + 1, 4), rows of a chunk at the right.

    With ``old`` costs, a chunk stops where its new ones differ from them by a
    constant, and the constant is added to the rest.
    """
    n, width = codes.shape
    costs = np.zeros((n, width + 1, 4), np.int64) if old is None else old.copy()
    costs[:, width] = ends
    active = np.ones(n, bool)
    for t in range(width - 1, -1, -1):
        now = np.flatnonzero(active & (width - t <= sizes))
        if not len(now):
            break
        new = step_back(costs[now, t + 1], codes[now, t], copies[now, t])
        if old is not None:
            gap = new - old[now, t]
            same = (gap == gap[:, :1]).all(1)
            costs[now[same], : t + 1] = old[now[same], : t + 1] + gap[same, :1, None]
            active[now[same]] = False
            now, new = now[~same], new[~same]
        costs[now, t] = new
    return costs


def trace(codes: np.ndarray, copies: np.ndarray, sizes: np.ndarray, costs: np.ndarray, states: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From ``states``, the least edits: insertions before and edit of each row, insertions at the end, the last states and the costs."""
    n, width = codes.shape
    state, paid = states.copy(), np.zeros(n, np.int64)
    inserted, edit, entered = np.zeros((n, width), np.int8), np.zeros((n, width), np.uint8), np.zeros((n, width), np.int8)
    for t in range(width):
        here = np.flatnonzero(width - t <= sizes)
        entered[here, t] = state[here]
        waiting = here
        while len(waiting):
            code, s = codes[waiting, t], state[waiting]
            now = np.take_along_axis(costs[waiting, t] - (DELETE * (copies[waiting, t] - 1))[:, None], s[:, None], 1)[:, 0]
            behind = costs[waiting, t + 1]
            at = lambda places: np.take_along_axis(behind, places[:, None], 1)[:, 0]
            extra = np.where(code & _CUT, TRUNCATED, 0)
            after = _AFTER_KEEP[code & 7, s]
            free = (code & _FORCED) == 0
            drop = at(s) + DELETE == now
            more = ~drop & (costs[waiting, t, _DUE[s]] - DELETE * (copies[waiting, t] - 1) + INSERT == now)
            keep = ~drop & ~more & free & (after >= 0) & (at(after.clip(0)) + KEEP + extra == now)
            # In ASCII order: D, I, K, R.
            edit[waiting, t] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))
            paid[waiting] += np.where(drop, DELETE, np.where(more, INSERT, extra + np.where(keep, KEEP, REROLE)))
            state[waiting] = np.where(drop, s, np.where(keep, after, _DUE[s]))
            inserted[waiting[more], t] += 1
            waiting = waiting[more]
        paid[here] += DELETE * (copies[here, t] - 1)
    close = np.where(last, _END[state] // INSERT, 0)
    return inserted, edit, entered, close, np.column_stack((np.where(close > 0, 3, state), paid + INSERT * close))


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` (key, turn, role, text) with one in twenty dropped, emptied, without marks, repeated, or set to user, by their keys."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(key), F.lit(":"), shown(turn)).cast("binary")) % 20
    said = F.when(F.col("__kind") == 1, F.lit("")).when(F.col("__kind") == 2, F.translate(shown(text), ".!?", "")).otherwise(shown(text))
    damaged = rows.select(key, turn, role, text, kind.alias("__kind")).where("__kind <> 0")
    damaged = damaged.select(key, turn, F.when(F.col("__kind") == 4, F.lit("user")).otherwise(shown(role)).alias(role), said.alias(text), F.explode(F.array_repeat(F.lit(0), F.when(F.col("__kind") == 3, 2).otherwise(1))).alias("__copy"))
    return damaged.drop("__copy")


def _plain(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and the text's ``digest``, without nulls but in turns."""
    said = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), said.alias("text"), F.md5(said.cast("binary")).alias("digest"))




def _ordered(*before: str) -> list[Column]:
    return [*map(F.col, before), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def examined(plain: DataFrame, chunk: int) -> DataFrame:
    """Distinct rows of each turn in chunks: faults, ``code`` for the search, ``copies``, ``illegal`` neighbours, ``chunk``, ``chunks`` and place ``nth``."""
    bare = F.rtrim("text", F.lit(SPACES))
    facts = plain.select("conv", "turn", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    rows = facts.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv", "role", "digest").agg(F.min(when).alias("first"))
    rows = rows.join(first, ["conv", "role", "digest"]).withColumn("again", when > F.col("first")).drop("first")
    rows = rows.repartitionByRange(*_ordered("conv")).withColumn("part", F.spark_partition_id())
    rows = stored(rows.withColumn("initial", F.left("role", F.lit(1))), "turns")
    inside = Window.partitionBy("part", "conv").orderBy(*_ordered())
    rows = rows.withColumns({"nth": F.row_number().over(inside), "before": F.lag("initial").over(inside)})
    # A conversation has one row here for each partition it reaches.
    parts = rows.groupBy("conv", "part").agg(F.ceil(F.count("*") / chunk).alias("n"), F.max_by("initial", "nth").alias("end"))
    along = Window.partitionBy("conv").orderBy("part")
    parts = parts.select("conv", "part", (F.sum("n").over(along) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("conv")).alias("chunks"), F.lag("end").over(along).alias("ahead"))
    rows = rows.join(parts, ["conv", "part"]).withColumn("before", F.coalesce("before", "ahead"))
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 1, "u", 2, "a", 3, "", 4)]), F.col("initial")), F.lit(0))
    wrong = F.coalesce(~F.concat("before", "initial").isin("su", "ua", "au"), F.lit(False)).cast("long")
    return rows.select(
        "conv", "turn", "role", "digest", "copies", (F.col("base") + F.floor((F.col("nth") - 1) / chunk)).cast("long").alias("chunk"), F.col("chunks").cast("long").alias("chunks"), "nth",
        (code + F.when(F.col("blank") | F.col("again"), _FORCED).otherwise(0) + F.when(F.col("cut"), _CUT).otherwise(0)).alias("code"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("n_blank"), F.when(F.col("blank"), 0).otherwise(F.col("copies") - (~F.col("again")).cast("long")).alias("n_duplicate"),
        (~F.col("blank") & ~F.col("again") & F.col("cut")).cast("long").alias("n_truncated"), (F.col("copies") - 1 + wrong).alias("n_illegal"),
    )


def _grid(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and copies of a batch's chunks, right-aligned, and how many rows each has."""
    rows = batch.column("rows")
    sizes = np.asarray(rows.value_lengths()).astype(np.int64)
    width = int(sizes.max(initial=0))
    flat = rows.flatten()
    place = np.arange(width) >= width - sizes[:, None]
    codes, copies = np.zeros((len(sizes), width), np.int64), np.ones((len(sizes), width), np.int64)
    codes[place], copies[place] = flat.field("code").to_numpy().astype(np.int64), flat.field("copies").to_numpy()
    return codes, copies, sizes


def _costs(batch: pa.RecordBatch, name: str, width: int, sizes: np.ndarray) -> np.ndarray:
    costs = np.zeros((len(sizes), width + 1, 4), np.int64)
    for i, size in enumerate(sizes.tolist()):
        costs[i, width - size :] = np.frombuffer(batch.column(name)[i].as_py(), np.int64).reshape(-1, 4)
    return costs


def _packed(costs: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Costs of each chunk's rows, and the first ones above their least."""
    width = costs.shape[1] - 1
    first = costs[np.arange(len(sizes)), width - sizes]
    first = first - first.min(1, keepdims=True)
    return pa.array([costs[i, width - size :].tobytes() for i, size in enumerate(sizes.tolist())], pa.binary()), pa.array([f.tobytes() for f in first], pa.binary())


def converged(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``costs`` before each row and behind the last, true up to a constant for each chunk."""
    guess = np.zeros(4, np.int64)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, copies, sizes = _grid(batch)
            last = batch.column("chunk").to_numpy() == batch.column("chunks").to_numpy() - 1
            ends = np.where(last[:, None], _END, guess)
            costs, first = _packed(back_over(codes, copies, sizes, ends), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, costs, pa.array([e.tobytes() for e in ends], pa.binary()), first], names=[*batch.schema.names, "costs", "used", "first"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, copies, sizes = _grid(batch)
            ends = np.frombuffer(b"".join(batch.column("following").to_pylist()), np.int64).reshape(-1, 4)
            costs, first = _packed(back_over(codes, copies, sizes, ends, _costs(batch, "costs", codes.shape[1], sizes)), sizes)
            kept = [batch.column(c) for c in ("conv", "chunk", "chunks", "rows")]
            yield pa.RecordBatch.from_arrays([*kept, costs, batch.column("following"), first], names=["conv", "chunk", "chunks", "rows", "costs", "used", "first"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", costs binary, used binary, first binary"
    made = stored(chunks.mapInArrow(begin, schema), "chunk-costs")
    done, now = made.where("chunks = 1"), made.where("chunks > 1")
    while True:
        following = now.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("following"))
        both = stored(now.join(following, ["conv", "chunk"], "left"), "chunk-passes")
        off = F.col("following").isNotNull() & (F.col("following") != F.col("used"))
        if both.where(off).isEmpty():
            return done.unionByName(now)
        now = both.where(~off).select(*made.columns).unionByName(both.where(off).select("conv", "chunk", "chunks", "rows", "costs", "following").mapInArrow(mend, schema))


def _entries(chunks: DataFrame) -> DataFrame:
    """The state in which each chunk of several is entered, from where each leads out of every state: ``conv``, ``chunk``, ``entry``."""

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, copies, sizes = _grid(batch)
            costs, last = _costs(batch, "costs", codes.shape[1], sizes), np.zeros(len(sizes), bool)
            outs = [trace(codes, copies, sizes, costs, np.full(len(sizes), s), last)[4][:, 0] for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(np.column_stack(outs).tolist(), pa.list_(pa.int64()))], names=["conv", "chunk", "ways"])

    def over(group: pd.DataFrame) -> list[int]:
        now = [0, 1, 2, 3]
        for ways in group["ways"]:
            now = [int(ways[s]) for s in now]
        return now

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv": group["conv"].iloc[:1], "chunk": group["group"].iloc[:1], "ways": [over(group.sort_values("chunk"))]})

    def entered(group: pd.DataFrame) -> pd.DataFrame:
        group, state, found = group.sort_values("chunk"), int(group["start"].iloc[0]), []
        for ways in group["ways"]:
            found.append(state)
            state = int(ways[state])
        return pd.DataFrame({"conv": group["conv"], "chunk": group["chunk"], "entry": found})

    maps = stored(chunks.mapInArrow(ways, "conv string, chunk long, ways array<long>").withColumn("group", F.floor(F.col("chunk") / GROUP)), "chunk-states")
    groups = maps.groupBy("conv", "group").applyInPandas(whole, "conv string, chunk long, ways array<long>").withColumn("start", F.lit(0))
    starts = groups.groupBy("conv").applyInPandas(entered, "conv string, chunk long, entry long").select("conv", F.col("chunk").alias("group"), F.col("entry").alias("start"))
    return maps.join(starts, ["conv", "group"]).groupBy("conv", "group").applyInPandas(entered, "conv string, chunk long, entry long")


def edits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each chunk of ``examined`` rows the ``audit``, its ``cost``, and ``lines``: what each row turns into."""
    item = F.struct("nth", "code", "copies", "turn", "role", "digest")
    chunks = stored(rows.groupBy("conv", "chunk", "chunks").agg(F.array_sort(F.collect_list(item)).alias("rows")), "chunks")
    ready = stored(converged(chunks).drop("used", "first"), "chunks-converged")
    several = ready.where("chunks > 1")
    known = ready.where("chunks = 1").withColumn("entry", F.lit(0).cast("long")).unionByName(several.join(_entries(several), ["conv", "chunk"]))
    line = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("ahead", pa.list_(pa.string())), ("own", pa.string()), ("behind", pa.list_(pa.string()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, copies, sizes = _grid(batch)
            width = codes.shape[1]
            last = batch.column("chunk").to_numpy() == batch.column("chunks").to_numpy() - 1
            inserted, edit, entered, close, out = trace(codes, copies, sizes, _costs(batch, "costs", width, sizes), batch.column("entry").to_numpy().astype(np.int64), last)
            audits, lines = [], []
            for i, items in enumerate(batch.column("rows").to_pylist()):
                audit, made = [], []
                for j, row in enumerate(items, width - len(items)):
                    state, ahead = int(entered[i, j]), []
                    for _ in range(inserted[i, j]):
                        ahead.append(_DUE_ROLE[state])
                        state = int(_DUE[state])
                    kind = chr(edit[i, j])
                    audit.append("I" * len(ahead) + kind + "D" * (row["copies"] - 1))
                    own = {"D": None, "K": row["role"], "R": _DUE_ROLE[state]}[kind]
                    if ahead or own is not None:
                        made.append({"turn": row["turn"], "role": row["role"], "digest": row["digest"], "ahead": ahead, "own": own, "behind": []})
                if close[i]:
                    row = items[-1]
                    if not made or (made[-1]["turn"], made[-1]["role"], made[-1]["digest"]) != (row["turn"], row["role"], row["digest"]):
                        made.append({"turn": row["turn"], "role": row["role"], "digest": row["digest"], "ahead": [], "own": None, "behind": []})
                    made[-1]["behind"] = ["user", "assistant"][2 - close[i] :]
                    audit.append("I" * int(close[i]))
                audits.append("".join(audit))
                lines.append(made)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(audits, pa.string()), pa.array(out[:, 1]), pa.array(lines, pa.list_(line))], names=["conv", "chunk", "audit", "cost", "lines"])

    line_type = "array<struct<turn: bigint, role: string, digest: string, ahead: array<string>, own: string, behind: array<string>>>"
    return stored(known.select("conv", "chunk", "chunks", "rows", "costs", "entry").mapInArrow(write, f"conv string, chunk long, audit string, cost long, lines {line_type}"), "edits")


def _stream(plain: DataFrame, made: DataFrame, digests: bool) -> DataFrame:
    """The repaired turns in order (``conv``, ``place``, ``role``, ``text``), or for each conversation the SHA-256 of its ``role:text`` lines."""
    none = F.lit(None).cast("string")
    lines = made.select("conv", F.inline("lines")).select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), none.alias("text"), "ahead", "own", "behind")
    nothing = F.lit(None).cast("array<string>")
    texts = plain.select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), "text", nothing.alias("ahead"), none.alias("own"), nothing.alias("behind"))
    both = lines.unionByName(texts).repartition("conv").sortWithinPartitions(*_ordered("conv"), "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, place, due = None, hashlib.sha256(), 0, None
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal place
            if digests:
                digest.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            else:
                out.append((conv, place, role, text))
            place += 1

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv"] != conv:
                    if digests and place:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, place, due = row["conv"], hashlib.sha256(), 0, None
                if row["kind"] == 0:
                    for role in row["ahead"]:
                        put(role, "")
                    due = row
                    if row["own"] is None:
                        for role in row["behind"]:
                            put(role, "")
                        due = None
                elif due is not None and (due["turn"], due["role"], due["digest"]) == (row["turn"], row["role"], row["digest"]):
                    put(due["own"], row["text"])
                    for role in due["behind"]:
                        put(role, "")
                    due = None
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
            out.clear()
        if digests and place:
            out.append((conv, digest.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    fields = [("conv", pa.string()), ("sha256", pa.string())] if digests else [("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    names, schema = [f[0] for f in fields], pa.schema(fields)
    return both.mapInArrow(run, "conv string, sha256 string" if digests else "conv string, place long, role string, text string")


def repaired_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The turns of all conversations after the cheapest edits: ``conv`` (the key as text), ``place`` (from 0), ``role``, ``text``."""
    prepare(rows.sparkSession)
    plain = _plain(rows, key, turn, role, text)
    return _stream(plain, edits(examined(plain, chunk), chunk), digests=False)


def reports(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """For each conversation of ``rows``: ``conv`` (the key as text), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``."""
    prepare(rows.sparkSession)
    plain = _plain(rows, key, turn, role, text)
    seen = stored(examined(plain, chunk), "examined")
    made = edits(seen, chunk)
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = seen.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).alias("gaps"), *[F.sum(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "audit")))
    audits = made.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(ordered, lambda c: c["audit"]), "").alias("audit"))
    digests = _stream(plain, made, digests=True)
    full = faults.join(audits, "conv").join(digests, "conv", "left")
    return full.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    """Damaged ``conversations``, their faults and their cheapest repair."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    convs = rows.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    full = convs.join(reports(damage(rows)), "conv", "left")
    empty = hashlib.sha256().hexdigest()
    return full.select("conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
