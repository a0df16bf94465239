"""Language ID by prediction by partial matching over bytes.

Each language has a variable-order context tree: the bytes that followed each
context of up to ``max_order`` bytes in its training sample. A byte unseen in a
context escapes to the next shorter one with probability d / (n + d) (n bytes
seen, d distinct ones), where seen bytes are excluded; beyond the empty context
all 256 bytes are alike. The statistics are frozen after training, so that the
exact code length of each byte depends on its longest known context alone. The
trees of all languages are merged into one trie of contexts with one table of
code lengths per language, and a text is scored by array look-ups.

Nulls, ties, edges: a null text, or one without letters, is ``und`` with score
0. With equal code lengths the language first by code point wins. Without
training rows every text is ``und``. Repeated rows are scored one by one; the
training sample takes equal texts of a language once. Other columns pass
through; ``lang_pred`` and ``score`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import SMALL_BATCHES, prepare, utf8

UND = "und"
_SAMPLE_BUCKETS = 1 << 20
_BLOCK = 1 << 19


@dataclass(frozen=True)
class PpmModel:
    """``step``: from a context and the byte class before it to the longer context, ``nodes`` later a closed twin. ``bits``: by language, context and byte class."""

    langs: tuple[str, ...]
    order: int
    classes: np.ndarray
    step: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row of ``data`` under each language: (rows, languages)."""
        n, width, nodes = len(offsets) - 1, self.step.shape[1], self.bits.shape[1]
        out = np.zeros((n, len(self.langs)))
        step, flat = self.step.ravel(), [b.ravel() for b in self.bits]
        symbols = self.classes[data]
        row = np.repeat(np.arange(n), np.diff(offsets))
        for lo in range(0, len(data), _BLOCK):
            hi = min(lo + _BLOCK, len(data))
            own, here = row[lo:hi], np.arange(lo, hi)
            depth = here - offsets[own]
            node = np.zeros(hi - lo, np.int32)
            for k in range(1, self.order + 1):
                before = np.where(depth >= k, symbols[np.maximum(here - k, 0)], width - 1)
                node = step[node * width + before]
            at = np.where(node >= nodes, node - nodes, node) * (width - 1) + symbols[lo:hi]
            first = own[0]
            for j, table in enumerate(flat):
                sums = np.bincount(own - first, weights=table[at])
                out[first : first + len(sums), j] += sums
        return out


def _sample(docs: DataFrame, text: str, lang: str, sample_bytes: int) -> DataFrame:
    """About ``sample_bytes`` of whole texts of each language, chosen by a hash of the text."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    total = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total"))
    share = total.select("lang", (F.lit(float(sample_bytes)) / F.greatest("total", F.lit(1)) * _SAMPLE_BUCKETS).cast("long").alias("below"))
    return rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLE_BUCKETS)) <= F.col("below")).select("lang", "text").distinct()


def _count_runs(order: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        keys = [np.zeros(0, np.int64) for _ in range(order + 1)]
        sums = [np.zeros(0, np.int64) for _ in range(order + 1)]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            names += sorted(set(langs) - set(names))
            own = np.array([names.index(x) for x in langs], np.int64)
            row = np.repeat(np.arange(len(langs)), np.diff(offsets))
            depth = np.arange(len(data)) - offsets[row]
            for k in range(order + 1):
                at = np.flatnonzero(depth >= k)
                key = own[row[at]]
                for j in range(k, -1, -1):
                    key = (key << 8) | data[at - j]
                found, n = np.unique(key, return_counts=True)
                keys[k], which = np.unique(np.concatenate((keys[k], found)), return_inverse=True)
                sums[k] = np.bincount(which, np.concatenate((sums[k], n)), len(keys[k])).astype(np.int64)
        for k in range(order + 1):
            lang = pa.DictionaryArray.from_arrays(pa.array(keys[k] >> (8 * (k + 1)), pa.int32()), pa.array(names, pa.string())).cast(pa.string()) if names else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(keys[k]), k, np.int32)), pa.array(keys[k] & ((1 << (8 * (k + 1))) - 1)), pa.array(sums[k])], names=["lang", "k", "gram", "n"])

    return counts


def fit_ppm(docs: DataFrame, text: str = "text", lang: str = "lang", max_order: int = 4, sample_bytes: int = 400_000, max_contexts: int | None = 6_000, min_count: int = 4) -> PpmModel:
    """Context trees of the labelled rows of ``docs``.

    The sample is about ``sample_bytes`` of whole texts a language (all of them
    in smaller corpora); its byte runs are counted by Spark. A tree keeps its
    ``max_contexts`` most frequent contexts of at least ``min_count`` bytes, so
    that the model has the same size for any corpus; None keeps all of those.
    """
    prepare(docs.sparkSession, *SMALL_BATCHES)
    # The sample has a fixed size: a fixed number of tasks counts it.
    grams = _sample(docs, text, lang, sample_bytes).coalesce(8).mapInArrow(_count_runs(max_order), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("lang", "k", F.shiftright("gram", 8))
    frequent = grams.withColumn("total", F.sum("n").over(whole)).where((F.col("total") >= min_count) | (F.col("k") == 0))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.desc("total"), "k", F.shiftright("gram", 8)))
    chosen = frequent if max_contexts is None else frequent.withColumn("rank", rank).where(F.col("rank") <= max_contexts)
    return build_ppm(chosen.select("lang", "k", "gram", "n").toArrow(), max_order)


def build_ppm(grams: pa.Table, max_order: int) -> PpmModel:
    """A model of counted byte runs: ``k`` context bytes, nearest last, then the byte itself, packed into ``gram``.

    With a context come all its suffixes: these are at least as frequent, and
    shorter ones rank first among equals.
    """
    names = grams["lang"].combine_chunks().dictionary_encode()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    order = np.argsort(np.array(names.dictionary.to_pylist(), object)) if len(names.dictionary) else np.zeros(0, int)
    langs = tuple(names.dictionary.to_pylist()[i] for i in order)
    own = np.argsort(order)[names.indices.to_numpy()] if langs else np.zeros(0, int)
    k, gram, n = (grams[x].to_numpy().astype(np.int64) for x in ("k", "gram", "n"))
    seen = np.unique(gram[k == 0])
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width, unseen = len(seen) + 1, 256 - len(seen)
    # A node is its length and context in one number, so that nodes are sorted by length.
    deep = 8 * max_order
    key, symbol = (k << deep) | (gram >> 8), classes[gram & 255]
    nodes = np.unique(np.append(key, 0))
    size, levels, context = len(nodes), nodes >> deep, nodes & ((1 << deep) - 1)
    shorter = np.maximum(levels - 1, 0)
    parent = np.searchsorted(nodes, (shorter << deep) | (context & ((np.int64(1) << 8 * shorter) - 1)))
    step = np.empty((2 * size, width + 1), np.int32)
    step[:size] = step[size:] = np.arange(size, 2 * size, dtype=np.int32)[:, None]
    step[parent[1:], classes[context[1:] >> 8 * shorter[1:]]] = np.arange(1, size)
    bits = np.empty((len(langs), size, width), np.float32)
    base = np.full(width, 1 / 256)
    base[0] = unseen / 256
    at_all, p, count = np.searchsorted(nodes, key), np.empty((size, width), np.float32), np.empty((size, width), np.float32)
    for i in range(len(langs)):
        count[:] = 0
        mine = own == i
        np.add.at(count, (at_all[mine], symbol[mine]), n[mine])
        for level in range(max_order + 1):
            lo, hi = np.searchsorted(levels, [level, level + 1])
            for part in range(lo, hi, 2048):
                at = slice(part, min(part + 2048, hi))
                c, below = count[at].astype(float), p[parent[at]].astype(float) if level else base[None, :]
                total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                rest = np.where(c > 0, 0, below)
                mass = rest.sum(1, keepdims=True)
                coded = np.where(c > 0, c, rest * distinct / np.where(mass > 0, mass, 1)) / np.maximum(total + distinct, 1)
                coded = np.where(mass > 0, coded, c / np.maximum(total, 1))
                p[at] = np.where(total > 0, coded, below)
        bits[i] = -np.log2(np.maximum(p, 1e-12))
        bits[i, :, 0] += np.log2(max(unseen, 1))
    return PpmModel(langs, max_order, classes, step, bits)


def predict_language(docs: DataFrame, model: PpmModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the posterior of the shortest code, all languages alike beforehand."""
    spark = prepare(docs.sparkSession, *SMALL_BATCHES)
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if not model.langs:
        return kept.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)
    letters = "__has_letters"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        names = np.array([*ppm.langs, UND], object)
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            cost = ppm.code_lengths(data, offsets)
            best = cost.argmin(1)
            gap = np.minimum((cost - cost.min(1, keepdims=True)) * np.log(2), 700)
            sure = 1 / np.exp(-gap).sum(1)
            known = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[np.where(known, best, len(ppm.langs))], pa.string()), pa.array(np.where(known, sure, 0.0))],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    marked = kept.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(score, schema)


def keep_known(docs: DataFrame, model: PpmModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``; columns as they are."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    scored = predict_language(docs.toDF(*names.values()), model, names[text])
    kept = scored.where((F.col("lang_pred") != UND) & (F.col("score") >= least)) if model.langs else scored
    return kept.select(*[F.col(v).alias(k) for k, v in names.items()])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_ppm(docs.where(~held))
    return predict_language(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
