"""Quality scores by Bradley-Terry pairwise ranking.

Documents become a few numbers on their whole text: shares of character kinds,
word and line repetition, lengths. In pairs of a preferred (label 1) and a
rejected (label 0) document the first wins with probability
sigmoid(w . (x_first - x_second)); w minimises the logistic loss on feature
differences plus a ridge. The threshold is a quantile of the training scores:
the one that separates the training labels best. Scores are shifted so that
this quantile maps to ``cut`` and squeezed into 0 to 1.

Nulls, ties, edges: a null text counts as empty; an empty text has all-zero
features and a score as any other. Equal texts get equal scores. Repeated rows
are scored one by one; a document with several labels is preferred if their
mean is at least 0.5; null labels are left out. With labels of one kind only,
or none, every score is 1. Columns named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import SMALL_BATCHES, prepare, span_hashes, stored, utf8, words

FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "space", "other_letters", "pipe", "hash_percent", "amp_dollar", "star", "exclamation", "stop_comma", "other_sign",
    "word_bytes", "long_words", "distinct_words", "repeated_next", "distinct_pairs", "distinct_lines", "signs_by_word", "upper_words",
)

_SPACE, _UPPER, _LOWER, _DIGIT, _OTHER, _PIPE, _HASH, _AMP, _STAR, _BANG, _STOP, _SIGN, _LINE = range(13)
_KINDS = np.full(256, _SIGN, np.uint8)
for _chars, _kind in ((b" \t\r\x0b\x0c", _SPACE), (b"\n", _LINE), (bytes(range(65, 91)), _UPPER), (bytes(range(97, 123)), _LOWER), (bytes(range(48, 58)), _DIGIT), (bytes(range(128, 256)), _OTHER), (b"|", _PIPE), (b"#%", _HASH), (b"&$", _AMP), (b"*", _STAR), (b"!", _BANG), (b".,", _STOP)):
    _KINDS[list(_chars)] = _kind
_INK = ~np.isin(_KINDS, [_SPACE, _LINE])
_NOT_LINE = _KINDS != _LINE


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each row."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=n)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; shares are of its bytes, words, pairs or lines."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 13 + _KINDS[data], minlength=13 * n).reshape(n, 13).astype(float)
    share = kinds / np.maximum(size, 1)[:, None]
    start, end, own = words(data, offsets, _INK)
    key = span_hashes(data, start, end)
    length = end - start
    n_words = np.bincount(own, minlength=n)
    by_word = np.maximum(n_words, 1)
    next_own = np.flatnonzero(own[1:] == own[:-1])
    pairs = np.bincount(own[next_own], minlength=n)
    l_start, l_end, l_own = words(data, offsets, _NOT_LINE)
    n_lines = np.bincount(l_own, minlength=n)
    cap = np.isin(_KINDS[data], [_UPPER])
    caps = np.concatenate(([0], np.cumsum(cap)))
    lows = np.concatenate(([0], np.cumsum(_KINDS[data] == _LOWER)))
    loud = (caps[end] - caps[start] >= 2) & (lows[end] == lows[start])
    signs = kinds[:, [_PIPE, _HASH, _AMP, _STAR, _BANG, _SIGN]].sum(1)
    out = [
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), share[:, _UPPER], share[:, _DIGIT], share[:, _SPACE], share[:, _OTHER], share[:, _PIPE], share[:, _HASH], share[:, _AMP], share[:, _STAR], share[:, _BANG], share[:, _STOP], share[:, _SIGN],
        np.bincount(own, length, n) / by_word, np.bincount(own, length > 24, n) / by_word, _distinct(own, key, n) / by_word,
        np.bincount(own[next_own], key[next_own] == key[next_own + 1], n) / np.maximum(pairs, 1),
        _distinct(own[next_own], key[next_own] * np.uint64(3) + key[next_own + 1], n) / np.maximum(pairs, 1),
        _distinct(l_own, span_hashes(data, l_start, l_end), n) / np.maximum(n_lines, 1), np.minimum(signs / by_word, 8), np.bincount(own, loud, n) / by_word,
    ]
    return np.column_stack(out)


def with_features(docs: DataFrame, text: str = "text", to: str = "features") -> DataFrame:
    """``docs`` without its text, with the text's features as an array of floats."""
    prepare(docs.sparkSession, *SMALL_BATCHES)
    rest = docs.drop(text, to)
    schema = T.StructType([*rest.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(*utf8(batch.column(batch.num_columns - 1))).astype(np.float32)
            ends = pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*batch.schema.names[:-1], to])

    return docs.select(*rest.columns, text).mapInArrow(add, schema)


@dataclass(frozen=True)
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + np.log(self.cut / (1 - self.cut)), -500, 500)))


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, cut: float = 0.3, pairs: int = 200_000, ridge: float = 1e-3, seed: int = 7) -> BradleyTerry | None:
    """Weights from ``pairs`` seeded preference pairs by Newton steps; the threshold is the quantile of the scores with the highest balanced accuracy (the lowest such, as it keeps more)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    x = x.astype(float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    gap = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(gap @ w, -30, 30)))
        gradient = gap.T @ (p - 1) / pairs + ridge * w
        move = np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / pairs + ridge * np.eye(len(w)), gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    wrong = np.cumsum(y[order] == 1) / len(good)
    right = np.cumsum(y[order] == 0) / len(bad)
    edge = np.append(raw[order][1:] != raw[order][:-1], True)
    at = int(np.argmax(np.where(edge, right - wrong, -np.inf)))
    above = raw[order][at + 1] if at + 1 < len(raw) else raw[order][at] + 1
    return BradleyTerry(mean, scale, w, float((raw[order][at] + above) / 2), cut)


def learn(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = 20_000, **fit) -> BradleyTerry | None:
    """Fit on at most about ``max_rows`` labelled rows, chosen by a hash of their key; ``labels`` holds ``key`` and ``label``."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    total = marks.count()
    kept = marks.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_rows / max(total, 1)))))
    rows = features.select(key, "features").join(kept, key).select("features", "__y").toPandas()
    if rows.empty:
        return None
    order = np.lexsort(np.stack(rows["features"].to_numpy()).T)
    return fit_bradley_terry(np.stack(rows["features"].to_numpy())[order], rows["__y"].to_numpy()[order], **fit)


def score(features: DataFrame, model: BradleyTerry | None) -> DataFrame:
    """``features`` with ``score`` (0 to 1) and ``predicted`` (1 from the cut on) in place of its array."""
    rest = features.drop("features", "score", "predicted")
    if model is None:
        return rest.withColumns({"score": F.lit(1.0), "predicted": F.lit(1)})
    terms = [F.lit(float(w)) * F.least(F.greatest((F.col("features")[i].cast("double") - F.lit(float(m))) / F.lit(float(s)), F.lit(-6.0)), F.lit(6.0)) for i, (w, m, s) in enumerate(zip(model.weight, model.mean, model.scale, strict=True))]
    raw = sum(terms[1:], terms[0]) - F.lit(model.threshold - float(np.log(model.cut / (1 - model.cut))))
    p = 1 / (1 + F.exp(-F.least(F.greatest(raw, F.lit(-500.0)), F.lit(500.0))))
    return features.withColumn("score", p).withColumn("predicted", (F.col("score") >= model.cut).cast("int")).select(*rest.columns, "score", "predicted")


def keep_good(docs: DataFrame, model: BradleyTerry | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least the model's cut."""
    prepare(docs.sparkSession, *SMALL_BATCHES)
    if model is None:
        return docs
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(*utf8(batch.column(at))).astype(np.float32)
            yield batch.filter(pa.array(model.scores(x.astype(float)) >= model.cut))

    return docs.mapInArrow(keep, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of ``documents``, learned from the labels of rows whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    features = stored(with_features(docs.select("doc_id", held.alias("held_out"), "text")), "quality")
    model = learn(features.where(~F.col("held_out")), labels)
    return score(features, model)
