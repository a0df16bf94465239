"""Retrieval, classification and text scoring, each with the same query in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import text as tx
from treeloom.operators import evaluation as ev
from treeloom.operators import reports
from treeloom.operators import vectors as vec
from treeloom.plans.common import Queries
from treeloom.sources.tables import kept, select_rows, table

found = Queries()

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _terms_sql(source: str, bigrams: str = "both") -> str:
    """Words and pairs of words of ``source`` (side, id, text): rows of term and tf."""
    single = "SELECT side, id, w AS term FROM words" if bigrams != "only" else ""
    double = "SELECT side, id, w || ' ' || w2 AS term FROM paired WHERE w2 IS NOT NULL" if bigrams != "no" else ""
    union = " UNION ALL ".join(x for x in (single, double) if x)
    return f"""texts AS (SELECT side, id, {_WORDS} AS ws FROM {source}), words AS (SELECT side, id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS p FROM texts),
paired AS (SELECT side, id, w, lead(w) OVER (PARTITION BY side, id ORDER BY p) AS w2 FROM words), tf AS (SELECT side, id, term, count(*) AS tf FROM ({union}) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM {source}), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _weights_sql(tf: str = "tf") -> str:
    return f"weights AS (SELECT side, id, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), total), norms AS (SELECT side, id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL)"


_BOTH_SIDES = "both_sides AS (SELECT 'q' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 't', doc_id, text FROM documents)"
_TOPK = """dots AS (SELECT a.id AS query_id, b.id AS doc_id, sum(a.w * b.w) AS dot FROM weights a JOIN weights b ON a.term = b.term WHERE a.side = 'q' AND b.side = 't' GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(dot / (a.norm * b.norm), 6) AS score FROM dots JOIN norms a ON a.side = 'q' AND a.id = query_id JOIN norms b ON b.side = 't' AND b.id = doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS best_rank FROM scored)
SELECT query_id, doc_id, score, rank, best_rank FROM ranked WHERE rank <= 5"""


def _weights(texts: DataFrame, keys: list[str], sizes: tuple[int, ...], sublinear: bool = False) -> DataFrame:
    """TF-IDF weights of ``text``. Terms are counted once and weighed once: both tables are read for several ends."""
    counts = kept(vec.term_counts(texts, keys, F.col("text"), sizes), "terms")
    return kept(vec.tfidf(counts, texts.agg(F.count("*").alias("n")), keys, sublinear), "weights")


def _benchmark_top(spark: SparkSession, folder: str, sizes: tuple[int, ...], sublinear: bool) -> DataFrame:
    """The five nearest documents of each benchmark item; their ids are made different, as both count from 0."""
    items, docs = table(spark, folder, "benchmark"), table(spark, folder, "documents")
    side = lambda rows, key, asks: rows.select((F.col(key) * 2 + int(asks)).alias("id"), "text", F.lit(asks).alias("query"), F.lit(not asks).alias("target"))
    best = vec.sparse_top_k(vec.sparse_blocks(side(items, "item_id", True).unionByName(side(docs, "doc_id", False)), sizes, sublinear), 5)
    return best.select(F.expr("query_id div 2").alias("query_id"), F.expr("target_id div 2").alias("doc_id"), "score", "rank", "best_rank")


@found.add(f"WITH {_BOTH_SIDES}, {_terms_sql('both_sides')}, {_weights_sql()}, {_TOPK}")
def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest documents of each benchmark item by TF-IDF cosine over words and pairs of words."""
    return _benchmark_top(spark, folder, (1, 2), False)


@found.add(f"WITH {_BOTH_SIDES}, {_terms_sql('both_sides', 'no')}, {_weights_sql('(1 + ln(tf))')}, {_TOPK}")
def tfidf_sublinear(spark: SparkSession, folder: str) -> DataFrame:
    """The same over single words with damped term frequencies."""
    return _benchmark_top(spark, folder, (1,), True)


_DOCS_SIDES = "both_sides AS (SELECT CASE WHEN doc_id % 100 = 0 THEN 'q' ELSE 't' END AS side, doc_id AS id, text FROM documents)"
_SEARCH = """scored AS (SELECT a.id AS query_id, b.id AS target_id, round(sum(a.w * b.w) / (max(na.norm) * max(nb.norm)), 6) AS score FROM weights a JOIN weights b ON a.term = b.term AND a.id <> b.id
  JOIN norms na ON na.side = a.side AND na.id = a.id JOIN norms nb ON nb.side = b.side AND nb.id = b.id WHERE a.side = 'q' GROUP BY a.id, b.id)"""


def _search(spark: SparkSession, folder: str) -> vec.SparseBlocks:
    """Pairs of words of all documents as blocks; those whose id is divisible by 100 are queries."""
    docs = table(spark, folder, "documents")
    return vec.sparse_blocks(docs.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 100 == 0).alias("query"), F.lit(True).alias("target")), (2,))


@found.add(f"""WITH {_DOCS_SIDES}, {_terms_sql('both_sides', 'only')}, {_weights_sql()}, {_SEARCH},
pos AS (SELECT a.doc_id AS query_id, a.doc_id + 1 AS pos_id, a.lang, s.score FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN scored s ON s.query_id = a.doc_id AND s.target_id = a.doc_id + 1 WHERE a.doc_id % 100 = 0),
ranks AS (SELECT p.query_id, p.lang, CASE WHEN max(p.score) IS NULL THEN max(n) ELSE 1 + count(*) FILTER (WHERE s.score > p.score OR (s.score = p.score AND s.target_id < p.pos_id)) END AS rank,
  CASE WHEN max(p.score) IS NULL THEN max(n) ELSE 1 + count(*) FILTER (WHERE s.score > p.score) END AS best_rank FROM pos p CROSS JOIN total LEFT JOIN scored s USING (query_id) GROUP BY p.query_id, p.lang),
long AS (SELECT lang, 'by_id' AS ties, rank FROM ranks UNION ALL SELECT lang, 'shared', best_rank FROM ranks)
SELECT lang, ties, count(*) AS sample_count, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5,
  round(avg(rank), 6) AS mean_positive_rank, list_sort(list(rank))[count(*) // 2 + 1] AS median_positive_rank FROM long GROUP BY lang, ties""")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """How well a search finds the following document, with ties broken by id and shared."""
    docs = table(spark, folder, "documents")
    total = docs.count()
    follow = docs.select((F.col("doc_id") - 1).alias("query_id"))
    pos = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "lang").join(follow, "query_id").withColumn("target_id", F.col("query_id") + 1)
    ranks = kept(vec.sparse_ranks(_search(spark, folder), pos.select("query_id", "target_id"), total).join(pos.select("query_id", "lang"), "query_id"), "ranks")
    long = ranks.select("lang", F.explode(F.array(F.struct(F.lit("by_id").alias("ties"), "rank"), F.struct(F.lit("shared").alias("ties"), F.col("best_rank").alias("rank")))).alias("x")).select("lang", "x.*")
    return ev.retrieval_metrics(long, ["lang", "ties"], "rank")


@found.add(f"""WITH {_DOCS_SIDES}, {_terms_sql('both_sides', 'only')}, {_weights_sql()}, {_SEARCH},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS nth FROM scored)
SELECT query_id, target_id, score, d.lang AS predicted, q.lang = d.lang AS right_lang FROM best JOIN documents d ON d.doc_id = target_id JOIN documents q ON q.doc_id = query_id WHERE nth = 1""")
def knn_transfer(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each query's nearest document, transferred to the query."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    best = vec.sparse_top_k(_search(spark, folder), 1, skip_own=True)
    named = best.join(docs.select(F.col("doc_id").alias("target_id"), F.col("lang").alias("predicted")), "target_id").join(docs.select(F.col("doc_id").alias("query_id"), "lang"), "query_id")
    return named.select("query_id", "target_id", "score", "predicted", (F.col("lang") == F.col("predicted")).alias("right_lang"))


_PAIRS_SQL = """talk AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text FROM conversations), aligned AS (SELECT l.id AS pair_id, l.text AS left_text, r.text AS right_text FROM talk l JOIN talk r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1)"""
_EXAMPLES_SQL = f"""{_PAIRS_SQL}, shifted AS (SELECT pair_id, coalesce(lead(pair_id) OVER (ORDER BY pair_id), first(pair_id) OVER (ORDER BY pair_id)) AS other FROM aligned),
both_sides AS (SELECT 'l' AS side, pair_id AS id, left_text AS text FROM aligned UNION ALL SELECT 'r', pair_id, right_text FROM aligned), {_terms_sql('both_sides', 'no')}, {_weights_sql()},
examples AS (SELECT pair_id, pair_id AS other, 1 AS label FROM aligned UNION ALL SELECT pair_id, other, 0 FROM shifted),
dots AS (SELECT e.pair_id, e.other, e.label, sum(a.w * b.w) AS dot FROM examples e JOIN weights a ON a.side = 'l' AND a.id = e.pair_id JOIN weights b ON b.side = 'r' AND b.id = e.other AND b.term = a.term GROUP BY ALL),
scored AS (SELECT e.pair_id, e.other, e.label, round(coalesce(dot / (na.norm * nb.norm), 0), 6) AS score FROM examples e LEFT JOIN dots d ON d.pair_id = e.pair_id AND d.other = e.other AND d.label = e.label
  LEFT JOIN norms na ON na.side = 'l' AND na.id = e.pair_id LEFT JOIN norms nb ON nb.side = 'r' AND nb.id = e.other)"""


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn beside the next one of its conversation."""
    talk = table(spark, folder, "conversations")
    left = talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", "turn", F.col("text").alias("left_text"), F.col("role").alias("role"))
    right = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right_text"))
    return left.join(right, ["conv_id", "turn"]).select("pair_id", "role", "left_text", "right_text")


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    """Aligned pairs as positives, pairs with the next pair's reply as negatives, with their cosine: only the terms of a pair meet, never all pairs."""
    pairs = _aligned(spark, folder)
    sides = pairs.select(F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left_text").alias("text")), F.struct(F.lit("r").alias("side"), F.col("right_text").alias("text")))).alias("x"), F.col("pair_id").alias("id")).select("x.*", "id")
    weights = _weights(sides, ["side", "id"], (1,))
    shifted = ev.next_in_order(pairs.select("pair_id"), "pair_id")
    examples = pairs.select("pair_id", F.col("pair_id").alias("other"), F.lit(1).alias("label")).unionByName(shifted.select("pair_id", F.col("next").alias("other"), F.lit(0).alias("label")))
    a = weights.where("side = 'l'").select(F.col("id").alias("pair_id"), "term", F.col("weight").alias("wa"))
    b = weights.where("side = 'r'").select(F.col("id").alias("other"), "term", F.col("weight").alias("wb"))
    dots = examples.join(a, "pair_id").join(b, ["other", "term"]).groupBy("pair_id", "other", "label").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na = a.groupBy("pair_id").agg(F.sqrt(F.sum(F.col("wa") * F.col("wa"))).alias("na"))
    nb = b.groupBy("other").agg(F.sqrt(F.sum(F.col("wb") * F.col("wb"))).alias("nb"))
    scored = examples.join(dots, ["pair_id", "other", "label"], "left").join(na, "pair_id", "left").join(nb, "other", "left")
    return scored.select("pair_id", "other", "label", F.round(F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0)), 6).alias("score"))


@found.add(f"WITH {_EXAMPLES_SQL} SELECT * FROM scored")
def aligned_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _examples(spark, folder)


@found.add(f"""WITH {_EXAMPLES_SQL}, split AS (SELECT *, ('0x' || substr(md5(pair_id || '|' || label), 1, 8))::BIGINT / 4294967296.0 < 0.7 AS calibration FROM scored),
points AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM split WHERE calibration GROUP BY score),
j AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / sum(p) OVER () - sum(n) OVER (ORDER BY score DESC) / sum(n) OVER () AS j FROM points),
cut AS (SELECT arg_max(score, (j, score)) AS threshold FROM j),
test AS (SELECT label, score, score >= threshold AS hit, threshold FROM split, cut WHERE NOT calibration),
c AS (SELECT any_value(threshold) AS threshold, count(*) FILTER (WHERE hit AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE hit AND label = 0)::DOUBLE AS fp, count(*) FILTER (WHERE NOT hit AND label = 1)::DOUBLE AS fn, count(*) FILTER (WHERE NOT hit AND label = 0)::DOUBLE AS tn FROM test),
at_score AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM test GROUP BY score),
run AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(n) OVER (ORDER BY score) - n AS below, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM at_score),
r AS (SELECT round(sum(p * (below + n / 2.0)) / (max(np) * max(nn)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / max(np), 6) AS average_precision FROM run)
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, roc_auc, average_precision FROM c, r""")
def clone_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A threshold chosen on seven tenths of the examples, tested on the rest."""
    part = F.conv(F.substring(F.md5(F.concat(F.col("pair_id").cast("string"), F.lit("|"), F.col("label").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = kept(_examples(spark, folder).withColumns({"calibration": part < 0.7, "all_rows": F.lit(1)}), "examples")  # read for the threshold, the counts and the curves
    cut = ev.youden_threshold(rows.where("calibration"), ["all_rows"])
    cut = kept(cut, "threshold")
    test = kept(rows.where("NOT calibration").join(F.broadcast(cut), "all_rows"), "test")  # one row
    return ev.binary_metrics(test, ["all_rows"], F.col("score") >= F.col("threshold")).join(ev.ranking_metrics(test, ["all_rows"]), "all_rows").join(cut, "all_rows").drop("all_rows")


@found.add(f"""WITH texts AS (SELECT doc_id, {_WORDS} AS ws FROM documents), words AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS p FROM texts),
grams AS (SELECT doc_id, w || '_' || w2 AS g, count(*) AS n FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS w2 FROM words) WHERE w2 IS NOT NULL GROUP BY ALL),
size AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM grams GROUP BY doc_id), dots AS (SELECT a.doc_id, sum(a.n * b.n) AS dot FROM grams a JOIN grams b ON b.doc_id = a.doc_id + 1 AND a.g = b.g GROUP BY a.doc_id)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(CASE WHEN na.norm IS NULL AND nb.norm IS NULL THEN 1.0 WHEN na.norm IS NULL OR nb.norm IS NULL THEN 0.0 ELSE coalesce(dot, 0) / (na.norm * nb.norm) END, 6) AS ngram_cosine
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN size na ON na.doc_id = a.doc_id LEFT JOIN size nb ON nb.doc_id = b.doc_id LEFT JOIN dots d ON d.doc_id = a.doc_id""")
def ngram_cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the word-pair counts of each document and the next one: 1 if both have none, 0 if one has. A pair is one row, of hashes."""
    grams = table(spark, folder, "documents").select("doc_id", vec.hashed_terms(F.col("text"), (2,)).alias("a"))
    pairs = grams.join(grams.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    found = vec.pair_cosines(pairs, "doc_id", "a", "b")
    return found.select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"), F.round("cosine", 6).alias("ngram_cosine"))


_BAGS_SQL = f"""{_PAIRS_SQL}, sides AS (SELECT pair_id, regexp_extract_all(lower(left_text), '[\\p{{L}}\\p{{N}}_]+') AS r, regexp_extract_all(lower(right_text), '[\\p{{L}}\\p{{N}}_]+') AS h FROM aligned)"""


@found.add(f"""WITH {_BAGS_SQL}, a AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(r) AS w FROM sides) GROUP BY ALL), b AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(h) AS w FROM sides) GROUP BY ALL),
shared AS (SELECT pair_id, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (pair_id, w) GROUP BY pair_id)
SELECT pair_id, round(coalesce(2.0 * shared / nullif(len(r) + len(h), 0), 0), 6) AS rouge1, CASE WHEN r = h THEN 1 ELSE 0 END AS exact FROM sides LEFT JOIN shared USING (pair_id)""")
def rouge1(spark: SparkSession, folder: str) -> DataFrame:
    """Word overlap and equality of each turn and the next one."""
    return ev.rouge1(_aligned(spark, folder), "pair_id", "left_text", "right_text")


@found.add(f"""WITH {_BAGS_SQL}, roles AS (SELECT conv_id * 1000 + turn AS pair_id, role FROM conversations),
lens AS (SELECT role, sum(len(r)) AS ref_len, sum(len(h)) AS hyp_len FROM sides JOIN roles USING (pair_id) GROUP BY role),
rw AS (SELECT pair_id, unnest(r) AS w, unnest(generate_series(1, len(r))) AS p FROM sides), hw AS (SELECT pair_id, unnest(h) AS w, unnest(generate_series(1, len(h))) AS p FROM sides),
rg AS (SELECT pair_id, n, array_to_string(list(w) OVER (PARTITION BY pair_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)[1:n], '_') AS g, count(*) OVER (PARTITION BY pair_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS have FROM rw, (SELECT unnest([1, 2, 3, 4]) AS n)),
hg AS (SELECT pair_id, n, array_to_string(list(w) OVER (PARTITION BY pair_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)[1:n], '_') AS g, count(*) OVER (PARTITION BY pair_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS have FROM hw, (SELECT unnest([1, 2, 3, 4]) AS n)),
a AS (SELECT pair_id, n, g, count(*) AS c FROM hg WHERE have >= n GROUP BY ALL), b AS (SELECT pair_id, n, g, count(*) AS c FROM rg WHERE have >= n GROUP BY ALL),
hits AS (SELECT role, n, sum(least(a.c, coalesce(b.c, 0))) AS hits, sum(a.c) AS total FROM a LEFT JOIN b USING (pair_id, n, g) JOIN roles USING (pair_id) GROUP BY role, n),
grid AS (SELECT role, n, hyp_len, ref_len, coalesce(hits, 0) AS hits, coalesce(total, 0) AS total FROM lens CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) LEFT JOIN hits USING (role, n)),
p AS (SELECT *, (CASE WHEN hits > 0 THEN hits::DOUBLE WHEN hyp_len > 1 THEN 1 / (pow(2.0, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY role ORDER BY n)) * 5 / ln(hyp_len)) ELSE 0 END) / greatest(total, 1) AS p FROM grid)
SELECT role, round(CASE WHEN min(p) > 0 THEN 100 * CASE WHEN max(hyp_len) >= max(ref_len) THEN 1.0 ELSE exp(1 - max(ref_len) / max(hyp_len)) END * exp(avg(ln(p))) ELSE 0 END, 6) AS bleu, max(hyp_len)::BIGINT AS hyp_len, max(ref_len)::BIGINT AS ref_len FROM p GROUP BY role""")
def bleu_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus BLEU of the turns against the ones before, by the role of the first."""
    return ev.bleu(_aligned(spark, folder), "pair_id", "left_text", "right_text", ["role"])


@found.add()
def sequence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-L and METEOR of each turn and the next one."""
    return ev.sequence_scores(_aligned(spark, folder), "pair_id", "left_text", "right_text")


@found.add("""
WITH q AS (SELECT vec_id AS query_id, embedding AS x FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id AS id, list_cosine_similarity(list_transform(x, lambda v: v::DOUBLE), list_transform(embedding, lambda v: v::DOUBLE)) AS score FROM q, embeddings WHERE vec_id <> query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5""")
def embedding_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of those whose id is divisible by 100."""
    return vec.dense_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 5, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@found.add("""
SELECT a.label, count(*) AS n_pairs, round(avg(list_cosine_similarity(list_transform(a.embedding, lambda v: v::DOUBLE), list_transform(b.embedding, lambda v: v::DOUBLE))), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""")
def embedding_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Mean cosine of each vector and the next one, by label."""
    rows = table(spark, folder, "embeddings")
    pairs = rows.select("vec_id", "label", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.groupBy("label").agg(F.count("*").alias("n_pairs"), F.round(F.avg(vec.dense_cosine(F.col("a"), F.col("b"))), 6).alias("mean_cosine"))




_AVERAGE_RANK = "rank() OVER (PARTITION BY task ORDER BY {v}) + (count(*) OVER (PARTITION BY task, {v}) - 1) / 2.0"
_TRAIN = "('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT % 10 < 7"


@found.add(f"""WITH texts AS (SELECT doc_id, {_TRAIN} AS train, {_WORDS} AS ws FROM documents), words AS (SELECT doc_id, train, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS p FROM texts),
paired AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS w2 FROM words), grams AS (SELECT doc_id, train, w AS term FROM words UNION ALL SELECT doc_id, train, w || ' ' || w2 FROM paired WHERE w2 IS NOT NULL),
tf AS (SELECT doc_id, train, term, count(*) AS tf FROM grams GROUP BY ALL), known AS (SELECT term, count(*) AS df FROM tf WHERE train GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
model AS (SELECT term, ln((1 + (SELECT count(*) FILTER ({_TRAIN}) FROM documents)) / (1 + df)) + 1 AS idf FROM known)
SELECT doc_id, count(idf) AS n_terms, count(*) - count(idf) AS n_unseen, round(sum((1 + ln(tf)) * idf), 4) AS weight, round(sqrt(sum(pow((1 + ln(tf)) * idf, 2))), 4) AS norm FROM tf LEFT JOIN model USING (term) WHERE NOT train GROUP BY doc_id""")
def tfidf_fitted(spark: SparkSession, folder: str) -> DataFrame:
    """Documents weighed by a model of the 5000 most frequent words and pairs of words of seven tenths of the others."""
    docs = table(spark, folder, "documents").select("doc_id", "text", (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("long") % 10 < 7).alias("train"))
    counts = kept(vec.term_counts(docs, ["doc_id", "train"], F.col("text"), (1, 2)), "terms")
    model = kept(vec.fit_tfidf(counts.where("train"), docs.agg(F.count_if("train").alias("n")), 5000), "tfidf-model")
    test = counts.where("NOT train")
    weights = vec.transform_tfidf(test, model, ["doc_id"], sublinear=True).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("weight"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    full = test.groupBy("doc_id").agg(F.count("*").alias("n")).join(weights, "doc_id", "left")
    return full.select("doc_id", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), (F.col("n") - F.coalesce("n_terms", F.lit(0))).alias("n_unseen"), F.round("weight", 4).alias("weight"), F.round("norm", 4).alias("norm"))


@found.add("""
WITH hashed AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS nth, count(*) OVER (PARTITION BY lang) AS n FROM hashed)
SELECT doc_id, lang, nth <= floor(n * 0.7 + 0.5) AS calibration FROM placed""")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """Seven tenths of the documents of each language, exactly, and the rest."""
    return ev.stratified_split(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.7)


@found.add()
def rouge_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of stems of each turn and the next one, and of their longest common subsequence."""
    return ev.rouge_stemmed(_aligned(spark, folder), "pair_id", "left_text", "right_text")


@found.add(f"""WITH {_BAGS_SQL}, orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
rw AS (SELECT pair_id, n, list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], '_')) AS g, list_transform(generate_series(1, len(h) - n + 1), lambda i: array_to_string(h[i:i + n - 1], '_')) AS hg, len(r) AS m_r, len(h) AS m_h FROM sides, orders),
a AS (SELECT pair_id, n, g, count(*) AS c FROM (SELECT pair_id, n, unnest(hg) AS g FROM rw) GROUP BY ALL), b AS (SELECT pair_id, n, g, count(*) AS c FROM (SELECT pair_id, n, unnest(g) AS g FROM rw) GROUP BY ALL),
hits AS (SELECT pair_id, n, sum(least(a.c, b.c)) AS hits FROM a JOIN b USING (pair_id, n, g) GROUP BY ALL),
p AS (SELECT pair_id, n, m_r, m_h, coalesce(hits, 0) AS hits, (CASE WHEN coalesce(hits, 0) > 0 THEN hits ELSE 0.1 END)::DOUBLE / greatest(len(hg), 1) AS p FROM rw LEFT JOIN hits USING (pair_id, n))
SELECT pair_id, round(CASE WHEN max(hits) FILTER (n = 1) = 0 THEN 0.0 ELSE CASE WHEN max(m_h) > max(m_r) THEN 1.0 ELSE exp(1 - max(m_r) / max(m_h)) END * exp(avg(ln(p))) END, 6) AS sentence_bleu FROM p GROUP BY pair_id""")
def sentence_bleu(spark: SparkSession, folder: str) -> DataFrame:
    """BLEU of each turn and the next one, smoothed."""
    return ev.sentence_bleu(_aligned(spark, folder), "pair_id", "left_text", "right_text")


@found.add(f"""WITH {_BAGS_SQL}, roles AS (SELECT conv_id * 1000 + turn AS pair_id, role FROM conversations), filled AS (SELECT pair_id, role, r, h FROM sides JOIN aligned USING (pair_id) JOIN roles USING (pair_id) WHERE trim(left_text) <> '' AND trim(right_text) <> ''),
a AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(r) AS w FROM filled) GROUP BY ALL), b AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(h) AS w FROM filled) GROUP BY ALL), shared AS (SELECT pair_id, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (pair_id, w) GROUP BY pair_id),
each AS (SELECT role, round(coalesce(2.0 * shared / nullif(len(r) + len(h), 0), 0), 6) AS rouge1, CASE WHEN r = h THEN 1 ELSE 0 END AS exact FROM filled LEFT JOIN shared USING (pair_id)),
by_role AS (SELECT 'conversations' AS dataset, role, count(*) AS evaluated_count, round(100 * avg(rouge1), 4) AS rouge1, round(100 * avg(exact), 4) AS exact_match FROM each GROUP BY role),
with_all AS (SELECT * FROM by_role UNION ALL SELECT dataset, 'ALL', sum(evaluated_count)::BIGINT, round(avg(rouge1), 4), round(avg(exact_match), 4) FROM by_role GROUP BY dataset)
SELECT dataset, role AS part, 'row' AS kind, evaluated_count, rouge1, exact_match FROM with_all UNION ALL SELECT dataset, 'view', 'with ALL', sum(evaluated_count)::BIGINT, round(avg(rouge1), 4), round(avg(exact_match), 4) FROM with_all GROUP BY dataset
UNION ALL SELECT dataset, 'view', 'without ALL', sum(evaluated_count)::BIGINT, round(avg(rouge1), 4), round(avg(exact_match), 4) FROM with_all WHERE role <> 'ALL' GROUP BY dataset""")
def summary_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Word overlap and equality of non-empty pairs by role, with the row of all, and the view over these rows with and without it."""
    pairs = _aligned(spark, folder).where((F.trim("left_text") != "") & (F.trim("right_text") != ""))
    each = ev.rouge1(pairs, "pair_id", "left_text", "right_text").join(pairs.select("pair_id", "role"), "pair_id")
    means = lambda rows, n: rows.agg(n.alias("evaluated_count"), F.round(F.avg("rouge1"), 4).alias("rouge1"), F.round(F.avg("exact_match"), 4).alias("exact_match"))
    by_role = each.groupBy(F.lit("conversations").alias("dataset"), F.col("role").alias("part")).agg(F.count("*").alias("evaluated_count"), F.round(100 * F.avg("rouge1"), 4).alias("rouge1"), F.round(100 * F.avg("exact"), 4).alias("exact_match"))
    by_role = kept(by_role, "by-role")
    rows = by_role.unionByName(means(by_role.groupBy("dataset"), F.sum("evaluated_count")).withColumn("part", F.lit("ALL"))).withColumn("kind", F.lit("row"))
    view = lambda r, kind: means(r.groupBy("dataset"), F.sum("evaluated_count")).withColumns({"part": F.lit("view"), "kind": F.lit(kind)})
    return rows.unionByName(view(rows, "with ALL")).unionByName(view(rows.where("part <> 'ALL'"), "without ALL"))


@found.add(f"""WITH {_DOCS_SIDES}, {_terms_sql('both_sides', 'only')}, {_weights_sql()}, {_SEARCH},
pos AS (SELECT a.doc_id AS query_id, a.doc_id + 1 AS pos_id, a.lang, s.score FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN scored s ON s.query_id = a.doc_id AND s.target_id = a.doc_id + 1 WHERE a.doc_id % 100 = 0),
ranks AS (SELECT p.query_id, p.lang, CASE WHEN max(p.score) IS NULL THEN max(n) ELSE 1 + count(*) FILTER (WHERE s.score > p.score) END AS best_rank FROM pos p CROSS JOIN total LEFT JOIN scored s USING (query_id) GROUP BY p.query_id, p.lang),
size AS (SELECT doc_id, length(text)::DOUBLE AS n FROM documents), pairs AS (SELECT lang, 1.0 / best_rank AS y, round(least(a.n, b.n) / greatest(a.n, b.n), 6) AS x FROM ranks JOIN size a ON a.doc_id = query_id JOIN size b ON b.doc_id = query_id + 1),
both_tasks AS (SELECT lang AS task, x, y FROM pairs UNION ALL SELECT 'ALL:size_ratio', x, y FROM pairs), ranked AS (SELECT *, {_AVERAGE_RANK.format(v='x')} AS rx, {_AVERAGE_RANK.format(v='y')} AS ry FROM both_tasks)
SELECT task, count(*) AS n, round(CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END, 6) AS pearson_r, round(CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END, 6) AS spearman_r FROM ranked GROUP BY task""")
def retrieval_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """How the reciprocal rank of a document's follower goes with the ratio of their sizes, by language and pooled."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    size = docs.select("doc_id", F.length("text").cast("double").alias("n"))
    pairs = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "lang", F.length("text").cast("double").alias("m")).join(size.select((F.col("doc_id") - 1).alias("query_id"), "n"), "query_id")
    pairs = kept(pairs.withColumn("target_id", F.col("query_id") + 1), "positive-pairs")
    ranks = vec.sparse_ranks(_search(spark, folder), pairs.select("query_id", "target_id"), table(spark, folder, "documents").count())
    x = F.round(F.least("m", "n") / F.greatest("m", "n"), 6)
    rows = kept(pairs.join(ranks, "query_id").select(F.explode(F.array("lang", F.lit("ALL:size_ratio"))).alias("task"), x.alias("x"), (1 / F.col("best_rank")).alias("y")), "rank-pairs")
    return reports.correlations(rows, ["task"], "x", "y")


_STOPWORDS = ("and", "the", "of", "de", "la", "und", "die")


@found.add(rf"""WITH cut AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in _STOPWORDS)})) AS ws FROM benchmark),
grams AS (SELECT item_id, unnest(list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 2], '_'))) AS gram FROM cut) SELECT gram, count(*) AS n, count(DISTINCT item_id) AS items FROM grams GROUP BY gram""")
def preprocessed_grams(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of three words of the benchmark's items, without stop words."""
    grams = table(spark, folder, "benchmark").select("item_id", F.explode(tx.preprocessed(F.col("text"), _STOPWORDS, 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))


@found.add("""
WITH named AS (SELECT doc_id, source, CASE WHEN lower(lang) IN ('de', 'deu', 'german') THEN 'de' WHEN lower(lang) IN ('fr', 'fra', 'french') THEN 'fr' ELSE lower(lang) END AS language FROM documents WHERE n_chars > 200 AND NOT coalesce(lower(lang) IN ('es'), false))
SELECT language, source, count(*) AS n_docs, min(doc_id) AS first_id FROM named GROUP BY ALL""")
def selected_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a permitted table by a predicate, without some languages, whose names count in all their spellings."""
    rows = select_rows(spark, folder, "documents", where="n_chars > 200", without={"lang": ["ES"]})
    low = F.lower("lang")
    language = F.when(low.isin("de", "deu", "german"), "de").when(low.isin("fr", "fra", "french"), "fr").otherwise(low)
    return rows.groupBy(language.alias("language"), "source").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"))


@found.add(f"""WITH {_DOCS_SIDES}, {_terms_sql('both_sides', 'only')}, {_weights_sql()}, {_SEARCH},
best AS (SELECT s.query_id, q.lang AS language1, t.lang AS language2, s.score, s.target_id, row_number() OVER (PARTITION BY s.query_id, t.lang ORDER BY s.score DESC, s.target_id) AS nth FROM scored s JOIN documents q ON q.doc_id = s.query_id JOIN documents t ON t.doc_id = s.target_id WHERE q.lang <> t.lang)
SELECT language1, language2, count(*) AS sample_count, round(avg(score), 6) AS mean_score, max(score) AS max_score, min(target_id) AS first_target FROM best WHERE nth = 1 GROUP BY ALL""")
def directed_language_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest document in each other language, by ordered pair of languages."""
    docs = table(spark, folder, "documents").where("lang IS NOT NULL OR text IS NOT NULL")
    texts = docs.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 100 == 0).alias("query"), F.lit(True).alias("target"), "lang")
    best = vec.sparse_top_k(vec.sparse_blocks(texts, (2,), part="lang"), 1, skip_own=True, parts=True)
    named = best.join(docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("language1")), "query_id").where("part <> language1 AND part <> ''")
    return named.groupBy("language1", F.col("part").alias("language2")).agg(F.count("*").alias("sample_count"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"), F.min("target_id").alias("first_target"))
