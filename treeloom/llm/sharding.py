"""Sharding by extendible hashing.

A shard is a prefix of the bits of a document's hash. Starting from the empty
prefix, only shards above the byte limit split on their next bit, until each
fits. Since a prefix never holds more than its own prefixes do, a document's
shard is its shortest prefix within the limit; byte counts by prefix find it
without a text, and each row takes its text along to its shard. Documents that share all ``MAX_BITS`` bits (equal keys)
can't be split by hashing: they fill overflow parts of their shard in turn, a
document above the limit being a part alone.

Nulls, ties, edges: a null key is hashed as an empty string; a null text has 0
bytes. Rows of equal
keys are dealt to overflow parts by their place in the input. An empty table
gives no rows. Columns named as an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import stored

MAX_BITS = 60
_STEP = 10
SALTS = 1024


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 digest of ``key`` as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, MAX_BITS - depth)


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """The shards of ``sized`` (``__bits``, ``n_bytes``): ``depth``, ``prefix``, ``shard_bytes``, by levels of ``_STEP`` bits.

    A level groups the documents of the oversized prefixes by ``_STEP`` more bits
    and rolls the counts up, so that its shuffle has at most 2^``_STEP`` rows a
    task and oversized prefix. The number of levels follows the logarithm of the
    input over the limit.
    """
    shards: DataFrame | None = None
    rest, base = sized, 0
    while True:
        top = min(base + _STEP, MAX_BITS)
        cells = rest.groupBy(_prefix(F.col("__bits"), top).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        depths = F.explode(F.array(*[F.lit(d) for d in range(base + (base > 0), top + 1)]))
        rolled = cells.select("cell", "n_bytes", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {top} - depth)"))
        rolled = rolled.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"))
        rolled = stored(rolled.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_BITS)), "prefixes")
        parent = rolled.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("fits").alias("up_fits"))
        found = rolled.where("fits").withColumn("up", F.expr("shiftright(prefix, 1)")).join(parent, ["depth", "up"], "left").where(~F.coalesce("up_fits", F.lit(False)))
        found = found.select("depth", "prefix", "shard_bytes")
        shards = found if shards is None else shards.unionByName(found)
        large = rolled.where(~F.col("fits") & (F.col("depth") == top)).select(F.col("prefix").alias("cell"))
        if large.isEmpty():
            return shards
        rest = rest.join(large, _prefix(rest["__bits"], top) == large["cell"], "left_semi")
        base = top


def _overflow_parts(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` of full prefixes with ``shard_part``, each part within ``limit`` or a single document.

    Documents above half the limit are parts of their own; of the others those
    that end in the same stretch of half a limit of the running size share one.
    Running sums go through ``SALTS`` cells, as one key may hold most rows.
    """
    big = F.col("n_bytes") * 2 > limit
    cell = ["__bits", "__big", "__salt"]
    rows = rows.withColumns({"__big": big, "__w": F.when(big, F.lit(1)).otherwise(F.col("n_bytes"))})
    ahead = rows.groupBy(*cell).agg(F.sum("__w").alias("__sum"))
    ahead = ahead.withColumn("__ahead", F.coalesce(F.sum("__sum").over(Window.partitionBy("__bits", "__big").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    running = F.sum("__w").over(Window.partitionBy(*cell).orderBy("__tie").rowsBetween(Window.unboundedPreceding, 0))
    unit = F.when(F.col("__big"), F.lit(1)).otherwise(F.lit(max(1, limit // 2)))
    part = F.greatest(F.lit(0), F.floor((F.col("__ahead") + F.col("__running") - 1) / unit)) * 2 + F.col("__big").cast("int")
    return rows.withColumn("__running", running).join(ahead, cell).withColumn("shard_part", part.cast("long")).drop("__running", "__ahead", "__w", "__big")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``shard_depth``, ``shard_prefix`` (the bits as a number), ``shard_part`` (0 but in overflows) and ``shard_bytes``."""
    if limit < 1:
        raise ValueError("limit must be positive")
    out = ("n_bytes", "shard_depth", "shard_prefix", "shard_part", "shard_bytes")
    rest = docs.drop(*out)
    tie = F.xxhash64(*[F.col(f.name) for f in rest.schema.fields if not isinstance(f.dataType, T.MapType)])
    sized = docs.select(*rest.columns, hash_bits(F.col(key)).alias("__bits"), tie.alias("__tie"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    sized = stored(sized, "sized")
    shards = stored(directory(sized.select("__bits", "n_bytes"), limit), "directory")
    depths = [r["depth"] for r in shards.select("depth").distinct().orderBy("depth").collect()]  # at most MAX_BITS + 1
    # A hash has exactly one of its prefixes in the directory; only the depths in use are tried, without the texts.
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("__bits"), d).alias("prefix")) for d in depths or [0]])
    spread = sized.select("__bits").distinct().withColumn("__at", F.explode(tried))
    homes = spread.join(shards.select(F.struct("depth", "prefix").alias("__at"), "shard_bytes"), "__at")
    placed = sized.join(homes, "__bits")
    shown = [*rest.columns, "n_bytes", F.col("__at.depth").alias("shard_depth"), F.col("__at.prefix").alias("shard_prefix"), "shard_part", "shard_bytes"]
    plain = placed.withColumn("shard_part", F.lit(0).cast("long")).select(*shown)
    if MAX_BITS not in depths:
        return plain
    full = F.col("__at.depth") == MAX_BITS
    # Only such a key can hold more than the limit: its rows meet its home by salt. A skewed partition of the others is split by adaptive execution.
    salted = homes.where(full).drop("shard_bytes").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    last = _overflow_parts(sized.join(salted.withColumn("__salt", F.col("__salt").cast(sized.schema["__salt"].dataType)), ["__bits", "__salt"]), limit)
    totals = last.groupBy("__bits", "shard_part").agg(F.sum("n_bytes").alias("shard_bytes"))
    plain = sized.join(homes.where(~full), "__bits").withColumn("shard_part", F.lit(0).cast("long")).select(*shown)
    return plain.unionByName(last.join(totals, ["__bits", "shard_part"]).select(*shown))


def op3_sharding(spark, sf_dir: str, limit: int = 1 << 20) -> DataFrame:
    """All ``documents`` in shards of at most 1 MiB of text; texts by their bytes."""
    made = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), limit)
    return made.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard_depth", "shard_prefix", "shard_part", "shard_bytes")


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits FROM documents
), tried AS (
  SELECT s.*, d.depth::INTEGER AS depth, bits >> ({MAX_BITS} - d.depth)::INTEGER AS prefix FROM sized s, (SELECT unnest(generate_series(0, 40)) AS depth) d
), summed AS (
  SELECT *, (sum(n_bytes) OVER (PARTITION BY depth, prefix))::BIGINT AS shard_bytes FROM tried
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth FROM summed WHERE shard_bytes <= {1 << 20}
)
SELECT doc_id, n_bytes, depth AS shard_depth, prefix AS shard_prefix, 0::BIGINT AS shard_part, shard_bytes FROM placed WHERE nth = 1
"""
