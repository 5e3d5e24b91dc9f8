"""Sharding by extendible hashing, in DataFrame expressions only.

A row's key is a 60-bit hash of its id and text. The directory begins with one
bucket; only a bucket over the byte limit splits, on the next bit, so a shard is
a prefix of hash bits and sparse prefixes stay short.

Sums for STEP_BITS depths at a time come from one histogram of prefixes, rolled
up; only rows of buckets that are still too large go on to deeper bits. A
bucket that holds one key cannot split: a single row over the limit, or exact
repeats of a row, is a shard of its own that says so in `fits`.

A null text has no bytes, a null id hashes like an empty one. Other columns do
not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.runtime import checkpointed

HASH_BITS = 60
STEP_BITS = 8
LIMIT_BYTES = 8 << 20


def _key(id_col: str, text_col: str) -> Column:
    raw = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(raw), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, shard (its bits; empty for the whole table), shard_bytes and fits of every row."""
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), _key(id_col, text_col).alias("h")))
    live, low, done = rows.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes")), 0, None
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    high = min(HASH_BITS, max(0, (total // limit).bit_length()) + STEP_BITS // 2)
    while True:
        cells = checkpointed(live.groupBy(F.expr(f"shiftright(h, {HASH_BITS - high})").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")))
        levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        final = sums.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high")) | (F.col("depth") == HASH_BITS))
        chosen = levels.select("cell", "depth", "prefix").join(final.drop("low", "high"), ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "bytes"), "depth").alias("s"))
        found = checkpointed(chosen.select(F.col("cell"), F.lit(high).alias("high"), "s.depth", "s.prefix", "s.bytes"))
        done = found if done is None else done.union(found)
        over = cells.join(found, "cell", "left_anti").select("cell")
        if high == HASH_BITS or over.isEmpty():
            break
        live = checkpointed(live.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - high})")).join(over, "cell", "left_semi").drop("cell"))
        low, high = high + 1, min(HASH_BITS, high + STEP_BITS)
    out = None
    for level in sorted(r[0] for r in done.select("high").distinct().collect()):
        own = done.where(F.col("high") == level).drop("high")
        met = rows.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - level})")).join(own, "cell")
        out = met if out is None else out.union(met)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    if out is None:
        out = rows.withColumns({"cell": F.lit(0).cast("long"), "depth": F.lit(0), "prefix": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")})
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), F.col("bytes").alias("shard_bytes"), (F.col("bytes") <= limit).alias("fits"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = f"""
WITH keyed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT k.*, d::INT AS depth, h >> ({HASH_BITS} - d)::INT AS prefix FROM keyed k, range(0, {HASH_BITS + 1}) AS t(d)
), sums AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS bytes, min(h) = max(h) AS single FROM levels GROUP BY depth, prefix
), chosen AS (
  SELECT doc_id, n_bytes, h, l.depth, l.prefix, s.bytes, row_number() OVER (PARTITION BY doc_id, h, n_bytes ORDER BY l.depth) AS r
  FROM levels l JOIN sums s ON l.depth = s.depth AND l.prefix = s.prefix WHERE s.bytes <= {LIMIT_BYTES} OR s.single OR l.depth = {HASH_BITS}
)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, bytes AS shard_bytes, bytes <= {LIMIT_BYTES} AS fits
FROM chosen WHERE r = 1
"""
