"""Metrics of rankings.

Rankings are rows (query_id, doc_id, pos) with pos from 1; truths are rows
(query_id, doc_id, relevance).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_precision(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, ap: a document counts where it first stands; the divisor is min(relevant, k)."""
    first = ranking.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos")).where(F.col("pos") <= k)
    hits = first.join(truth.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    hits = hits.withColumn("h", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    n = truth.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    s = hits.groupBy("query_id").agg(F.sum(F.col("h") / F.col("pos")).alias("s"))
    return n.join(s, "query_id", "left").select("query_id", (F.coalesce("s", F.lit(0.0)) / F.least("n", F.lit(k))).alias("ap"))


def ndcg(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg: gain of the first position, plus each later one's over log2 of its position."""
    discount = F.when(F.col("pos") == 1, 1.0).otherwise(F.log2("pos"))
    gain = lambda d: d.where(F.col("pos") <= k).groupBy("query_id").agg(F.sum(F.col("relevance") / discount).alias("g"))
    got = gain(ranking.join(truth, ["query_id", "doc_id"], "left").fillna(0, ["relevance"]))
    best = gain(truth.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))))
    return best.withColumnRenamed("g", "b").join(got, "query_id", "left").select("query_id", F.coalesce(F.try_divide(F.col("g"), F.col("b")), F.lit(0.0)).alias("ndcg"))


def precision_recall(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, precision (over k, however many were returned), recall."""
    top = ranking.where(F.col("pos") <= k).select("query_id", "doc_id").distinct()
    t = truth.select("query_id", "doc_id").distinct()
    hits = top.join(t, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("h"))
    n = t.groupBy("query_id").agg(F.count("*").alias("n"))
    h = F.coalesce("h", F.lit(0))
    return n.join(hits, "query_id", "left").select("query_id", (h / k).alias("precision"), (h / F.col("n")).alias("recall"))


def paired_t(pairs: DataFrame) -> DataFrame:
    """t, df of the mean difference of columns a and b."""
    d = pairs.select((F.col("a") - F.col("b")).alias("d"))
    s = d.agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("*").alias("n"))
    return s.select(F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("df"))


def t_tail(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        out = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + top * d) or tiny)
                c = (1 + top / c) or tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
