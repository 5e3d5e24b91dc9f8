"""Time series of scores: differences, trends and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.operators.relational import running_total
from scholion.runtime import checkpointed


def trimmed_series(series: DataFrame, key: str) -> DataFrame:
    """(key, step, score) rows from one step before the first positive score; series without one have none."""
    first = series.where("score > 0").groupBy(key).agg(F.min("step").alias("_f"))
    return series.join(first, key).where(F.col("step") >= F.col("_f") - 1).drop("_f")


def trend_factors(series: DataFrame, key: str) -> DataFrame:
    """key, factor of each series (key, step, score).

    sigma is the mean of the non-zero differences' sizes, m the mean, l the
    last score; t = 0 if |l - m| <= .4 sigma, else sign(m - l) min(|l - m| /
    sigma, 1); factor = tanh(.2 t sigma / m). Without differences it is 0.
    """
    w = Window.partitionBy(key).orderBy("step")
    d = trimmed_series(series, key).withColumn("_d", F.abs(F.col("score") - F.lag("score").over(w)))
    s = d.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0.0)).alias("_s"), F.avg("score").alias("_m"), F.max_by("score", "step").alias("_l"))
    gap = F.abs(F.col("_l") - F.col("_m"))
    t = F.when((F.col("_s") == 0) | (gap <= 0.4 * F.col("_s")), 0.0).otherwise(F.signum(F.col("_m") - F.col("_l")) * F.least(F.try_divide(gap, F.col("_s")), F.lit(1.0)))
    return s.select(key, F.coalesce(F.tanh(F.try_divide(0.2 * t * F.col("_s"), F.col("_m"))), F.lit(0.0)).alias("factor"))


def with_trend(scores: DataFrame, factors: DataFrame, key: str) -> DataFrame:
    """score (1 + factor), for keys that have both."""
    return scores.join(factors, key).withColumn("score", F.col("score") * (1 + F.col("factor"))).drop("factor")


def rolling(series: DataFrame, key: str, window: int = 3) -> DataFrame:
    """mean and sample deviation of the last `window` steps; null until there are as many."""
    w = Window.partitionBy(key).orderBy("step").rowsBetween(1 - window, 0)
    full = F.count("*").over(w) == window
    return series.select(key, "step", F.when(full, F.avg("score").over(w)).alias("mean"), F.when(full, F.stddev_samp("score").over(w)).alias("deviation"))


def empirical_cdf(df: DataFrame, value: str) -> DataFrame:
    """value, share of rows with at most that value, from a running total over the distinct values."""
    counts = checkpointed(df.groupBy(value).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n").alias("_t"))
    running = running_total(counts, [F.col(value)], F.col("_n"), "_r")
    return running.crossJoin(F.broadcast(total)).select(value, (F.col("_r") / F.col("_t")).alias("share"))


def autoregression(series: DataFrame, key: str) -> DataFrame:
    """key, forecast: last + c + phi times the last difference, phi and c by least squares of differences on those before; without a fit, the mean of the last four."""
    w = Window.partitionBy(key).orderBy("step")
    d = series.withColumn("d", F.col("score") - F.lag("score").over(w)).withColumn("p", F.lag("d").over(w))
    recent = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("step")))
    s = d.withColumn("r", recent).groupBy(key).agg(F.regr_slope("d", "p").alias("phi"), F.regr_intercept("d", "p").alias("c"), F.max_by("score", "step").alias("last"), F.max_by("d", "step").alias("step_d"), F.avg(F.when(F.col("r") <= 4, F.col("score"))).alias("mean4"))
    return s.select(key, F.coalesce(F.col("last") + F.col("c") + F.col("phi") * F.col("step_d"), F.col("mean4")).alias("forecast"))


def high_runs(values: list[float], limit: float) -> list[tuple[int, int]]:
    """(begin, end) of every place at which the running sum, begun anew whenever it fell below 0, is at least `limit`."""
    out, begin, total = [], 0, None
    for end, v in enumerate(values):
        if total is None or total < 0:
            total, begin = v, end
        else:
            total += v
        if total >= limit:
            out.append((begin, end))
    return out
