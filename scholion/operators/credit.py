"""Credit of institutions and authors, and the aggregations around it.

Facts are flat rows (paper_id, author_id, affil_id, year, ...); a paper's
authors are those with a resolved affiliation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.operators.relational import running_total


def decay(year: Column, age_relev: float, current_year: int, old_year: int) -> Column:
    """exp(-age_relev (current - year)), the year clipped to [old, current]."""
    return F.exp(-age_relev * (current_year - F.greatest(F.least(year, F.lit(current_year)), F.lit(old_year))))


def fractional_credit(fact: DataFrame, by: tuple[str, ...] = ("affil_id",), weight: Column | None = None) -> DataFrame:
    """score: each paper's weight in equal parts to its authors, and each part in equal parts to the author's affiliations.

    Distinct rows, affiliations of an author and authors of a paper all come
    from a partitioning by paper: a fact that has one is not shuffled again.
    """
    extra = [c for c in by if c not in ("affil_id",)]
    f = fact.where("affil_id IS NOT NULL").select("paper_id", "author_id", "affil_id", "year", *[c for c in extra if c != "year"])
    n_affils = F.size(F.collect_set(F.struct(*f.columns)).over(Window.partitionBy("paper_id", "author_id")))
    n_authors = F.size(F.collect_set("author_id").over(Window.partitionBy("paper_id")))  # a paper's own authors
    w = F.lit(1.0) if weight is None else weight
    shares = f.withColumn("_nf", n_affils).withColumn("_na", n_authors).distinct()
    return shares.groupBy(*by).agg(F.sum(w / (F.col("_na") * F.col("_nf"))).alias("score"))


def with_zero(candidates: DataFrame, scores: DataFrame, key: str = "affil_id", score: str = "score") -> DataFrame:
    """Every candidate, with 0 where it has no score."""
    return candidates.join(scores, key, "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def ranked(scores: DataFrame, key: str, score: str = "score", within: tuple[str, ...] = ()) -> DataFrame:
    """rank from 1: by score, largest first, ties by key; over all rows without `within`."""
    if not within:
        return running_total(scores, [F.desc(score), F.asc(key)], F.lit(1), "rank").withColumn("rank", F.col("rank").cast("int"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(score), F.asc(key))))


def top_k(df: DataFrame, within: tuple[str, ...], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, with their rank."""
    w = Window.partitionBy(*within).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalised(df: DataFrame, value: str, how: str = "max") -> DataFrame:
    """`value` over its maximum, its sum, or moved to [0, 1]; zero where that divides by zero.

    One row of totals is computed and broadcast, so no row leaves its task.
    """
    totals = df.agg(F.max(value).alias("_max"), F.min(value).alias("_min"), F.sum(value).alias("_sum"))
    v = F.col(value)
    out = {"max": F.try_divide(v, F.col("_max")), "sum": F.try_divide(v, F.col("_sum")), "range": F.try_divide(v - F.col("_min"), F.col("_max") - F.col("_min"))}[how]
    return df.crossJoin(F.broadcast(totals)).withColumn(value, F.coalesce(out, F.lit(0.0))).drop("_max", "_min", "_sum")


def bagging(rankings: DataFrame, methods: int, key: str = "entity_id", missing: str = "best") -> DataFrame:
    """2 n - sum of 0-based ranks / methods, n being the number of entities.

    An entity that a method does not rank counts as rank 0 there, or with
    `missing="worst"` as rank n.
    """
    n = rankings.select(key).distinct().agg(F.count("*").alias("_n"))
    s = rankings.groupBy(key).agg(F.sum("rank0").alias("_r"), F.count("*").alias("_m")).crossJoin(F.broadcast(n))
    lost = F.lit(0) if missing == "best" else (methods - F.col("_m")) * F.col("_n")
    return s.select(key, (2 * F.col("_n") - (F.col("_r") + lost) / methods).alias("score"))


def lift_rules(baskets: DataFrame, least: float = 1.0, basket: str = "basket", item: str = "item", log: bool = False) -> DataFrame:
    """a, b, lift = f12 N / (f1 f2) of unordered pairs with at least that lift; counts keep repeats inside a basket."""
    n = baskets.select(basket).distinct().agg(F.count("*").alias("_n"))
    single = baskets.groupBy(item).agg(F.count("*").alias("f"))
    counted = baskets.groupBy(basket, item).agg(F.count("*").alias("m"))
    left, right = counted.select(basket, F.col(item).alias("a"), F.col("m").alias("ma")), counted.select(basket, F.col(item).alias("b"), F.col("m").alias("mb"))
    both = left.join(right, basket).where("a < b").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("f12"))
    joined = both.join(single.select(F.col(item).alias("a"), F.col("f").alias("f1")), "a").join(single.select(F.col(item).alias("b"), F.col("f").alias("f2")), "b").crossJoin(F.broadcast(n))
    lift = F.col("f12") * F.col("_n") / (F.col("f1") * F.col("f2"))
    return joined.select("a", "b", lift.alias("lift")).where(F.col("lift") >= least).select("a", "b", (F.log10("lift") if log else F.col("lift")).alias("lift"))


def leverage_rules(baskets: DataFrame, least: float = 0.0, basket: str = "basket", item: str = "item") -> DataFrame:
    """a, b, interest = f12 / f1 - f2 / N of ordered pairs with at least that interest."""
    d = baskets.select(basket, item).distinct()
    n = d.select(basket).distinct().agg(F.count("*").alias("_n"))
    single = d.groupBy(item).agg(F.count("*").alias("f"))
    left, right = d.select(basket, F.col(item).alias("a")), d.select(basket, F.col(item).alias("b"))
    both = left.join(right, basket).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("f12"))
    joined = both.join(single.select(F.col(item).alias("a"), F.col("f").alias("f1")), "a").join(single.select(F.col(item).alias("b"), F.col("f").alias("f2")), "b").crossJoin(F.broadcast(n))
    return joined.select("a", "b", (F.col("f12") / F.col("f1") - F.col("f2") / F.col("_n")).alias("interest")).where(F.col("interest") >= least)
