"""Scans, filters, joins, set operations and table changes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.runtime import checkpointed


def select(df: DataFrame, fields: str | Iterable[str] = "*", where: str | None = None, order_by: Iterable[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Projection and filter of one table, with ordering and paging where asked for."""
    out = df.where(where) if where else df
    if order_by:
        out = out.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*([fields] if isinstance(fields, str) else fields))


def first_row(df: DataFrame, order_by: Iterable[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(1)


def is_in(column: str, values: object) -> Column:
    """column IN values; a scalar is one value, and no values match nothing."""
    listed = list(values) if isinstance(values, (list, tuple, set, frozenset, range)) else [values]
    return F.col(column).isin(listed) if listed else F.lit(False)


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, joined by AND; none at all is true."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def touching(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges of which an end is in `nodes`."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(n, F.col("src") == F.col("_n"), "left_semi").union(edges.join(n, F.col("dst") == F.col("_n"), "left_semi")).distinct()


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Distinct edges with both ends in `nodes`, without loops."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.where("src <> dst").join(n, F.col("src") == F.col("_n"), "left_semi").join(n, F.col("dst") == F.col("_n"), "left_semi").distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that an edge, in either direction, joins with `nodes`."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return both.join(n, F.col("src") == F.col("_n"), "left_semi").select(F.col("dst").alias(node)).distinct()


def expand(edges: DataFrame, nodes: DataFrame, hops: int, node: str = "node", stop_at: int | None = None) -> DataFrame:
    """`nodes` and all within `hops` of them; growth ends early once `stop_at` nodes are reached."""
    reached = nodes.select(node).distinct()
    for hop in range(hops):
        reached = reached.union(neighbours(edges, reached, node)).distinct()
        if stop_at is not None or hop % 2:
            reached = checkpointed(reached)
        if stop_at is not None and reached.count() >= stop_at:
            break
    return reached


def without(df: DataFrame, excluded: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(excluded, on, "left_anti")


def connected(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that have an edge."""
    ends = edges.select(F.col("src").alias(node)).union(edges.select(F.col("dst").alias(node))).distinct()
    return nodes.join(ends, node, "left_semi")


def keyword_filter(mode: str, extracted: str = "extracted") -> Column:
    """none keeps nothing, extracted and extended one kind, both all."""
    return {"none": F.lit(False), "extracted": F.col(extracted), "extended": ~F.col(extracted), "both": F.lit(True)}[mode]


def same_text(a: Column, b: Column) -> Column:
    """Equality that ignores case and trailing blanks."""
    return F.lower(F.rtrim(a)) == F.lower(F.rtrim(b))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase, taken literally, stands in the text as whole words, in any case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<!\w)\Q"), phrase, F.lit(r"\E(?!\w)")))


def sampled(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows in the order of the md5 of their key: the same rows in any engine."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All records of `new`, and those of `old` whose key it lacks."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def insert_ignore(table: DataFrame, rows: DataFrame, key: str | list[str], order_by: str) -> DataFrame:
    """`table` and the first of the new rows for each key that it lacks."""
    keys = [key] if isinstance(key, str) else key
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))).where("_r = 1").drop("_r")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def update(table: DataFrame, values: dict[str, Column], where: Column) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def pairs_in_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n) with a < b for items that share groups, and in how many.

    A self-join on the group: a group of k items makes k (k - 1) / 2 pairs, so
    this is for groups with a natural bound, like a paper's authors.
    """
    d = df.select(group, item).distinct()
    left, right = d.select(group, F.col(item).alias("a")), d.select(group, F.col(item).alias("b"))
    return left.join(right, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


#: A dictionary of at most so many entries is broadcast whole; a larger one is joined by token, with the same result.
MOST_ENTRIES = 5000


def token_subset_join(texts: DataFrame, text: str, dictionary: DataFrame, tokens: str = "tokens", priority: str = "priority") -> DataFrame:
    """The dictionary entry of the smallest priority whose tokens are all words of the text; an entry without tokens fits nothing.

    In a large dictionary texts meet an entry by its rarest token, that which
    the fewest entries have, so common words pair nothing; the other tokens are
    then looked for in the text. Equal texts are matched once.
    """
    split = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rest = [c for c in dictionary.columns if c not in (priority, tokens)]
    entries = dictionary.where(F.size(tokens) > 0).select(F.struct(priority, tokens, *rest).alias("_m"))
    fits = lambda e: F.forall(e[tokens], lambda t: F.array_contains("_words", t))
    if dictionary.count() <= MOST_ENTRIES:
        listed = entries.agg(F.array_sort(F.collect_list("_m")).alias("_entries"))
        met = texts.select("*", F.explode(F.array(split)).alias("_words")).crossJoin(F.broadcast(listed))
        met = met.withColumn("_m", F.get(F.filter("_entries", fits), F.lit(0))).where("_m IS NOT NULL")
    else:
        spread = entries.select("_m", F.explode(F.array_distinct(F.col("_m")[tokens])).alias("_w"))
        common = spread.groupBy("_w").agg(F.count("*").alias("_n"))
        rarest = spread.join(common, "_w").groupBy("_m").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"))
        keyed = texts.where(F.col(text).isNotNull()).withColumn("_key", F.md5(text))
        words = keyed.select("_key", split.alias("_words")).dropDuplicates(["_key"])
        found = words.select("_key", "_words", F.explode("_words").alias("_w")).join(rarest, "_w").where(fits(F.col("_m")))
        met = keyed.join(found.groupBy("_key").agg(F.min("_m").alias("_m")), "_key")
    return met.select(*texts.columns, *(F.col("_m")[c].alias(c) for c in dictionary.columns))


def running_total(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """`name`: the sum of `value` over the rows up to this one, in an order without ties.

    Rows are sorted into ranges; a range adds the sums of those before it, so
    no task has more than its range.
    """
    parts = checkpointed(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_value": value}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = parts.groupBy("_part").agg(F.sum("_value").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_own", own).join(F.broadcast(sums), "_part").select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def running_total_within(df: DataFrame, key: str, order: Column, value: Column, name: str) -> DataFrame:
    """`name`: the sum of `value` over a key's rows up to this one, in an order without ties within the key.

    Ranges are of key and order together, so a key with most of the rows is
    spread over many tasks; each range adds the sums of the key's earlier ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.withColumn("_value", value).repartitionByRange(parts, F.col(key), order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that has the key
    sums = placed.groupBy(key, "_part").agg(F.sum("_value").alias("_sum")).select(key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(sums, [key, "_part"]).withColumn(name, F.col("_before") + own).select(*df.columns, name)


def upper_half_mean(df: DataFrame, key: str, value: str, name: str = "score") -> DataFrame:
    """key, `name`: the mean of the upper half of a key's values, of the largest int(n / 2), one at least; nulls do not count.

    Equal values are one row with a count. Their places from the top are running
    totals over ranges, so no key's values are gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(key).agg(F.greatest(F.floor(F.sum("_n") / 2), F.lit(1)).alias("_half"))
    placed = running_total_within(counts, key, F.desc(value), F.col("_n"), "_to").join(totals, key)
    taken = F.least(F.col("_n"), F.greatest(F.col("_half") - F.col("_to") + F.col("_n"), F.lit(0)))
    return placed.withColumn("_taken", taken).groupBy(key).agg((F.sum(F.col(value) * F.col("_taken")) / F.max("_half")).alias(name))


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """SQL over the given tables, which are named only for this call."""
    return spark.sql(sql, **tables)
