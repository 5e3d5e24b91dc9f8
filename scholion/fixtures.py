"""The driver's tables as a bibliography.

Orders are papers, their priority the venue; distinct (order, supplier) pairs
are authorships, a supplier's nation the affiliation; an order cites the same
customer's order before it. The SQL twins are CTEs of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURRENT_YEAR, OLD_YEAR = 2001, 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    """paper_id, year, venue."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("venue"))


def authorship(spark: SparkSession, d: str) -> DataFrame:
    """paper_id, author_id."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).distinct()


def affiliation(spark: SparkSession, d: str) -> DataFrame:
    """author_id, affil_id."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_nationkey").alias("affil_id"))


#: Lines of a task that deals with papers: their number follows the input, so a task's memory does not.
PAPER_LINES, LEAST_PAPER_LINES = 200_000, 20_000


def fact(spark: SparkSession, d: str) -> DataFrame:
    """paper_id, author_id, affil_id, year, venue: the flat fact of rankings.

    Lines meet their papers before they are made distinct, so a filter on year
    or venue spares the other lines, and both need one shuffle by paper. That
    shuffle has a task for some PAPER_LINES lines, whatever they compress to.
    """
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"))
    n = lines.count()
    parts = 1 + max(n // PAPER_LINES, min(n // LEAST_PAPER_LINES, spark.sparkContext.defaultParallelism))
    placed = lines.join(affiliation(spark, d), "author_id").repartition(parts, "paper_id")
    return placed.join(papers(spark, d), "paper_id").select("paper_id", "author_id", "affil_id", "year", "venue").distinct()


def citations(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: the citing and the cited paper."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """affil_id, name."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("affil_id"), F.col("n_name").alias("name"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text."""
    return table(spark, d, "documents").select("doc_id", "text")


CTE = {
    "papers": "papers AS (SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, o_orderpriority AS venue FROM orders)",
    "authorship": "authorship AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author_id FROM lineitem)",
    "affiliation": "affiliation AS (SELECT s_suppkey AS author_id, s_nationkey AS affil_id FROM supplier)",
    "fact": "fact AS (SELECT paper_id, author_id, affil_id, year, venue FROM authorship JOIN papers USING (paper_id) JOIN affiliation USING (author_id))",
    "citations": "citations AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)",
    "candidates": "candidates AS (SELECT n_nationkey AS affil_id, n_name AS name FROM nation)",
}


def ctes(*names: str) -> str:
    """A WITH list of the named twins; `fact` brings what it needs."""
    need = list(dict.fromkeys([x for n in names for x in (("papers", "authorship", "affiliation", "fact") if n == "fact" else (n,))]))
    return ",\n".join(CTE[n] for n in need)
