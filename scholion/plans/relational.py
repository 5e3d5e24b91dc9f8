"""Queries over scans, filters, joins, aggregations, orderings and set operations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.fixtures import CURRENT_YEAR, OLD_YEAR, affiliation, authorship, candidates, citations, ctes, fact, papers, table
from scholion.operators import credit as C
from scholion.operators import relational as R
from scholion.plans.registry import query
from scholion.runtime import scratch_file
from scholion.sources.stored import StoredTable

AGE = 0.2
DECAY_SQL = f"exp(-{AGE} * ({CURRENT_YEAR} - greatest(least(year, {CURRENT_YEAR}), {OLD_YEAR})))"


def decayed() -> F.Column:
    return C.decay(F.col("year"), AGE, CURRENT_YEAR, OLD_YEAR)


def r6(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@query("SRC1_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def scan(spark: SparkSession, d: str) -> DataFrame:
    return R.select(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F' AND o_totalprice > 1000")


@query("SRC2_raw_sql", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def raw_sql(spark: SparkSession, d: str) -> DataFrame:
    return R.run_sql(spark, "SELECT n_name, count(*) AS n FROM {s} JOIN {n} ON s_nationkey = n_nationkey GROUP BY n_name", {"s": table(spark, d, "supplier"), "n": table(spark, d, "nation")})


@query("SRC3_first_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_row(spark: SparkSession, d: str) -> DataFrame:
    return R.first_row(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


@query("SNK1_insert_ignore", """
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, s_name || '!' FROM supplier WHERE s_suppkey % 2 <> 0""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = s.withColumn("s_name", F.concat("s_name", F.lit("!")))
    new = new.union(new.withColumn("s_name", F.concat("s_name", F.lit("!"))))
    stored = StoredTable.create(s.where("s_suppkey % 2 = 0"), scratch_file(spark), "s_suppkey")
    stored.insert_ignore(new, "s_name")
    return stored.read()


@query("SNK2_update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update(spark: SparkSession, d: str) -> DataFrame:
    stored = StoredTable.create(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), scratch_file(spark), "s_suppkey")
    stored.update({"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)
    return stored.read()


@query("SNK3_delete", "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0)")
def delete(spark: SparkSession, d: str) -> DataFrame:
    stored = StoredTable.create(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), scratch_file(spark), "s_suppkey")
    stored.delete(F.col("s_acctbal") < 0)
    return stored.read().select("s_suppkey")


@query("FLT1_in_list", f"WITH {ctes('papers')} SELECT paper_id, year FROM papers WHERE venue = '1-URGENT' AND year IN (1996, 1997)")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).where(R.is_in("venue", "1-URGENT") & R.is_in("year", [1996, 1997])).select("paper_id", "year")


@query("FLT2_all_of", f"WITH {ctes('papers')} SELECT paper_id FROM papers WHERE year >= 1997 AND venue <> '5-LOW'")
def all_of(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).where(R.all_of(F.col("year") >= 1997, None, F.col("venue") != "5-LOW")).select("paper_id")


@query("FLT3_either_endpoint", f"""
WITH {ctes("papers", "citations")}, s AS (SELECT paper_id FROM papers WHERE year = 1998)
SELECT DISTINCT src, dst FROM citations WHERE src IN (FROM s) OR dst IN (FROM s)""")
def either_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return R.touching(citations(spark, d), papers(spark, d).where("year = 1998"), "paper_id")


@query("FLT4_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IS NOT NULL AND o_orderpriority <> ''")
def between(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_totalprice").between(1000, 50000) & F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "")).select("o_orderkey")


@query("FLT5_ilike", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%a%'")
def ilike(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_type").ilike("%a%")).select("p_partkey", "p_type")


@query("FLT6_phrase", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])license([^\p{L}\p{N}_]|$)')")
def phrase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(R.has_phrase(F.col("text"), F.lit("License"))).select("doc_id")


@query("FLT7_collated_equality", "SELECT n_nationkey FROM nation WHERE lower(rtrim(n_name)) = lower(rtrim('nation_7  '))")
def collated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where(R.same_text(F.col("n_name"), F.lit("nation_7  "))).select("n_nationkey")


@query("FLT8_threshold", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.05")
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount >= 0.05").select("l_orderkey", "l_linenumber", "l_discount")


@query("FLT9_exclude", f"WITH {ctes('papers', 'citations')} SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT dst FROM citations)")
def exclude(spark: SparkSession, d: str) -> DataFrame:
    return R.without(papers(spark, d).select("paper_id"), citations(spark, d).select(F.col("dst").alias("paper_id")), "paper_id")


@query("FLT10_keyword_mode", "SELECT p_partkey FROM part WHERE NOT (p_size > 25)")
def keyword_mode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("extracted", F.col("p_size") > 25).where(R.keyword_filter("extended")).select("p_partkey")


@query("FLT11_connected_nodes", f"WITH {ctes('papers', 'citations')} SELECT paper_id FROM papers WHERE paper_id IN (SELECT src FROM citations UNION SELECT dst FROM citations)")
def connected(spark: SparkSession, d: str) -> DataFrame:
    return R.connected(papers(spark, d).select("paper_id"), citations(spark, d), "paper_id")


@query("FLT12_drop_layer", f"""
WITH {ctes("papers", "authorship", "citations")}, e AS (SELECT src, dst FROM citations)
SELECT paper_id FROM papers WHERE paper_id IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def drop_layer(spark: SparkSession, d: str) -> DataFrame:
    edges = citations(spark, d).withColumn("layer", F.lit("paper")).union(authorship(spark, d).select(F.col("paper_id"), F.col("author_id"), F.lit("author")))
    kept = edges.where(F.col("layer").isin([k for k, rho in {"paper": 1.0, "author": 0.0}.items() if rho]))
    return R.connected(papers(spark, d).select("paper_id"), kept, "paper_id")


@query("FLT13_not_newer", f"""
WITH {ctes("papers", "citations")}, e AS (
  SELECT c.src, c.dst, row_number() OVER (PARTITION BY c.src ORDER BY b.year DESC, c.dst) AS r
  FROM citations c JOIN papers a ON a.paper_id = c.src JOIN papers b ON b.paper_id = c.dst WHERE b.year < a.year)
SELECT src, dst FROM e WHERE r <= 21""")
def not_newer(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    e = citations(spark, d).join(p.select(F.col("paper_id").alias("src"), F.col("year").alias("q")), "src").join(p.select(F.col("paper_id").alias("dst"), "year"), "dst").where("year < q")
    w = Window.partitionBy("src").orderBy(F.desc("year"), "dst")
    return e.withColumn("r", F.row_number().over(w)).where("r <= 21").select("src", "dst")


@query("FLT14_missing_truth", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE text <> '')")
def missing_truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").where("text <> ''").select("doc_id"), "doc_id", "left_semi")


@query("FLT15_in_state", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def in_state(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_semi")


@query("FLT16_sample", "SELECT o_orderkey FROM orders ORDER BY md5('s' || o_orderkey::VARCHAR) LIMIT 100")
def sample(spark: SparkSession, d: str) -> DataFrame:
    return R.sampled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, "s")


@query("JN1_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("JN2_fact", f"WITH {ctes('fact')} SELECT paper_id, author_id, affil_id, year FROM fact WHERE venue = '1-URGENT' AND year = 1997")
def base_fact(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d).where("venue = '1-URGENT' AND year = 1997").select("paper_id", "author_id", "affil_id", "year")


@query("JN3_three_way", "SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def three_way(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "n_name")


_COAUTHORS = f"WITH {ctes('authorship')} SELECT x.author_id AS a, y.author_id AS b, count(*)::BIGINT AS n FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author_id < y.author_id GROUP BY 1, 2"


@query("JN4_coauthors", _COAUTHORS)
def coauthors(spark: SparkSession, d: str) -> DataFrame:
    return R.pairs_in_group(authorship(spark, d), "paper_id", "author_id")


@query("JN5_shared_papers", f"SELECT a, b FROM ({_COAUTHORS}) WHERE n > 1")
def shared_papers(spark: SparkSession, d: str) -> DataFrame:
    return R.pairs_in_group(authorship(spark, d), "paper_id", "author_id").where("n > 1").select("a", "b")


_INDUCED = f"WITH {ctes('papers', 'citations')}, s AS (SELECT paper_id FROM papers WHERE year IN (1996, 1997))"


@query("JN6_induced", f"{_INDUCED} SELECT DISTINCT src, dst FROM citations WHERE src <> dst AND src IN (FROM s) AND dst IN (FROM s)")
def induced(spark: SparkSession, d: str) -> DataFrame:
    return R.induced(citations(spark, d), papers(spark, d).where("year IN (1996, 1997)"), "paper_id")


_SEED = f"WITH {ctes('papers', 'citations')}, s AS (SELECT paper_id FROM papers WHERE year = 1998 AND venue = '2-HIGH')"


@query("JN7_neighbours", f"{_SEED} SELECT dst AS paper_id FROM citations WHERE src IN (FROM s) UNION SELECT src FROM citations WHERE dst IN (FROM s)")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbours(citations(spark, d), papers(spark, d).where("year = 1998 AND venue = '2-HIGH'"), "paper_id")


def project(cites: DataFrame, members: DataFrame, years: DataFrame, member: str) -> DataFrame:
    """a, b, weight: log10(1 + sum of the citing papers' decay) over citations between members of two papers."""
    m = members.select("paper_id", member).distinct()
    e = cites.distinct().join(years, cites["src"] == years["paper_id"]).drop("paper_id")
    e = e.join(m.select(F.col("paper_id").alias("src"), F.col(member).alias("a")), "src").join(m.select(F.col("paper_id").alias("dst"), F.col(member).alias("b")), "dst")
    return e.where("a <> b").groupBy("a", "b").agg(F.log10(1 + F.sum(decayed())).alias("weight"))


def _project_sql(member: str) -> str:
    return f"""
SELECT x.{member} AS a, y.{member} AS b, log10(1 + sum({DECAY_SQL.replace("year", "p.year")})) AS weight
FROM (SELECT DISTINCT src, dst FROM citations) c JOIN papers p ON p.paper_id = c.src
JOIN (SELECT DISTINCT paper_id, {member} FROM fact) x ON x.paper_id = c.src JOIN (SELECT DISTINCT paper_id, {member} FROM fact) y ON y.paper_id = c.dst
WHERE x.{member} <> y.{member} GROUP BY 1, 2"""


@query("JN8_author_projection", f"WITH {ctes('fact', 'citations')} SELECT a, b, round(weight, 6) AS weight FROM ({_project_sql('author_id')})")
def author_projection(spark: SparkSession, d: str) -> DataFrame:
    return project(citations(spark, d), fact(spark, d), papers(spark, d).select("paper_id", "year"), "author_id").withColumn("weight", r6("weight"))


@query("JN9_affil_projection", f"WITH {ctes('fact', 'citations')} SELECT a, b, round(weight, 6) AS weight FROM ({_project_sql('affil_id')})")
def affil_projection(spark: SparkSession, d: str) -> DataFrame:
    return project(citations(spark, d), fact(spark, d), papers(spark, d).select("paper_id", "year"), "affil_id").withColumn("weight", r6("weight"))


def author_to_affil(edges: DataFrame, affils: DataFrame, scores: DataFrame) -> DataFrame:
    """a, b, weight: the citing authors' scores, summed over author citations between two institutions."""
    e = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct().join(scores.select(F.col("author_id").alias("x"), "score"), "x")
    e = e.join(affils.select(F.col("author_id").alias("x"), F.col("affil_id").alias("a")), "x").join(affils.select(F.col("author_id").alias("y"), F.col("affil_id").alias("b")), "y")
    return e.where("a <> b").groupBy("a", "b").agg(F.sum("score").alias("weight"))


@query("JN10_author_affil_projection", f"""
WITH {ctes("fact", "citations")}, e AS ({_project_sql("author_id")}), s AS (SELECT author_id, count(*)::DOUBLE AS score FROM authorship GROUP BY 1)
SELECT f.affil_id AS a, g.affil_id AS b, round(sum(s.score), 6) AS weight
FROM e JOIN s ON s.author_id = e.a JOIN affiliation f ON f.author_id = e.a JOIN affiliation g ON g.author_id = e.b WHERE f.affil_id <> g.affil_id GROUP BY 1, 2""")
def author_affil_projection(spark: SparkSession, d: str) -> DataFrame:
    edges = project(citations(spark, d), fact(spark, d), papers(spark, d).select("paper_id", "year"), "author_id")
    scores = authorship(spark, d).groupBy("author_id").agg(F.count("*").cast("double").alias("score"))
    return author_to_affil(edges, affiliation(spark, d), scores).withColumn("weight", r6("weight"))


_CREDIT = """credit AS (SELECT f.affil_id, f.year, f.venue, sum(1.0::DOUBLE / (na * nf)) AS s, sum({w} / (na * nf)) AS score FROM (SELECT DISTINCT * FROM fact) f
  JOIN (SELECT paper_id, count(DISTINCT author_id) AS na FROM fact GROUP BY 1) USING (paper_id)
  JOIN (SELECT paper_id, author_id, count(DISTINCT affil_id) AS nf FROM fact GROUP BY 1, 2) USING (paper_id, author_id) GROUP BY 1, 2, 3)"""
CREDIT = _CREDIT.format(w="1.0::DOUBLE")
CREDIT_DECAYED = _CREDIT.format(w=DECAY_SQL)


@query("JN11_default_zero", f"WITH {ctes('fact', 'candidates')}, {CREDIT} SELECT name, round(coalesce(sum(score), 0), 6) AS score FROM candidates LEFT JOIN (SELECT * FROM credit WHERE year = 1995) USING (affil_id) GROUP BY name")
def default_zero(spark: SparkSession, d: str) -> DataFrame:
    return C.with_zero(candidates(spark, d), C.fractional_credit(fact(spark, d).where("year = 1995"))).select("name", r6("score").alias("score"))


@query("JN12_zero_filled_years", f"""
WITH {ctes("fact", "candidates")}, {CREDIT}, y AS (SELECT DISTINCT year FROM papers)
SELECT affil_id, y.year, round(coalesce(sum(score), 0), 6) AS score FROM candidates CROSS JOIN y LEFT JOIN credit USING (affil_id, year) GROUP BY 1, 2""")
def zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return yearly_credit(spark, d).withColumn("score", r6("score"))


def yearly_credit(spark: SparkSession, d: str) -> DataFrame:
    """affil_id, year, score of every candidate in every year of the corpus."""
    grid = candidates(spark, d).select("affil_id").crossJoin(F.broadcast(papers(spark, d).select("year").distinct()))  # years are few
    return grid.join(C.fractional_credit(fact(spark, d), ("affil_id", "year")), ["affil_id", "year"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


@query("JN13_overlap", f"""
WITH {ctes("authorship", "papers")}, a AS (SELECT DISTINCT author_id, year FROM authorship JOIN papers USING (paper_id))
SELECT x.year, count(y.author_id)::BIGINT AS shared, round(count(y.author_id) / count(*), 6) AS share FROM a x LEFT JOIN a y ON x.author_id = y.author_id AND y.year = x.year + 1 GROUP BY x.year""")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    a = authorship(spark, d).join(papers(spark, d), "paper_id").select("author_id", "year").distinct()
    nxt = a.select(F.col("author_id").alias("other"), (F.col("year") - 1).alias("year"))
    j = a.join(nxt, (F.col("author_id") == F.col("other")) & (a["year"] == nxt["year"]), "left").select(a["year"], "other")
    return j.groupBy("year").agg(F.count("other").alias("shared"), r6(F.count("other") / F.count("*")).alias("share"))


DICTIONARY = [(1, ["license"], "license"), (2, ["the", "of"], "the-of"), (3, ["der"], "der"), (4, ["de", "la"], "de-la")]


@query("JN14_token_subset", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)
SELECT doc_id, CASE WHEN list_contains(t, 'license') THEN 'license' WHEN list_contains(t, 'the') AND list_contains(t, 'of') THEN 'the-of'
  WHEN list_contains(t, 'der') THEN 'der' ELSE 'de-la' END AS label FROM w
WHERE list_contains(t, 'license') OR (list_contains(t, 'the') AND list_contains(t, 'of')) OR list_contains(t, 'der') OR (list_contains(t, 'de') AND list_contains(t, 'la'))""")
def token_subset(spark: SparkSession, d: str) -> DataFrame:
    entries = spark.createDataFrame(DICTIONARY, "priority int, tokens array<string>, label string")
    return R.token_subset_join(table(spark, d, "documents").select("doc_id", "text"), "text", entries).select("doc_id", "label")


@query("JN15_name_in_list", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def name_in_list(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "/").alias("names"))
    one = names.select(F.explode(F.split("names", "/")).alias("n_name"))
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(one, "n_name").select("s_suppkey", "n_name")


@query("JN17_clear_winner", f"""
WITH {ctes("fact")}, c AS (SELECT author_id, venue, count(DISTINCT paper_id) AS n FROM fact GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY author_id ORDER BY n DESC, venue))
SELECT author_id, venue, n::BIGINT AS n FROM r WHERE r = 1 AND n >= 1 AND n >= 1.1 * coalesce(nxt, 0)""")
def clear_winner(spark: SparkSession, d: str) -> DataFrame:
    c = fact(spark, d).groupBy("author_id", "venue").agg(F.countDistinct("paper_id").alias("n"))
    return winners(c, "author_id", "venue", "n", 1.0, 1.1).select("author_id", "venue", "n")


def winners(scores: DataFrame, key: str, tie: str, score: str, least: float, ratio: float) -> DataFrame:
    """The best row of each key, if it has at least `least` and `ratio` times the second's score.

    The ratio is a decimal, so a count of just 1.1 times the next is one, as 11 is to 10.
    """
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    d = scores.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score).over(w)})
    return d.where((F.col("_r") == 1) & (F.col(score) >= least) & (F.col(score) >= F.lit(Decimal(str(ratio))) * F.coalesce("_next", F.lit(0)))).drop("_r", "_next")


@query("JN18_two_lookups", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def two_lookups(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("JN19_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    return R.without(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("JN20_hops", f"""
{_SEED}, u AS (SELECT src AS x, dst AS y FROM citations UNION SELECT dst, src FROM citations),
h1 AS (SELECT paper_id FROM s UNION SELECT y FROM u WHERE x IN (FROM s))
SELECT paper_id FROM h1 UNION SELECT y FROM u WHERE x IN (FROM h1)""")
def hops(spark: SparkSession, d: str) -> DataFrame:
    return R.expand(citations(spark, d), papers(spark, d).where("year = 1998 AND venue = '2-HIGH'"), 2, "paper_id")


@query("AG1_fractional_credit", f"WITH {ctes('fact')}, {CREDIT_DECAYED} SELECT affil_id, round(sum(score), 6) AS score FROM credit GROUP BY 1")
def credit(spark: SparkSession, d: str) -> DataFrame:
    return C.fractional_credit(fact(spark, d), weight=decayed()).select("affil_id", r6("score").alias("score"))


@query("AG2_credit_by_year", f"WITH {ctes('fact')}, {CREDIT} SELECT affil_id, round(sum(score), 6) AS score FROM credit WHERE year > (SELECT min(year) FROM credit) GROUP BY 1")
def credit_by_year(spark: SparkSession, d: str) -> DataFrame:
    c = C.fractional_credit(fact(spark, d), ("affil_id", "year"))
    first = c.agg(F.min("year").alias("first"))
    return c.crossJoin(F.broadcast(first)).where("year > first").groupBy("affil_id").agg(r6(F.sum("score")).alias("score"))


@query("AG3_paper_counts", f"WITH {ctes('fact')} SELECT 'author' AS kind, author_id::BIGINT AS id, count(DISTINCT paper_id)::BIGINT AS n FROM fact GROUP BY 2 UNION ALL SELECT 'affil', affil_id, count(DISTINCT paper_id) FROM fact GROUP BY 2")
def paper_counts(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    one = lambda kind, key: f.groupBy(F.col(key).cast("long").alias("id")).agg(F.countDistinct("paper_id").alias("n")).select(F.lit(kind).alias("kind"), "id", "n")
    return one("author", "author_id").union(one("affil", "affil_id"))


@query("AG4_affil_counts", f"""WITH {ctes('fact')}, {CREDIT} SELECT affil_id, round(c.score, 6) AS score, papers, authors FROM (SELECT affil_id, sum(score) AS score FROM credit GROUP BY 1) c
JOIN (SELECT affil_id, count(DISTINCT paper_id)::BIGINT AS papers, count(DISTINCT author_id)::BIGINT AS authors FROM fact GROUP BY 1) USING (affil_id)""")
def affil_counts(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    counts = f.groupBy("affil_id").agg(F.countDistinct("paper_id").alias("papers"), F.countDistinct("author_id").alias("authors"))
    return C.fractional_credit(f).join(counts, "affil_id").select("affil_id", r6("score").alias("score"), "papers", "authors")


@query("AG5_author_score_to_affil", f"WITH {ctes('fact')}, s AS (SELECT author_id, count(DISTINCT paper_id) AS n FROM fact GROUP BY 1) SELECT affil_id, sum(n)::BIGINT AS score FROM (SELECT DISTINCT author_id, affil_id FROM fact) JOIN s USING (author_id) GROUP BY 1")
def author_score_to_affil(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    s = f.groupBy("author_id").agg(F.countDistinct("paper_id").alias("n"))
    return f.select("author_id", "affil_id").distinct().join(s, "author_id").groupBy("affil_id").agg(F.sum("n").alias("score"))


@query("AG6_paper_score_to_affil", f"WITH {ctes('fact')} SELECT affil_id, round(sum(o_totalprice), 2) AS score FROM (SELECT DISTINCT paper_id, affil_id FROM fact) JOIN orders ON paper_id = o_orderkey GROUP BY 1")
def paper_score_to_affil(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_totalprice")
    return fact(spark, d).select("paper_id", "affil_id").distinct().join(s, "paper_id").groupBy("affil_id").agg(F.round(F.sum("o_totalprice"), 2).alias("score"))


@query("AG7_history_mean", f"WITH {ctes('fact')} SELECT author_id, round(count(DISTINCT CASE WHEN year IN (1996, 1997, 1998) THEN paper_id END) / 3, 6) AS score FROM fact GROUP BY 1")
def history_mean(spark: SparkSession, d: str) -> DataFrame:
    years = [1996, 1997, 1998]
    return fact(spark, d).groupBy("author_id").agg(r6(F.countDistinct(F.when(F.col("year").isin(years), F.col("paper_id"))) / len(years)).alias("score"))


@query("AG8_team_size_distribution", f"WITH {ctes('authorship')}, n AS (SELECT paper_id, count(*) AS k FROM authorship GROUP BY 1) SELECT k::BIGINT AS k, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM n GROUP BY k")
def team_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = authorship(spark, d).groupBy("paper_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("share"))
    return C.normalised(n, "share", "sum").select("k", r6("share").alias("share"))


@query("AG9_citations_received", f"WITH {ctes('authorship', 'papers', 'citations')} SELECT author_id, round(sum({DECAY_SQL}), 6) AS score FROM citations JOIN papers ON src = papers.paper_id JOIN authorship ON dst = authorship.paper_id GROUP BY 1")
def citations_received(spark: SparkSession, d: str) -> DataFrame:
    e = citations(spark, d).join(papers(spark, d).select(F.col("paper_id").alias("src"), "year"), "src")
    return e.join(authorship(spark, d).select(F.col("paper_id").alias("dst"), "author_id"), "dst").groupBy("author_id").agg(r6(F.sum(decayed())).alias("score"))


@query("AG10_having", "SELECT o_custkey, count(*)::BIGINT AS n, count(DISTINCT o_orderpriority)::BIGINT AS k FROM orders GROUP BY 1 HAVING count(*) > 1")
def having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("k")).where("n > 1")


_BASKETS = "b AS (SELECT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))


@query("AG11_lift", f"""
WITH {_BASKETS}, m AS (SELECT basket, item, count(*) AS m FROM b GROUP BY 1, 2), f AS (SELECT item, count(*) AS f FROM b GROUP BY 1),
p AS (SELECT x.item AS a, y.item AS b, sum(x.m * y.m) AS f12 FROM m x JOIN m y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
SELECT a, b, round(f12 * (SELECT count(DISTINCT basket) FROM b) / (x.f * y.f), 6) AS lift FROM p JOIN f x ON x.item = a JOIN f y ON y.item = b
WHERE f12 * (SELECT count(DISTINCT basket) FROM b) / (x.f * y.f) >= 1""")
def lift(spark: SparkSession, d: str) -> DataFrame:
    return C.lift_rules(baskets(spark, d)).withColumn("lift", r6("lift"))


@query("AG12_leverage", f"""
WITH {_BASKETS}, s AS (SELECT DISTINCT * FROM b), f AS (SELECT item, count(*) AS f FROM s GROUP BY 1),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS f12 FROM s x JOIN s y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2)
SELECT a, b, round(f12 / x.f - y.f / (SELECT count(DISTINCT basket) FROM s), 6) AS interest FROM p JOIN f x ON x.item = a JOIN f y ON y.item = b""")
def leverage(spark: SparkSession, d: str) -> DataFrame:
    return C.leverage_rules(baskets(spark, d), -1.0).withColumn("interest", r6("interest"))


@query("AG13_max_normalised", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (), 6) AS w FROM orders")
def max_normalised(spark: SparkSession, d: str) -> DataFrame:
    return C.normalised(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("w")), "w").withColumn("w", r6("w"))


@query("AG14_normalised", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (), 6) AS by_sum, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS by_range FROM supplier")
def by_sum_and_range(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("by_sum"), F.col("s_acctbal").alias("by_range"))
    return C.normalised(C.normalised(s, "by_sum", "sum"), "by_range", "range").select("s_suppkey", r6("by_sum").alias("by_sum"), r6("by_range").alias("by_range"))


@query("AG15_median_year", f"WITH {ctes('papers')} SELECT venue, median(year)::DOUBLE AS year FROM papers WHERE year > 0 GROUP BY 1")
def median_year(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).where("year > 0").groupBy("venue").agg(F.median("year").alias("year"))


@query("AG16_trimmed_mean", "WITH v AS (SELECT c_nationkey, list_reverse_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1) SELECT c_nationkey, round(list_avg(v[1:greatest(len(v) // 2, 1)]), 6) AS score FROM v")
def trimmed(spark: SparkSession, d: str) -> DataFrame:
    return R.upper_half_mean(table(spark, d, "customer"), "c_nationkey", "c_acctbal").select("c_nationkey", r6("score").alias("score"))


_RANKINGS = f"""WITH {ctes("fact")}, {CREDIT},
m1 AS (SELECT affil_id, row_number() OVER (ORDER BY sum(score) DESC, affil_id) - 1 AS rank0 FROM credit GROUP BY 1),
m2 AS (SELECT affil_id, row_number() OVER (ORDER BY count(DISTINCT paper_id) DESC, affil_id) - 1 AS rank0 FROM fact WHERE affil_id % 3 > 0 GROUP BY 1)"""


def two_rankings(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    a = C.ranked(C.fractional_credit(f), "affil_id")
    b = C.ranked(f.where("affil_id % 3 > 0").groupBy("affil_id").agg(F.countDistinct("paper_id").alias("score")), "affil_id")
    return a.select(F.lit("credit").alias("method"), "affil_id", (F.col("rank") - 1).alias("rank0")).union(b.select(F.lit("papers"), "affil_id", F.col("rank") - 1))


@query("AG17_bagging", f"{_RANKINGS} SELECT affil_id, round(2 * (SELECT count(*) FROM m1) - (m1.rank0 + coalesce(m2.rank0, 0)) / 2, 6) AS score FROM m1 LEFT JOIN m2 USING (affil_id)")
def bagging(spark: SparkSession, d: str) -> DataFrame:
    return C.bagging(two_rankings(spark, d), 2, "affil_id").select("affil_id", r6("score").alias("score"))


@query("AG18_mean_and_deviation", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS deviation FROM orders GROUP BY 1")
def mean_and_deviation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("deviation"))


@query("AG20_most_common", "SELECT l_suppkey, l_returnflag, n FROM (SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 2")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return C.top_k(n, ("l_suppkey",), "n", "l_returnflag", 2).drop("rank")


@query("AG21_best_duplicate", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_duplicate(spark: SparkSession, d: str) -> DataFrame:
    # one row a key: an aggregation with partial maxima instead of a window
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))).alias("o_orderkey"))


@query("AG22_density", f"WITH {ctes('papers', 'citations')} SELECT round((SELECT count(*) FROM citations) / (SELECT count(*) FROM papers), 6) AS density")
def density(spark: SparkSession, d: str) -> DataFrame:
    e, n = citations(spark, d).agg(F.count("*").alias("e")), papers(spark, d).agg(F.count("*").alias("n"))
    return e.crossJoin(n).select(r6(F.col("e") / F.col("n")).alias("density"))


@query("WN1_rank", f"WITH {ctes('fact')}, {CREDIT} SELECT affil_id, row_number() OVER (ORDER BY round(sum(score), 6) DESC, affil_id)::INT AS rank FROM credit GROUP BY 1")
def rank(spark: SparkSession, d: str) -> DataFrame:
    return C.ranked(C.fractional_credit(fact(spark, d)).withColumn("score", r6("score")), "affil_id").select("affil_id", "rank")


@query("WN2_top_of_type", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_of_type(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    least = c.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    return c.join(F.broadcast(least), "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("WN3_top_k_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 10")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return C.top_k(table(spark, d, "customer"), ("c_nationkey",), "c_acctbal", "c_custkey", 10).select("c_nationkey", "c_custkey")


@query("WN4_top_or_threshold", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2 OR l_quantity >= 45")
def top_or_threshold(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 2 OR l_quantity >= 45").select("l_orderkey", "l_linenumber")


@query("WN10_paging", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def paging(spark: SparkSession, d: str) -> DataFrame:
    return R.select(table(spark, d, "orders"), "o_orderkey", order_by=["o_orderkey"], limit=100, offset=50)


@query("SET1_union", f"WITH {ctes('citations')} SELECT src AS paper_id FROM citations UNION SELECT dst FROM citations")
def union(spark: SparkSession, d: str) -> DataFrame:
    c = citations(spark, d)
    return c.select(F.col("src").alias("paper_id")).union(c.select("dst")).distinct()


@query("SET2_upsert", "SELECT s_suppkey, 'new' AS origin FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'old' FROM supplier WHERE NOT s_acctbal > 0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return R.upsert(s.select("s_suppkey", F.lit("old").alias("origin")), s.where("s_acctbal > 0").select("s_suppkey", F.lit("new").alias("origin")), "s_suppkey")


@query("SET3_intersection", f"WITH {ctes('citations')} SELECT src AS paper_id FROM citations INTERSECT SELECT dst FROM citations")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    c = citations(spark, d)
    return c.select(F.col("src").alias("paper_id")).intersect(c.select("dst"))


@query("SET4_difference", f"WITH {ctes('papers', 'citations')} SELECT paper_id FROM papers EXCEPT SELECT src FROM citations")
def difference(spark: SparkSession, d: str) -> DataFrame:
    return R.without(papers(spark, d).select("paper_id"), citations(spark, d).select(F.col("src").alias("paper_id")), "paper_id")


@query("SET5_distinct_structures", f"WITH {ctes('authorship')}, t AS (SELECT list_sort(list(author_id)) AS team FROM authorship GROUP BY paper_id) SELECT DISTINCT array_to_string(team, ',') AS team FROM t")
def distinct_structures(spark: SparkSession, d: str) -> DataFrame:
    t = authorship(spark, d).groupBy("paper_id").agg(F.array_sort(F.collect_list("author_id")).alias("team"))
    return t.dropDuplicates(["team"]).select(F.array_join(F.col("team").cast("array<string>"), ",").alias("team"))


@query("SNK6_rank_table", f"WITH {ctes('fact')}, {CREDIT} SELECT venue, affil_id, (row_number() OVER (PARTITION BY venue ORDER BY round(sum(score), 6) DESC, affil_id) - 1)::INT AS rank0, round(sum(score), 6) AS score FROM credit GROUP BY 1, 2")
def rank_table(spark: SparkSession, d: str) -> DataFrame:
    s = C.fractional_credit(fact(spark, d), ("venue", "affil_id")).withColumn("score", r6("score"))
    return C.ranked(s, "affil_id", within=("venue",)).select("venue", "affil_id", (F.col("rank") - 1).alias("rank0"), "score")


@query("SNK7_concatenate", "SELECT 'customer' AS phase, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def concatenate(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("customer").alias("phase"), F.col("c_custkey").alias("id"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("phase"), F.col("s_suppkey").alias("id")))


@query("SNK10_letor", f"WITH {ctes('fact')}, {CREDIT}, s AS (SELECT affil_id, sum(score) AS score, count(*) AS n FROM credit GROUP BY 1), p AS (SELECT affil_id, count(DISTINCT paper_id) AS papers FROM fact GROUP BY 1) SELECT round(10 * round(score, 6))::BIGINT || ' qid:1 1:' || papers || ' 2:' || n AS line FROM s JOIN p USING (affil_id)")
def letor(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    c = C.fractional_credit(f, ("affil_id", "year", "venue")).groupBy("affil_id").agg(r6(F.sum("score")).alias("score"), F.count("*").alias("n"))
    p = f.groupBy("affil_id").agg(F.countDistinct("paper_id").alias("papers"))
    return c.join(p, "affil_id").select(F.concat_ws(" ", F.round(10 * F.col("score")).cast("long").cast("string"), F.lit("qid:1"), F.concat(F.lit("1:"), "papers"), F.concat(F.lit("2:"), "n")).alias("line"))


@query("SNK13_plot_data", "SELECT o_orderpriority, year(o_orderdate)::INT AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def plot_data(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("SNK14_query_set", "SELECT item_id AS query_id, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS query, CASE WHEN quality = 1 THEN 'R2' ELSE 'R1' END AS relev FROM benchmark JOIN labels ON item_id = doc_id")
def query_set(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "benchmark").join(table(spark, d, "labels"), F.col("item_id") == F.col("doc_id"))
    return j.select(F.col("item_id").alias("query_id"), F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", "").alias("query"), F.when(F.col("quality") == 1, "R2").otherwise("R1").alias("relev"))


@query("QRY18_dataset_statistics", f"""
WITH {ctes("fact", "citations")} SELECT 'papers' AS what, count(*)::BIGINT AS n FROM papers UNION ALL SELECT 'authors', count(DISTINCT author_id) FROM authorship
UNION ALL SELECT 'affils', count(DISTINCT affil_id) FROM fact UNION ALL SELECT 'venues', count(DISTINCT venue) FROM papers UNION ALL SELECT 'citations', count(*) FROM citations""")
def statistics(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    parts = [("papers", p.agg(F.count("*").alias("n"))), ("authors", authorship(spark, d).agg(F.countDistinct("author_id"))), ("affils", fact(spark, d).agg(F.countDistinct("affil_id"))), ("venues", p.agg(F.countDistinct("venue"))), ("citations", citations(spark, d).agg(F.count("*")))]
    out = None
    for name, one in parts:
        row = one.select(F.lit(name).alias("what"), F.col(one.columns[0]).alias("n"))
        out = row if out is None else out.union(row)
    return out
