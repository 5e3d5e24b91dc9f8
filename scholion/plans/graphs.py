"""Queries over layered graphs and random walks.

All walks run until their L1 change is under 1e-8; so do the SQL twins, which
unroll their steps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.fixtures import CURRENT_YEAR, affiliation, authorship, candidates, citations, ctes, fact, papers, table
from scholion.operators import credit as C
from scholion.operators import graph as G
from scholion.operators import relational as R
from scholion.plans.registry import query
from scholion.plans.relational import CREDIT, DECAY_SQL, _project_sql, author_to_affil, project, r6
from scholion.runtime import checkpointed

def r9(c: str) -> F.Column:
    return F.round(F.col(c), 9)


def steps_to(teleport: float, tolerance: float = 1e-8) -> int:
    """Steps after which a walk has surely converged: a step shrinks the L1 change to 1 - teleport of it, from 2 at most."""
    return math.ceil(math.log(tolerance / 2) / math.log(1 - teleport)) + 2


def walk_sql(teleport: float, personal: str | None = None, p: str | None = None, dangling: str = "uniform", start: bool = False) -> str:
    """CTEs that walk over n(node) and e(src, dst, weight) until the L1 change is under 1e-8; the last, x, is (node, score).

    As many steps are unrolled as any graph can need; once the change is small
    enough, the later ones hand the vector on.
    """
    p = p or "SELECT src, dst, coalesce(weight / nullif(sum(weight) OVER (PARTITION BY src), 0), 0) AS p FROM e"
    pers = f"coalesce((SELECT weight FROM ({personal}) q WHERE q.node = n.node), 0) / (SELECT sum(weight) FROM ({personal}))" if personal else "1.0::DOUBLE / (SELECT count(*) FROM n)"
    out = f"""p AS MATERIALIZED ({p}),
x0 AS MATERIALIZED (SELECT node, {pers if start else "1.0::DOUBLE / (SELECT count(*) FROM n)"} AS score, {pers} AS pers, node NOT IN (SELECT src FROM p) AS dangles, false AS done FROM n)"""
    steps = steps_to(teleport)
    spread = "lost / (SELECT count(*) FROM n)" if dangling == "uniform" else "lost * pers"
    for k in range(steps):
        out += f""",
y{k} AS MATERIALIZED (SELECT node, pers, dangles, done, score, (1 - {teleport}::DOUBLE) * (coalesce(f, 0) + {spread}) + {teleport}::DOUBLE * pers AS y FROM x{k}
  LEFT JOIN (SELECT dst AS node, sum(score * p) AS f FROM p JOIN x{k} ON src = node WHERE NOT done GROUP BY 1) USING (node), (SELECT coalesce(sum(score) FILTER (dangles), 0) AS lost FROM x{k})),
x{k + 1} AS MATERIALIZED (SELECT node, pers, dangles, CASE WHEN done THEN score ELSE y / t END AS score, done OR sum(abs(y / t - score)) OVER () < 1e-8 AS done FROM y{k}, (SELECT sum(y) AS t FROM y{k}))"""
    return out + f", x AS (SELECT node, score FROM x{steps})"


_AFFIL_GRAPH = f"WITH {ctes('fact', 'citations')}, n AS (SELECT n_nationkey AS node FROM nation), e AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM ({_project_sql('affil_id')}))"
_AUTHOR_GRAPH = f"WITH {ctes('fact', 'citations')}, n AS (SELECT s_suppkey AS node FROM supplier), e AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM ({_project_sql('author_id')}))"


def affil_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = project(citations(spark, d), fact(spark, d), papers(spark, d).select("paper_id", "year"), "affil_id")
    return candidates(spark, d).select(F.col("affil_id").alias("node")), e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def author_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = project(citations(spark, d), fact(spark, d), papers(spark, d).select("paper_id", "year"), "author_id")
    return affiliation(spark, d).select(F.col("author_id").alias("node")), e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


@query("GR1_pagerank", f"{_AFFIL_GRAPH}, {walk_sql(0.3, personal='SELECT node, node + 1 AS weight FROM n')} SELECT node, round(score, 9) AS score FROM x")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    n, e = affil_graph(spark, d)
    return G.pagerank(n, e, 0.3, n.select("node", (F.col("node") + 1.0).alias("weight"))).select("node", r9("score").alias("score"))


_METROPOLIS = """WITH o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), s AS (
  SELECT t.src, t.dst, t.p * CASE WHEN coalesce(v.n, 0) = 0 THEN 1.0 ELSE least(1.0::DOUBLE, u.n / v.n) END AS p
  FROM (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e) t JOIN o u ON u.src = t.src LEFT JOIN o v ON v.src = t.dst WHERE t.src <> t.dst)
SELECT * FROM s UNION ALL SELECT src, src, 1 - sum(p) FROM s GROUP BY 1 UNION ALL SELECT node, node, 1.0::DOUBLE FROM n WHERE node NOT IN (SELECT src FROM s)"""


@query("GR2_metropolis", f"{_AFFIL_GRAPH}, {walk_sql(0.3, p=_METROPOLIS)} SELECT node, round(score, 9) AS score FROM x")
def metropolis(spark: SparkSession, d: str) -> DataFrame:
    n, e = affil_graph(spark, d)
    return G.pagerank(n, e, 0.3, kind="metropolis").select("node", r9("score").alias("score"))


@query("GR3_single_layer", f"{_AUTHOR_GRAPH}, {walk_sql(0.9)} SELECT node, round(score, 9) AS score FROM x")
def single_layer(spark: SparkSession, d: str) -> DataFrame:
    n, e = author_graph(spark, d)
    return G.pagerank(n, e, 0.9).select("node", r9("score").alias("score"))


_PRIOR = "SELECT node, 0.7::DOUBLE * coalesce(s, 0) / (SELECT sum(score) FROM credit) + 0.3::DOUBLE / (SELECT count(*) FROM n) AS weight FROM n LEFT JOIN (SELECT affil_id AS node, sum(score) AS s FROM credit GROUP BY 1) USING (node)"


@query("GR4_projected_affil", f"{_AFFIL_GRAPH}, {CREDIT}, {walk_sql(0.7, personal=_PRIOR)} SELECT node, round(score, 9) AS score FROM x")
def projected_affil(spark: SparkSession, d: str) -> DataFrame:
    n, e = affil_graph(spark, d)
    scores = C.with_zero(candidates(spark, d), C.fractional_credit(fact(spark, d))).select(F.col("affil_id").alias("node"), "score")
    return G.pagerank(n, e, 0.7, G.mixed_prior(scores, 0.7, n.count())).select("node", r9("score").alias("score"))


def _layers_sql(rho: dict[tuple[str, str], float], layered: str) -> str:
    """CTEs l (layered edges), e and n of the weighted layered graph."""
    rows = ", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for (a, b), v in rho.items() if v)
    return f"""l AS MATERIALIZED ({layered}), rho(a, b, r) AS (VALUES {rows}),
e AS MATERIALIZED (SELECT src_layer || ':' || src AS src, dst_layer || ':' || dst AS dst,
  coalesce(weight * r / nullif(max(weight) OVER (PARTITION BY src_layer, src, dst_layer), 0), 0) AS weight FROM l JOIN rho ON src_layer = a AND dst_layer = b),
n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


_OUT = "SELECT split_part(node, ':', 1) AS layer, substr(node, instr(node, ':') + 1) AS id, round(score, 9) AS score FROM x"
_AA = "SELECT 'author' AS src_layer, a::VARCHAR AS src, 'author' AS dst_layer, b::VARCHAR AS dst, weight FROM aa"
_AF = "SELECT 'author', author_id::VARCHAR, 'affil', affil_id::VARCHAR, 1.0::DOUBLE FROM affiliation UNION ALL SELECT 'affil', affil_id::VARCHAR, 'author', author_id::VARCHAR, 1.0::DOUBLE FROM affiliation"
_PA = "SELECT 'paper', paper_id::VARCHAR, 'author', author_id::VARCHAR, 1.0::DOUBLE FROM authorship UNION ALL SELECT 'author', author_id::VARCHAR, 'paper', paper_id::VARCHAR, 1.0::DOUBLE FROM authorship"
_RHO2 = {("author", "author"): 0.7, ("author", "affil"): 0.3, ("affil", "author"): 0.3, ("affil", "affil"): 0.7}
_S = "s AS (SELECT author_id, count(*)::DOUBLE AS score FROM authorship GROUP BY 1)"


def rank_out(ranked: DataFrame) -> DataFrame:
    return ranked.select("layer", "id", r9("score").alias("score"))


def _as_edges(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"))


def affil_edges(spark: SparkSession, d: str) -> tuple[DataFrame, str, str, bool]:
    return _as_edges(affiliation(spark, d), "author_id", "affil_id"), "author", "affil", True


def even(*pairs: tuple[str, str]) -> set[tuple[str, str]]:
    """Both ways between layers whose edges all weigh 1."""
    return {*pairs, *((b, a) for a, b in pairs)}


def two_layers(spark: SparkSession, d: str) -> DataFrame:
    """Authors and institutions: author citations, affiliations, and institutions joined by their authors' scores."""
    aa = checkpointed(project(citations(spark, d), fact(spark, d), papers(spark, d).select("paper_id", "year"), "author_id"))
    scores = authorship(spark, d).groupBy("author_id").agg(F.count("*").cast("double").alias("score"))
    ff = author_to_affil(aa, affiliation(spark, d), scores)
    return G.assemble((_as_edges(aa, "a", "b", "weight"), "author", "author", False, True), affil_edges(spark, d), (_as_edges(ff, "a", "b", "weight"), "affil", "affil", False, True))


_TWO = f"""{_AA} UNION ALL {_AF} UNION ALL SELECT 'affil', f.affil_id::VARCHAR, 'affil', g.affil_id::VARCHAR, sum(s.score)
FROM aa JOIN s ON s.author_id = aa.a JOIN affiliation f ON f.author_id = aa.a JOIN affiliation g ON g.author_id = aa.b WHERE f.affil_id <> g.affil_id GROUP BY f.affil_id, g.affil_id"""
_WITH_TWO = f"WITH {ctes('fact', 'citations')}, aa AS MATERIALIZED ({_project_sql('author_id')}), {_S}, {CREDIT}"
_PRIOR2 = """SELECT 'author:' || author_id AS node, 0.5 * score / (SELECT sum(score) FROM s) + 0.5::DOUBLE / (SELECT count(*) FROM s) AS weight FROM s
UNION ALL SELECT 'affil:' || affil_id, 0.5 * sum(score) / (SELECT sum(score) FROM credit) + 0.5::DOUBLE / (SELECT count(DISTINCT affil_id) FROM credit) FROM credit GROUP BY affil_id"""


def priors(scores: DataFrame, layer: str, key: str, share: float) -> DataFrame:
    s = checkpointed(scores.select(F.concat(F.lit(f"{layer}:"), F.col(key).cast("string")).alias("node"), "score"))
    return G.mixed_prior(s, share, s.count())


@query("GR5_author_affil", f"{_WITH_TWO}, {_layers_sql(_RHO2, _TWO)}, {walk_sql(0.9, personal=_PRIOR2)} {_OUT}")
def author_affil(spark: SparkSession, d: str) -> DataFrame:
    authors = authorship(spark, d).groupBy("author_id").agg(F.count("*").cast("double").alias("score"))
    p = priors(authors, "author", "author_id", 0.5).union(priors(C.fractional_credit(fact(spark, d)), "affil", "affil_id", 0.5))
    return rank_out(G.rank_layers(two_layers(spark, d), _RHO2, 0.9, p, even=even(("author", "affil"))))


_RHO3 = G.institution_rho(0.99, 0.01, 0.9) | {("affil", "author"): 0.9, ("affil", "affil"): 0.1}
_RHO7 = G.institution_rho(0.99, 0.01, 0.99)
_PP = f"SELECT 'paper' AS src_layer, src::VARCHAR AS src, 'paper' AS dst_layer, dst::VARCHAR AS dst, {DECAY_SQL.replace('0.2', '0.1')} AS weight FROM citations JOIN papers ON dst = paper_id"
_CO = "SELECT 'author', x.author_id::VARCHAR, 'author', y.author_id::VARCHAR, (1 + ln(count(*)))::DOUBLE FROM authorship x JOIN authorship y USING (paper_id) WHERE x.author_id <> y.author_id GROUP BY x.author_id, y.author_id"
_THREE = f"{_PP} UNION ALL {_PA} UNION ALL {_CO} UNION ALL {_AF}"
_PRIOR3 = "SELECT 'affil:' || affil_id AS node, 0.5 * sum(score) / (SELECT sum(score) FROM credit) + 0.5::DOUBLE / (SELECT count(DISTINCT affil_id) FROM credit) AS weight FROM credit GROUP BY affil_id"


EVEN3 = even(("paper", "author"), ("author", "affil"))


def coauthor_edges(spark: SparkSession, d: str) -> DataFrame:
    p = R.pairs_in_group(authorship(spark, d), "paper_id", "author_id")
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst"), (1 + F.log("n")).alias("weight"))


def paper_edges(spark: SparkSession, d: str, age: float = 0.1) -> DataFrame:
    """Citations, weighted by the age of the cited paper."""
    e = citations(spark, d).join(papers(spark, d).select(F.col("paper_id").alias("dst"), "year"), "dst")
    return e.select("src", "dst", C.decay(F.col("year"), age, CURRENT_YEAR, 1995).alias("weight"))


def three_layers(spark: SparkSession, d: str) -> DataFrame:
    """Papers, authors and institutions."""
    return G.assemble(
        (paper_edges(spark, d), "paper", "paper", False, True),
        (_as_edges(authorship(spark, d), "paper_id", "author_id"), "paper", "author", True, True),
        (coauthor_edges(spark, d), "author", "author", True, True),
        affil_edges(spark, d),
    )


@query("GR6_paper_author_affil", f"WITH {ctes('fact', 'citations')}, {CREDIT}, {_layers_sql(_RHO3, _THREE)}, {walk_sql(0.4, personal=_PRIOR3)} {_OUT}")
def paper_author_affil(spark: SparkSession, d: str) -> DataFrame:
    p = priors(C.fractional_credit(fact(spark, d)), "affil", "affil_id", 0.5)
    return rank_out(G.rank_layers(three_layers(spark, d), _RHO3, 0.4, p, even=EVEN3))


@query("GR7_multi_layered", f"WITH {ctes('fact', 'citations')}, {_layers_sql(_RHO7, _THREE)}, {walk_sql(0.4)} {_OUT}")
def multi_layered(spark: SparkSession, d: str) -> DataFrame:
    return rank_out(G.rank_layers(three_layers(spark, d), _RHO7, 0.4, even=EVEN3))


_RHO8 = G.star_rho({"paper": 0.25, "author": 0.25, "venue": 0.25, "affil": 0.25}, "paper")
_FOUR = f"""{_PP} UNION ALL {_PA} UNION ALL {_CO} UNION ALL SELECT 'paper', paper_id::VARCHAR, 'venue', venue, 1.0::DOUBLE FROM papers UNION ALL SELECT 'venue', venue, 'paper', paper_id::VARCHAR, 1.0::DOUBLE FROM papers
UNION ALL SELECT DISTINCT 'paper', paper_id::VARCHAR, 'affil', affil_id::VARCHAR, 1.0::DOUBLE FROM fact UNION ALL SELECT DISTINCT 'affil', affil_id::VARCHAR, 'paper', paper_id::VARCHAR, 1.0::DOUBLE FROM fact"""
_PRIOR8 = "SELECT 'paper:' || o_orderkey AS node, 0.3 * o_totalprice / (SELECT sum(o_totalprice) FROM orders) + 0.7::DOUBLE / (SELECT count(*) FROM orders) AS weight FROM orders"


@query("GR8_query_layers", f"WITH {ctes('fact', 'citations')}, {_layers_sql(_RHO8, _FOUR)}, q AS MATERIALIZED ({_PRIOR8}), {walk_sql(0.3, personal='SELECT q.node, q.weight FROM q JOIN n nn ON nn.node = q.node')} {_OUT}")
def query_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = G.assemble(
        (paper_edges(spark, d), "paper", "paper", False, True),
        (_as_edges(authorship(spark, d), "paper_id", "author_id"), "paper", "author", True, True),
        (coauthor_edges(spark, d), "author", "author", True, True),
        (_as_edges(papers(spark, d), "paper_id", "venue"), "paper", "venue", True),
        (_as_edges(fact(spark, d).select("paper_id", "affil_id").distinct(), "paper_id", "affil_id"), "paper", "affil", True, True),
    )
    p = priors(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score")), "paper", "o_orderkey", 0.3)
    return rank_out(G.rank_layers(layers, _RHO8, 0.3, p, even=even(("paper", "author"), ("paper", "venue"), ("paper", "affil"))))


@query("LW1_layer_weights", f"WITH {ctes('fact', 'citations')}, {_layers_sql(_RHO7, _THREE)} SELECT src, dst, round(weight, 6) AS weight FROM e")
def layer_weights(spark: SparkSession, d: str) -> DataFrame:
    w = G.layer_weights(three_layers(spark, d), _RHO7, even=EVEN3)
    return w.select(F.concat_ws(":", "src_layer", "src").alias("src"), F.concat_ws(":", "dst_layer", "dst").alias("dst"), r6("weight").alias("weight"))


@query("LW2_attenuators", "WITH m AS (SELECT median(year(o_orderdate)) AS m FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000) SELECT o_orderkey, round(exp(-0.1 * (2001 - CASE WHEN year(o_orderdate) BETWEEN 1996 AND 2000 THEN year(o_orderdate) ELSE m END)), 6) AS age, round(exp(-0.5 * (1 - o_totalprice / 1000000)), 6) AS context FROM orders, m")
def attenuators(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    o = G.imputed_year(o, "year", 1996, 2000)
    return o.select("o_orderkey", r6(G.age_attenuator(F.col("year"), 0.1, 2001)).alias("age"), r6(G.context_attenuator(F.col("o_totalprice") / 1000000, 0.5)).alias("context"))


_PAPER_GRAPH = f"WITH {ctes('papers', 'citations')}, n AS (SELECT paper_id AS node FROM papers), e AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM citations)"


def paper_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return papers(spark, d).select(F.col("paper_id").alias("node")), citations(spark, d).withColumn("weight", F.lit(1.0))


def _katz_sql(steps: int) -> str:
    out = "k0 AS (SELECT node, 0.0::DOUBLE AS score FROM n)"
    for k in range(steps):
        out += f", k{k + 1} AS MATERIALIZED (SELECT node, 0.01::DOUBLE * coalesce(f, 0) + 1 AS score FROM n LEFT JOIN (SELECT dst AS node, sum(score * weight) AS f FROM e JOIN k{k} ON src = node GROUP BY 1) USING (node))"
    return f"{out} SELECT node, round(score / sqrt((SELECT sum(score * score) FROM k{steps})), 9) AS score FROM k{steps}"


@query("GR9_katz", f"{_PAPER_GRAPH}, {_katz_sql(20)}")
def katz(spark: SparkSession, d: str) -> DataFrame:
    n, e = paper_graph(spark, d)
    return G.katz(n, e).select("node", r9("score").alias("score"))


def _hits_sql(steps: int) -> str:
    out = "h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS hub, 0.0::DOUBLE AS authority, false AS done FROM (SELECT src AS node FROM e UNION SELECT dst FROM e))"
    for k in range(steps):
        out += f""", a{k} AS MATERIALIZED (SELECT dst AS node, sum(hub * weight) AS a FROM e JOIN h{k} ON src = node GROUP BY 1),
b{k} AS MATERIALIZED (SELECT src AS node, sum(a * weight) AS b FROM e JOIN a{k} ON dst = node GROUP BY 1),
h{k + 1} AS MATERIALIZED (SELECT node, CASE WHEN done THEN hub ELSE h END AS hub, CASE WHEN done THEN authority ELSE u END AS authority, done OR sum(abs(h - hub)) OVER () < 1e-8 AS done
  FROM (SELECT node, hub, authority, done, coalesce(b, 0) / (SELECT sum(b) FROM b{k}) AS h, coalesce(a, 0) / (SELECT sum(a) FROM a{k}) AS u FROM h{k} LEFT JOIN a{k} USING (node) LEFT JOIN b{k} USING (node)))"""
    return f"{out} SELECT node, round(hub, 9) AS hub, round(authority, 9) AS authority FROM h{steps}"


@query("GR9_hits", f"{_AFFIL_GRAPH}, {_hits_sql(60)}")
def hits(spark: SparkSession, d: str) -> DataFrame:
    return G.hits(affil_graph(spark, d)[1]).select("node", r9("hub").alias("hub"), r9("authority").alias("authority"))


@query("GR9_stock_pagerank", f"{_PAPER_GRAPH}, {walk_sql(0.15, dangling='personal')} SELECT node, round(score, 9) AS score FROM x")
def stock(spark: SparkSession, d: str) -> DataFrame:
    n, e = paper_graph(spark, d)
    return G.pagerank(n, e, 0.15, dangling="personal").select("node", r9("score").alias("score"))


_CITERANK = "SELECT paper_id AS node, exp((year - 2001) / 2.6::DOUBLE) AS weight FROM papers"


@query("GR10_citerank", f"{_PAPER_GRAPH}, w AS MATERIALIZED ({_CITERANK}), {walk_sql(0.5, personal='SELECT node, weight FROM w', dangling='personal')} SELECT node, round(score, 9) AS score FROM x")
def citerank(spark: SparkSession, d: str) -> DataFrame:
    n, e = paper_graph(spark, d)
    w = papers(spark, d).select(F.col("paper_id").alias("node"), F.exp((F.col("year") - 2001) / 2.6).alias("weight"))
    return G.pagerank(n, e, 0.5, w, dangling="personal").select("node", r9("score").alias("score"))


@query("GR11_betweenness")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    n, e = affil_graph(spark, d)
    edges = [(r["src"], r["dst"]) for r in e.select("src", "dst").collect()]  # institutions: at most 25 x 25
    return spark.createDataFrame(sorted(G.betweenness(edges, [r[0] for r in n.collect()]).items()), "node int, score double")


@query("GR12_paper_layer", f"""
WITH {ctes("papers", "citations")}, s AS (SELECT paper_id FROM papers WHERE year = 1998 AND venue = '2-HIGH'),
h AS (SELECT paper_id FROM s UNION SELECT dst FROM citations WHERE src IN (FROM s) UNION SELECT src FROM citations WHERE dst IN (FROM s))
SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM citations WHERE src <> dst AND src IN (FROM h) AND dst IN (FROM h)""")
def paper_layer(spark: SparkSession, d: str) -> DataFrame:
    c = citations(spark, d)
    docs = R.expand(c, papers(spark, d).where("year = 1998 AND venue = '2-HIGH'"), 1, "paper_id")
    return R.induced(c, docs, "paper_id").withColumn("weight", F.lit(1.0))


@query("GR13_author_layer", f"WITH {ctes('authorship')} SELECT x.author_id AS src, y.author_id AS dst, round(1 + ln(count(*)), 6) AS weight FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author_id < y.author_id GROUP BY 1, 2")
def author_layer(spark: SparkSession, d: str) -> DataFrame:
    return coauthor_edges(spark, d).withColumn("weight", r6("weight"))


@query("GR14_affil_layer", f"WITH {ctes('fact')} SELECT DISTINCT author_id AS src, affil_id AS dst FROM fact WHERE year = 1997")
def affil_layer(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d).where("year = 1997").select(F.col("author_id").alias("src"), F.col("affil_id").alias("dst")).distinct()


@query("GR15_venue_layer", f"WITH {ctes('papers')} SELECT paper_id, coalesce(nullif(venue, ''), 'none') AS venue, round(1.0::DOUBLE * n / max(n) OVER (), 6) AS weight FROM papers JOIN (SELECT venue, count(*) AS n FROM papers GROUP BY 1) USING (venue)")
def venue_layer(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    n = C.normalised(p.groupBy("venue").agg(F.count("*").cast("double").alias("weight")), "weight")
    return p.join(n, "venue").select("paper_id", F.coalesce(F.nullif("venue", F.lit("")), F.lit("none")).alias("venue"), r6("weight").alias("weight"))


@query("GR16_assemble", f"WITH {ctes('fact', 'citations')}, l AS ({_THREE}) SELECT src_layer, src, dst_layer, dst, round(max(weight), 6) AS weight FROM l GROUP BY ALL HAVING true ORDER BY ALL".replace("GROUP BY ALL HAVING true ORDER BY ALL", "GROUP BY src_layer, src, dst_layer, dst"))
def assemble(spark: SparkSession, d: str) -> DataFrame:
    return three_layers(spark, d).withColumn("weight", r6("weight"))


@query("GR17_attributes", f"WITH {ctes('authorship')} SELECT s_suppkey AS author_id, s_name AS name, n_name AS affil, coalesce(n, 0)::BIGINT AS npapers FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT author_id, count(*) AS n FROM authorship GROUP BY 1) ON author_id = s_suppkey")
def attributes(spark: SparkSession, d: str) -> DataFrame:
    n = authorship(spark, d).groupBy("author_id").agg(F.count("*").alias("npapers"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"), F.col("n_name").alias("affil")).join(n, "author_id", "left").withColumn("npapers", F.coalesce("npapers", F.lit(0).cast("long")))


@query("GR18_top_cited", f"WITH {ctes('authorship', 'citations')} SELECT author_id AS node, count(*)::BIGINT AS score FROM citations JOIN authorship ON dst = paper_id GROUP BY 1")
def top_cited(spark: SparkSession, d: str) -> DataFrame:
    e = citations(spark, d).join(authorship(spark, d), F.col("dst") == F.col("paper_id")).select("src", F.col("author_id").alias("dst"))
    return G.in_degree(e)


@query("GR19_weighted_citations", f"""
WITH {ctes("papers", "citations")}, s AS (SELECT dst AS node, sum(exp(-0.5 * (1 - o_totalprice / 1000000))) AS s, count(*) AS n FROM citations JOIN orders ON src = o_orderkey GROUP BY 1)
SELECT paper_id AS node, round(coalesce(s * exp(-0.3 * (1 - paper_id % 10 / 10)) * exp(-0.01 * (2001 - year)) * n ** -0.5, 0), 6) AS score FROM papers LEFT JOIN s ON node = paper_id""")
def weighted_citations(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_totalprice") / 1000000).alias("weight"))
    docs = papers(spark, d).select(F.col("paper_id").alias("node"), "year", (F.col("paper_id") % 10 / 10).alias("q"))
    return G.weighted_citations(citations(spark, d).join(w, "src"), docs, 2001, 0.5, 0.3, 0.01, 0.5).withColumn("score", r6("score"))


@query("GR20_seeded_walk", f"{_AFFIL_GRAPH}, {walk_sql(0.3, personal='SELECT node, 1.0 AS weight FROM n WHERE node % 5 = 0', start=True)} SELECT node, round(score, 9) AS score FROM x")
def seeded_walk(spark: SparkSession, d: str) -> DataFrame:
    n, e = affil_graph(spark, d)
    seeds = n.where("node % 5 = 0").withColumn("weight", F.lit(1.0))
    return G.pagerank(n, e, 0.3, seeds, start=seeds).select("node", r9("score").alias("score"))


@query("GR21_projection_pipeline", f"{_AUTHOR_GRAPH}, {walk_sql(0.9)} SELECT affil_id, round(sum(score), 9) AS score FROM x JOIN affiliation ON author_id = node GROUP BY 1")
def projection_pipeline(spark: SparkSession, d: str) -> DataFrame:
    n, e = author_graph(spark, d)
    x = G.pagerank(n, e, 0.9)
    return x.join(affiliation(spark, d), F.col("node") == F.col("author_id")).groupBy("affil_id").agg(F.round(F.sum("score"), 9).alias("score"))
