"""The searchers' variants, layers of words and topics, and files that are written and read again.

A paper's text is the names of its parts; a query is a list of words, and a
paper matches if one of its parts has all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from scholion.fixtures import affiliation, authorship, citations, ctes, fact, papers, table, texts
from scholion.functions import text as T
from scholion.operators import corpus as K
from scholion.operators import credit as C
from scholion.operators import graph as G
from scholion.operators import learning as L
from scholion.operators import relational as R
from scholion.operators import temporal as TS
from scholion.plans import graphs as PG
from scholion.plans import rankings as PR
from scholion.plans import texts as PT
from scholion.plans.registry import query
from scholion.plans.relational import CREDIT, CREDIT_DECAYED, decayed, r6
from scholion.runtime import checkpointed, scratch_file
from scholion.sources import files as S

QUERY = ("small", "ring")
LIMIT = 20
#: Seeds of a query's subgraph, and how far it grows.
SEEDS, HOPS = 200, 1

_WORDS = "pw AS MATERIALIZED (SELECT DISTINCT l_orderkey AS paper_id, unnest(string_split(lower(p_name), ' ')) AS word FROM lineitem JOIN part ON l_partkey = p_partkey)"
_MATCHED = "matched AS MATERIALIZED (SELECT DISTINCT l_orderkey AS paper_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE list_has_all(string_split(lower(p_name), ' '), ['small', 'ring']))"


def matched(spark: SparkSession, d: str) -> DataFrame:
    """paper_id of the papers that match QUERY."""
    p = table(spark, d, "part").where(F.size(F.array_intersect(F.split(F.lower("p_name"), " "), F.array(*map(F.lit, QUERY)))) == len(QUERY)).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("paper_id")).distinct()


def best(scored: DataFrame, key: str = "node") -> DataFrame:
    return scored.select(F.col(key).alias("node"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node").limit(LIMIT)


_BEST = f"ORDER BY round(score, 9) DESC, node LIMIT {LIMIT}"
_ENDS = "n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)"


def citation_rank(edges: DataFrame) -> DataFrame:
    """Damping 0.7 over the nodes that have an edge; what dangles goes where teleports go."""
    e = edges.select("src", "dst").distinct().withColumn("weight", F.lit(1.0))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return G.pagerank(nodes, e, 0.3, dangling="personal")


_PRE = "e AS MATERIALIZED (SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM citations WHERE src IN (FROM matched) AND dst IN (FROM matched))"


@query("QRY13_pagerank_before", f"WITH {ctes('citations')}, {_MATCHED}, {_PRE}, {_ENDS}, {PG.walk_sql(0.3, dangling='personal')} SELECT node, round(score, 9) AS score FROM x {_BEST}")
def pagerank_before(spark: SparkSession, d: str) -> DataFrame:
    """Only matching papers are in the graph."""
    m = checkpointed(matched(spark, d))
    return best(citation_rank(R.induced(citations(spark, d), m, "paper_id")))


@query("QRY13_pagerank_after", f"{PG._PAPER_GRAPH}, {_MATCHED}, {PG.walk_sql(0.15, dangling='personal')} SELECT node, round(score, 9) AS score FROM x WHERE node IN (FROM matched) {_BEST}")
def pagerank_after(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph is ranked; matching papers are answers."""
    return best(PG.stock(spark, d).join(matched(spark, d).withColumnRenamed("paper_id", "node"), "node", "left_semi"))


_SUBGRAPH = f"""{_MATCHED}, seed AS MATERIALIZED (SELECT o_orderkey AS paper_id FROM orders WHERE o_orderkey IN (FROM matched) ORDER BY o_totalprice DESC, o_orderkey LIMIT {SEEDS}),
h AS MATERIALIZED (SELECT paper_id FROM seed UNION SELECT dst FROM citations WHERE src IN (FROM seed) UNION SELECT src FROM citations WHERE dst IN (FROM seed)),
e AS MATERIALIZED (SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM citations WHERE src <> dst AND src IN (FROM h) AND dst IN (FROM h))"""


def subgraph(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: the citations among the query's best papers and their neighbours."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_totalprice").join(matched(spark, d), "paper_id", "left_semi")
    seeds = checkpointed(o.orderBy(F.desc("o_totalprice"), "paper_id").limit(SEEDS).select("paper_id"))
    c = citations(spark, d)
    return checkpointed(R.induced(c, R.expand(c, seeds, HOPS, "paper_id"), "paper_id"))


@query("QRY13_pagerank_subgraph", f"WITH {ctes('citations')}, {_SUBGRAPH}, {_ENDS}, {PG.walk_sql(0.3, dangling='personal')} SELECT node, round(score, 9) AS score FROM x {_BEST}")
def pagerank_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return best(citation_rank(subgraph(spark, d)))


@query("QRY14_top_cited_subgraph", f"WITH {ctes('citations')}, {_SUBGRAPH} SELECT dst AS node, count(*)::BIGINT AS score FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {LIMIT}")
def top_cited_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.in_degree(subgraph(spark, d)).orderBy(F.desc("score"), "node").limit(LIMIT)


@query("QRY14_weighted_subgraph", f"""
WITH {ctes("papers", "citations")}, {_SUBGRAPH}, {_ENDS}, s AS (SELECT dst AS node, sum(exp(-0.5 * (1 - o_totalprice / 1000000))) AS s, count(*) AS n FROM e JOIN orders ON src = o_orderkey GROUP BY 1)
SELECT node, round(coalesce(s.s * exp(-0.3 * (1 - node % 10 / 10)) * exp(-0.01 * (2001 - year)) * s.n ** -0.5, 0), 9) AS score FROM n JOIN papers ON paper_id = node LEFT JOIN s USING (node) {_BEST}""")
def weighted_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Citations inside the subgraph, weighted by context, query and age."""
    e = subgraph(spark, d)
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_totalprice") / 1000000).alias("weight"))
    ends = e.select(F.col("src").alias("paper_id")).union(e.select("dst")).distinct()
    docs = papers(spark, d).join(ends, "paper_id", "left_semi").select(F.col("paper_id").alias("node"), "year", (F.col("paper_id") % 10 / 10).alias("q"))
    return best(G.weighted_citations(e.join(w, "src"), docs, 2001, 0.5, 0.3, 0.01, 0.5))


@query("QRY15_tfidf_search", PT._search_sql(PT._TFIDF_PART, 10))
def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    return PT.stored_index(spark, d).search(PT.benchmark_terms(spark, d), 10)


@query("QRY15_citerank", f"{PG._PAPER_GRAPH}, {_MATCHED}, w AS MATERIALIZED ({PG._CITERANK}), {PG.walk_sql(0.5, personal='SELECT node, weight FROM w', dangling='personal')} SELECT node, round(score, 9) AS score FROM x WHERE node IN (FROM matched) {_BEST}")
def citerank_search(spark: SparkSession, d: str) -> DataFrame:
    return best(PG.citerank(spark, d).join(matched(spark, d).withColumnRenamed("paper_id", "node"), "node", "left_semi"))


# The token-seeded walk: papers, authors and words, all edges of weight 1

_TOKEN_GRAPH = f"""WITH {ctes('authorship', 'citations')}, {_WORDS}, l AS (SELECT 'paper:' || src AS src, 'paper:' || dst AS dst FROM citations
UNION SELECT 'paper:' || paper_id, 'author:' || author_id FROM authorship UNION SELECT 'author:' || author_id, 'paper:' || paper_id FROM authorship
UNION SELECT 'author:' || x.author_id, 'author:' || y.author_id FROM authorship x JOIN authorship y USING (paper_id) WHERE x.author_id <> y.author_id
UNION SELECT 'paper:' || paper_id, 'word:' || word FROM pw UNION SELECT 'word:' || word, 'paper:' || paper_id FROM pw), e AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS weight FROM l), {_ENDS}"""
_TOKEN_SEEDS = "SELECT node, 1.0::DOUBLE AS weight FROM n WHERE node IN ('word:small', 'word:ring')"


def paper_words(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").select(F.col("l_orderkey").alias("paper_id"), "word").distinct()


def token_walk(spark: SparkSession, d: str) -> DataFrame:
    """node, score of a walk that starts and restarts at the words of QUERY."""
    one = F.lit(1.0)
    layers = G.assemble(
        (citations(spark, d).distinct().withColumn("weight", one), "paper", "paper", False, True),
        (authorship(spark, d).select(F.col("paper_id").alias("src"), F.col("author_id").alias("dst"), one.alias("weight")), "paper", "author", True, True),
        (PG.coauthor_edges(spark, d).withColumn("weight", one), "author", "author", True, True),
        (paper_words(spark, d).select(F.col("paper_id").alias("src"), F.col("word").alias("dst"), one.alias("weight")), "paper", "word", True, True),
    )
    e = checkpointed(layers.select(F.concat_ws(":", "src_layer", "src").alias("src"), F.concat_ws(":", "dst_layer", "dst").alias("dst"), "weight"))
    nodes = checkpointed(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    seeds = nodes.where(F.col("node").isin(*(f"word:{w}" for w in QUERY))).withColumn("weight", one)
    return G.pagerank(nodes, e, 0.15, seeds, start=seeds, most=200, mixed=2)


@query("QRY16_meng", f"{_TOKEN_GRAPH}, {PG.walk_sql(0.15, personal=_TOKEN_SEEDS, start=True)} SELECT substr(node, 7)::BIGINT AS node, round(score, 9) AS score FROM x WHERE node LIKE 'paper:%' {_BEST.replace('node', 'substr(node, 7)::BIGINT')}")
def meng(spark: SparkSession, d: str) -> DataFrame:
    x = token_walk(spark, d).where("node LIKE 'paper:%'")
    return best(x.select(F.expr("substring(node, 7)").cast("long").alias("node"), "score"))


@query("SRC16_result_lists", "SELECT lower(n_name) || ' papers' AS query, s_name AS title, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INT AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def result_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of other engines: files with a query, then titles, some of them again in capitals."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"])
    lists = s.groupBy("n_name").agg(titles.alias("t")).select(F.concat_ws("\n", F.concat(F.lower("n_name"), F.lit(" papers")), F.array_join("t", "\n"), F.upper(F.get("t", F.lit(0)))).alias("value"))
    path = scratch_file(spark)
    lists.write.option("maxRecordsPerFile", 1).text(path)
    w = Window.partitionBy("query").orderBy("position")
    return S.read_result_lists(spark, path).withColumn("rank", F.row_number().over(w) - 1).select("query", "title", "rank")


for _name in ("scholar", "arnetminer", "citeseer"):
    query(f"QRY16_{_name}", f"SELECT * FROM (SELECT lower(n_name) || ' papers' AS query, s_name AS title, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INT AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE query = 'nation_7 papers' AND rank < {LIMIT}")(
        lambda spark, d: result_lists(spark, d).where(f"query = 'nation_7 papers' AND rank < {LIMIT}")
    )


def prediction_grid(spark: SparkSession, d: str) -> DataFrame:
    """row, column, value of a grid file of topic-model predictions, citing by cited."""
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: ((F.col("n_nationkey") * 7 + j * 3) % 11 / F.lit(16.0)).cast("string"))
    path = scratch_file(spark)
    table(spark, d, "nation").orderBy("n_nationkey").coalesce(1).select(F.array_join(line, " ").alias("value")).write.text(path)
    return S.read_grid(spark, path)


_GRID = "SELECT n_nationkey AS row, j::INT AS col, ((n_nationkey * 7 + j * 3) % 11) / 16.0::DOUBLE AS value FROM nation, range(10) AS r(j)"


@query("SRC17_predictions", f"SELECT row::BIGINT AS row, col, value FROM ({_GRID}) WHERE true QUALIFY row_number() OVER (PARTITION BY row ORDER BY value DESC, col) <= 3")
def predictions(spark: SparkSession, d: str) -> DataFrame:
    """The three cited papers that the grid gives most weight, for each citing one."""
    return C.top_k(prediction_grid(spark, d), ("row",), "value", "column", 3).select("row", F.col("column").alias("col"), "value")


@query("QRY16_link_plsa", f"SELECT col AS node, value AS score FROM ({_GRID}) WHERE row = 7 ORDER BY value DESC, col LIMIT 5")
def link_plsa(spark: SparkSession, d: str) -> DataFrame:
    return prediction_grid(spark, d).where("row = 7").orderBy(F.desc("value"), "column").limit(5).select(F.col("column").alias("node"), F.col("value").alias("score"))


# Time, learning, batches

_AUTHOR_YEARS = f"WITH {ctes('fact', 'citations')}, y AS (SELECT DISTINCT year FROM papers), k AS (SELECT author_id, year, count(*) AS n FROM authorship JOIN papers USING (paper_id) GROUP BY 1, 2), s AS MATERIALIZED (SELECT s_suppkey AS affil_id, y.year AS step, coalesce(n, 0)::DOUBLE AS score FROM supplier CROSS JOIN y LEFT JOIN k ON k.author_id = s_suppkey AND k.year = y.year)"


@query("QRY9_temporal_authors", PR._answer_sql(f"{_AUTHOR_YEARS}, n AS (SELECT s_suppkey AS node FROM supplier), e AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM ({PG._project_sql('author_id')})), {PG.walk_sql(0.9)}, {PR._TREND}", "SELECT a2.affil_id, round(sum(x.score * (1 + coalesce(tr.factor, 0))), 9) AS score FROM x JOIN affiliation a2 ON a2.author_id = x.node LEFT JOIN tr ON tr.affil_id = x.node GROUP BY 1"))
def temporal_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors' walk scores moved by the trend of their yearly papers, then added up for institutions."""
    years = papers(spark, d).select("year").distinct()
    n = authorship(spark, d).join(papers(spark, d), "paper_id").groupBy("author_id", "year").agg(F.count("*").cast("double").alias("score"))
    s = affiliation(spark, d).select("author_id").crossJoin(F.broadcast(years)).join(n, ["author_id", "year"], "left").select("author_id", F.col("year").alias("step"), F.coalesce("score", F.lit(0.0)).alias("score"))
    x = G.pagerank(*PG.author_graph(spark, d), 0.9).withColumnRenamed("node", "author_id")
    moved = x.join(TS.trend_factors(s, "author_id"), "author_id", "left").withColumn("score", F.col("score") * (1 + F.coalesce("factor", F.lit(0.0))))
    return PR.answer(spark, d, moved.join(affiliation(spark, d), "author_id").groupBy("affil_id").agg(F.sum("score").alias("score")), 9)


@query("QRY10_learn_to_rank")
def learn_to_rank(spark: SparkSession, d: str) -> DataFrame:
    return PR.answer(spark, d, PR.ada_rank(spark, d))


@query("ML6_theil_sen")
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    """The default regression: medians of the fits of random subsets of all rows."""
    train, names, rows = PR.training(spark, d)
    w = L.theil_sen(train, names, "target", ["affil_id", "year"])
    score = sum((F.col(c) * float(v) for c, v in zip(names, w[1:], strict=True)), F.lit(float(w[0])))
    return rows.select("affil_id", score.alias("score"))


_BATCH = f"""WITH {ctes('fact', 'candidates')}, c1 AS (SELECT * FROM (WITH {CREDIT_DECAYED} SELECT * FROM credit)), c2 AS (SELECT * FROM (WITH {CREDIT} SELECT * FROM credit)),
r AS (SELECT 'SimpleSearcher' AS searcher, venue AS conf_id, affil_id, sum(score) AS score FROM c1 GROUP BY 2, 3 UNION ALL SELECT 'RegressionSearcher', venue, affil_id, sum(score) FROM c2 WHERE year > (SELECT min(year) FROM papers) GROUP BY 2, 3)
SELECT searcher, conf_id, affil_id, round(score / max(score) OVER (PARTITION BY searcher, conf_id), 6) AS score FROM r"""


@query("QRY17_searchers", _BATCH)
def searchers(spark: SparkSession, d: str) -> DataFrame:
    """Searchers run for all conferences, scores over their largest, saved as rankings and read again."""
    f = fact(spark, d)
    first = papers(spark, d).agg(F.min("year").alias("first"))
    later = f.crossJoin(F.broadcast(first)).where("year > first").drop("first")
    runs = {"SimpleSearcher": C.fractional_credit(f, ("venue", "affil_id"), decayed()), "RegressionSearcher": C.fractional_credit(later, ("venue", "affil_id"))}
    out = None
    for name, scored in runs.items():
        top = F.max("score").over(Window.partitionBy("venue"))
        path = scratch_file(spark)
        S.write_ranking(scored.select(F.col("venue").alias("conf_id"), "affil_id", r6(F.col("score") / top).alias("score")), path)
        one = S.read_ranking(spark, path).select(F.lit(name).alias("searcher"), "conf_id", F.col("affil_id").cast("int").alias("affil_id"), "score")
        out = one if out is None else out.unionByName(one)
    return out


# Layers of n-grams, keywords and topics: items of papers, and pairs of items by lift


def item_layer(rows: DataFrame, least: float = 1.0) -> DataFrame:
    """kind, src, dst, weight from (paper, item, value): papers and their items, and pairs of items with at least that lift, both over their largest."""
    own = C.normalised(rows.select(F.lit("item").alias("kind"), F.col("paper").cast("string").alias("src"), F.col("item").cast("string").alias("dst"), F.col("value").alias("weight")), "weight")
    pairs = C.lift_rules(rows.select(F.col("paper").alias("basket"), F.col("item").cast("string").alias("item")), least)
    pairs = C.normalised(pairs.select(F.lit("pair").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("lift").alias("weight")), "weight")
    return own.unionByName(pairs).withColumn("weight", r6("weight"))


def _item_layer_sql(rows: str) -> str:
    return f"""rows AS MATERIALIZED ({rows}), m AS (SELECT paper, item::VARCHAR AS item, count(*) AS m FROM rows GROUP BY 1, 2), f AS (SELECT item::VARCHAR AS item, count(*) AS f FROM rows GROUP BY 1),
p AS (SELECT x.item AS a, y.item AS b, sum(x.m * y.m) AS f12 FROM m x JOIN m y ON x.paper = y.paper AND x.item < y.item GROUP BY 1, 2),
lift AS (SELECT a, b, f12 * (SELECT count(DISTINCT paper) FROM rows) / (x.f * y.f) AS lift FROM p JOIN f x ON x.item = a JOIN f y ON y.item = b)
SELECT 'item' AS kind, paper::VARCHAR AS src, item::VARCHAR AS dst, round(value / (SELECT max(value) FROM rows), 6) AS weight FROM rows
UNION ALL SELECT 'pair', a, b, round(lift / (SELECT max(lift) FROM lift WHERE lift >= 1), 6) FROM lift WHERE lift >= 1"""


@query("GR15_ngram_layer", f"WITH {PT._GRAMS}, {_item_layer_sql('SELECT doc_id AS paper, term AS item, round(value, 6) AS value FROM gn WHERE round(value, 6) >= 0.25')}")
def ngram_layer(spark: SparkSession, d: str) -> DataFrame:
    """Terms of at least 0.25; a text has 16 at most, as its values are of unit length."""
    n = K.frequent_ngrams(texts(spark, d), PT.text_words(), (1, 2), 5, 0.5, None, 17).where("value >= 0.25")
    return item_layer(checkpointed(n.select(F.col("doc_id").alias("paper"), F.col("term").alias("item"), "value")))


@query("GR15_keyword_layer", f"WITH {_item_layer_sql('SELECT DISTINCT l_orderkey AS paper, p_type AS item, 1.0::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey')}")
def keyword_layer(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper"), F.col("p_type").alias("item")).distinct()
    return item_layer(k.withColumn("value", F.lit(1.0)))


@query("GR15_topic_layer", f"WITH {_item_layer_sql('SELECT l_orderkey AS paper, l_suppkey % 20 AS item, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) AS value FROM lineitem GROUP BY 1, 2')}")
def topic_layer(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), (F.col("l_suppkey") % 20).alias("item")).agg(F.sum("l_quantity").alias("value"))
    return item_layer(t.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("paper"))))


# Files and tables that are written and read again

LITERALS = [("P1", "A first title", 2011, "KDD"), ("P2", "Another", 2012, "KDD"), ("P3", "The third", 2013, "ICML")]


@query("SRC5_literals", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{e}')" for a, b, c, e in LITERALS) + ") AS t(paper_id, title, year, conf_id)")
def literals(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(LITERALS, "paper_id string, title string, year int, conf_id string")


@query("SRC4_tsv_file", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_suppkey % 10 > 0")
def tsv_file(spark: SparkSession, d: str) -> DataFrame:
    """A file with blank lines, lines of another arity and repeated keys, of which the smallest row stays."""
    s = table(spark, d, "supplier")
    line = F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey")
    lines = s.select(F.explode(F.when(F.col("s_suppkey") % 10 > 0, F.array(line, F.concat_ws("\t", "s_suppkey", F.concat("s_name", F.lit("~")), "s_nationkey"), F.lit(""))).otherwise(F.array(F.col("s_name")))).alias("value"))
    path = scratch_file(spark)
    lines.write.text(path)
    return S.read_tsv(spark, path, TT.StructType([TT.StructField("id", TT.LongType()), TT.StructField("name", TT.StringType()), TT.StructField("nation", TT.IntegerType())]), "id")


@query("SRC6_tagged_file", "SELECT p_partkey::VARCHAR AS id, p_name AS title, p_size::VARCHAR AS year, len(list_distinct([p_brand, p_type]))::INT AS cited FROM part")
def tagged_file(spark: SparkSession, d: str) -> DataFrame:
    """Records with CR LF line ends, a blank line after each."""
    p = table(spark, d, "part")
    r = p.select(F.concat(F.lit("#index "), "p_partkey", F.lit("\r\n#* "), "p_name", F.lit("\r\n#t "), "p_size", F.lit("\r\n#% "), "p_brand", F.lit("\r\n#% "), "p_type", F.lit("\r\n\r")).alias("value"))
    path = scratch_file(spark)
    r.write.text(path)
    return S.read_tagged(spark, path, S.PAPER_TAGS, ("cited",)).select("id", "title", "year", F.size(F.array_distinct("cited")).alias("cited"))


@query("SNK4_create_table", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey >= 5")
def create_table(spark: SparkSession, d: str) -> DataFrame:
    """Created twice, the second time without effect; then dropped and created anew with other rows."""
    name, rows = f"t_{scratch_file(spark).rsplit('/', 1)[-1]}", table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    S.create_table(spark, name, rows.schema)
    S.insert(rows.where("id < 5"), name)
    S.create_table(spark, name, rows.schema)
    if spark.table(name).count() != 5:
        raise RuntimeError("the second CREATE TABLE took the rows away")
    S.create_table(spark, name, rows.schema, drop=True)
    S.insert(rows.where("id >= 5"), name)
    return spark.table(name)


@query("SNK5_ranking_file", f"WITH {ctes('fact')}, {CREDIT} SELECT venue AS conf_id, affil_id::VARCHAR AS affil_id, round(sum(score), 6) AS score FROM credit GROUP BY 1, 2")
def ranking_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_file(spark)
    S.write_ranking(C.fractional_credit(fact(spark, d), ("venue", "affil_id")).select(F.col("venue").alias("conf_id"), "affil_id", r6("score").alias("score")), path)
    return S.read_ranking(spark, path)


@query("SNK8_graph", f"{PG._AFFIL_GRAPH} SELECT 'node' AS kind, node AS src, NULL::INT AS dst, NULL::DOUBLE AS weight FROM n UNION ALL SELECT 'edge', src, dst, round(weight, 6) FROM e")
def graph_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_file(spark)
    S.write_graph(*PG.affil_graph(spark, d), path)
    nodes, edges = (spark.read.parquet(f"{path}/{part}") for part in ("nodes", "edges"))
    own = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("src"), F.lit(None).cast("int").alias("dst"), F.lit(None).cast("double").alias("weight"))
    return own.unionByName(edges.select(F.lit("edge").alias("kind"), "src", "dst", r6("weight").alias("weight")))


@query("SNK9_bulk_csv", f"{PG._AFFIL_GRAPH} SELECT 'entity_id:ID(pub)' AS header, node::VARCHAR AS a, NULL AS b, NULL::DOUBLE AS weight FROM n UNION ALL SELECT ':START_ID(pub),:END_ID(pub),weight:float', src::VARCHAR, dst::VARCHAR, round(weight, 6) FROM e")
def bulk_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_file(spark)
    nodes, edges = PG.affil_graph(spark, d)
    S.write_bulk_csv(nodes, edges.withColumn("weight", r6("weight")), path, "pub")
    n, e = (spark.read.option("header", True).csv(f"{path}/{part}") for part in ("nodes", "edges"))
    a, b, w = (F.col(f"`{c}`") for c in e.columns)
    own = n.select(F.lit(",".join(n.columns)).alias("header"), F.col(f"`{n.columns[0]}`").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("weight"))
    return own.unionByName(e.select(F.lit(",".join(e.columns)).alias("header"), a.alias("a"), b.alias("b"), w.cast("double").alias("weight")))


@query("SNK10_letor_file", f"WITH {ctes('fact')}, {CREDIT}, s AS (SELECT affil_id, sum(score) AS score, count(*) AS n FROM credit GROUP BY 1), p AS (SELECT affil_id, count(DISTINCT paper_id) AS papers FROM fact GROUP BY 1) SELECT round(10 * round(score, 6))::BIGINT || ' qid:1 1:' || papers || ' 2:' || n AS line FROM s JOIN p USING (affil_id)")
def letor_file(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    c = C.fractional_credit(f, ("affil_id", "year", "venue")).groupBy("affil_id").agg(r6(F.sum("score")).alias("score"), F.count("*").alias("n"))
    p = f.groupBy("affil_id").agg(F.countDistinct("paper_id").alias("papers"))
    path = scratch_file(spark)
    S.write_letor(c.join(p, "affil_id").withColumn("q", F.lit("1")), path, "score", "q", ["papers", "n"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SNK12_index", f"WITH {PT._TF}, {PT._VOCAB} SELECT 'posting' AS kind, doc_id, term, tf::BIGINT AS n FROM tf UNION ALL SELECT 'length', doc_id, NULL, sum(tf)::BIGINT FROM tf GROUP BY doc_id UNION ALL SELECT 'frequency', NULL, term, df::BIGINT FROM v")
def index(spark: SparkSession, d: str) -> DataFrame:
    stored = PT.stored_index(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind, doc, term, n: df.select(F.lit(kind).alias("kind"), doc.alias("doc_id"), term.alias("term"), F.col(n).alias("n"))
    out = row(stored.postings(), "posting", F.col("doc_id"), F.col("term"), "tf")
    return out.unionByName(row(stored.lengths(), "length", F.col("doc_id"), none("string"), "length")).unionByName(row(stored.frequencies(), "frequency", none("long"), F.col("term"), "df"))


@query("TXT27_file_names", "SELECT page_id, translate(url, ' /', '++') AS name FROM pages")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))

