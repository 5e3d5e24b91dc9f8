"""Queries over texts, pages and retrieval."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from scholion.fixtures import table, texts
from scholion.functions import text as T
from scholion.operators import corpus as K
from scholion.operators import fuzzy as Z
from scholion.operators import relational as R
from scholion.operators.index import StoredIndex
from scholion.plans.registry import query
from scholion.plans.relational import r6
from scholion.runtime import checkpointed, scratch_file
from scholion.sources import files as S



def text_words() -> F.Column:
    return T.tokens(F.col("text"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{Nd}}_]{{2,}}'), lambda t: NOT list_contains({_STOPS}, t) AND NOT regexp_matches(t, '^\p{{Nd}}+$'))"
_TF = f"tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2)"
_VOCAB = "v AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1), c AS (SELECT count(*) AS n FROM documents)"


@query("SRC4_tsv", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_suppkey % 10 > 0")
def tsv(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    lines = s.select(F.when(F.col("s_suppkey") % 10 > 0, F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey")).otherwise(F.concat_ws("\t", "s_suppkey", "s_name")).alias("value"))
    lines = lines.select(F.concat("value", F.lit("\r")).alias("value")).union(spark.createDataFrame([("",)], "value string"))
    return S.split_tsv(lines, TT.StructType([TT.StructField("id", TT.LongType()), TT.StructField("name", TT.StringType()), TT.StructField("nation", TT.IntegerType())]))


@query("SRC6_tagged_papers", "SELECT p_partkey::VARCHAR AS id, p_name AS title, p_size::VARCHAR AS year, len(list_distinct([p_brand, p_type]))::INT AS cited FROM part")
def tagged_papers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select(F.concat(F.lit("#index "), "p_partkey", F.lit("\n#* "), "p_name", F.lit("\n#t "), "p_size", F.lit("\n#% "), "p_brand", F.lit("\n#% "), "p_type").alias("value"))
    return S.split_tagged(r, S.PAPER_TAGS, ("cited",)).select("id", "title", "year", F.size(F.array_distinct("cited")).alias("cited"))


@query("SRC7_tagged_authors", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey::VARCHAR AS affil FROM supplier")
def tagged_authors(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "supplier").select(F.concat(F.lit("#index "), "s_suppkey", F.lit("\n#n "), "s_name", F.lit("\n#a "), "s_nationkey").alias("value"))
    return S.split_tagged(r, S.AUTHOR_TAGS).select("id", "name", "affil")


@query("SRC8_pairs", "SELECT DISTINCT l_orderkey::VARCHAR AS paper_id, l_suppkey::VARCHAR AS author_id FROM lineitem")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("#"), "l_orderkey", F.lit("  \t"), "l_suppkey").alias("value"))
    return S.split_pairs(lines, ("paper_id", "author_id"), True).distinct()


@query("SRC9_xml", "SELECT s_suppkey AS id, s_name AS name, 'Nation ' || s_nationkey AS affil FROM supplier")
def xml(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("<www key='homepages/"), "s_suppkey", F.lit("'><author>"), "s_name", F.lit(" 0001</author><note type='affiliation'>Nation "), "s_nationkey", F.lit("</note></www>"))
    parsed = F.from_xml(x, "author string, note struct<_VALUE string, _type string>", {"rowTag": "www"})
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), parsed.alias("x")).select("id", F.regexp_replace("x.author", r" \d+$", "").alias("name"), F.col("x.note._VALUE").alias("affil"))


@query("SRC10_xpath", "SELECT s_suppkey AS id, s_name AS name, 'Nation ' || s_nationkey AS affil FROM supplier")
def xpath(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("<www><author>"), "s_name", F.lit(" 0001</author><note type='affiliation'>Nation "), "s_nationkey", F.lit("</note></www>"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.homepage_of(x).alias("x")).select("id", "x.name", "x.affil")


@query("SRC11_html_paragraphs", r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p\s*>', 1) AS p FROM pages)
SELECT page_id, len(p)::INT AS n, array_to_string(list_transform(p, lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), chr(10)) AS text FROM p""")
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", T.html_paragraphs(F.col("html")).alias("p"))
    return p.select("page_id", F.size("p").alias("n"), F.array_join("p", "\n").alias("text"))


_indexes: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored_index(spark: SparkSession, d: str) -> StoredIndex:
    """The index of the documents' whole texts, written once for a context and folder."""
    known = _indexes.setdefault(spark.sparkContext, {})
    if d not in known:
        path = scratch_file(spark)
        StoredIndex.write(texts(spark, d), text_words(), path)
        known[d] = path
    return StoredIndex(spark, known[d])


def benchmark_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text_words())).alias("term"))


_Q = f"q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark), len AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS length FROM tf GROUP BY 1)"


def _search_sql(part: str, k: int, every: bool = False) -> str:
    keep = "HAVING count(*) = any_value(nq)" if every else ""
    return f"""WITH {_TF}, {_VOCAB}, {_Q}, qn AS (SELECT query_id, count(*) AS nq FROM q GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum({part}), 6) AS score FROM q JOIN qn USING (query_id) JOIN tf USING (term) JOIN v USING (term) JOIN len USING (doc_id), c, (SELECT avg(length) AS mean FROM len) GROUP BY 1, 2 {keep})
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= {k}"""


_TFIDF_PART = "sqrt(tf) * (1 + ln(n / (df + 1))) ** 2 / sqrt(length)"
_BM25_PART = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))"


@query("SRC12_search_all_terms", _search_sql(_TFIDF_PART, 20, True))
def search_all(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d).search(benchmark_terms(spark, d), 20, mode="all")


@query("TXT10_tfidf_search", _search_sql(_TFIDF_PART, 20))
def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d).search(benchmark_terms(spark, d), 20)


@query("TXT11_bm25_search", _search_sql(_BM25_PART, 20))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d).search(benchmark_terms(spark, d), 20, "bm25")


_SCORES = f"""WITH {_TF}, {_VOCAB}, {_Q}, parts AS MATERIALIZED (SELECT query_id, doc_id, term, {_TFIDF_PART} AS part FROM q JOIN tf USING (term) JOIN v USING (term) JOIN len USING (doc_id), c),
s AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM parts GROUP BY 1, 2)"""


@query("SRC13_scores_of_given", f"{_SCORES} SELECT doc_id, coalesce(max(score), 0.0) AS score FROM (SELECT DISTINCT doc_id FROM labels) LEFT JOIN s USING (doc_id) GROUP BY 1")
def scores_of_given(spark: SparkSession, d: str) -> DataFrame:
    """The best score that any query gives to each labelled document, 0 where it has none of their terms."""
    given = table(spark, d, "labels").select("doc_id").distinct()
    best = stored_index(spark, d).scores(benchmark_terms(spark, d), given).groupBy("doc_id").agg(F.max("score").alias("score"))
    return given.join(best, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


@query("SRC14_explain", f"{_SCORES}, top AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 20) SELECT query_id, doc_id, term, round(part, 6) AS part FROM parts JOIN top USING (query_id, doc_id)")
def explain(spark: SparkSession, d: str) -> DataFrame:
    """All terms' parts of the scores of a search's results."""
    index, q = stored_index(spark, d), benchmark_terms(spark, d)
    return index.explained(q, index.search(q, 20)).select("query_id", "doc_id", "term", r6("part").alias("part"))


@query("TXT1_tokens", f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.array_join(text_words(), " ").alias("tokens"))


@query("TXT1_stems")
def stems(spark: SparkSession, d: str) -> DataFrame:
    return K.stemmed_counts(spark, texts(spark, d))


@query("TXT2_filtered_tokens", f"SELECT doc_id, len(list_filter({_TOKENS}, lambda t: length(t) >= 3))::INT AS n FROM documents")
def filtered_tokens(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.size(T.filtered(text_words())).alias("n"))


@query("AG19_vocabulary", f"WITH {_TF}, {_VOCAB} SELECT term, df::BIGINT AS df, cf FROM v ORDER BY cf DESC, term LIMIT 1000")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return K.vocabulary(K.term_counts(texts(spark, d), text_words())).orderBy(F.desc("cf"), "term").limit(1000)


@query("SNK11_token_counts", f"WITH {_TF} SELECT doc_id, term, tf::BIGINT AS tf FROM tf")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.term_counts(texts(spark, d), text_words())


@query("TXT3_tfidf", f"WITH {_TF}, {_VOCAB} SELECT doc_id, term, round(tf * (ln(n / (df + 1)) + 1), 6) AS value FROM tf JOIN v USING (term), c WHERE df >= 10")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    tf = K.term_counts(texts(spark, d), text_words())
    v = K.kept_terms(K.vocabulary(tf), texts(spark, d).agg(F.count("*").alias("n")), 10)
    return K.tfidf(tf, v).withColumn("value", r6("value"))


_GRAMS = f"""g AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)) GROUP BY 1, 2),
gv AS MATERIALIZED (SELECT term, count(*) AS df FROM g GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM documents)),
raw AS MATERIALIZED (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM g JOIN gv USING (term), (SELECT count(*) AS n FROM documents)),
gn AS MATERIALIZED (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM raw)"""


@query("TXT4_ngrams", f"WITH {_GRAMS} SELECT doc_id, term, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, term) AS r FROM (SELECT doc_id, term, round(value, 6) AS value FROM gn)) WHERE r <= 10")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return K.frequent_ngrams(texts(spark, d), text_words(), (1, 2), 5, 0.5, None, 10).drop("rank")


@query("TXT5_count_vectors", f"WITH {_TF}, {_VOCAB} SELECT doc_id, term, tf::BIGINT AS tf FROM tf WHERE term IN (SELECT term FROM v WHERE df >= 5 ORDER BY cf DESC, term LIMIT 20000)")
def count_vectors(spark: SparkSession, d: str) -> DataFrame:
    tf = K.term_counts(texts(spark, d), text_words())
    return tf.join(K.vocabulary(tf).where("df >= 5").orderBy(F.desc("cf"), "term").limit(20000), "term", "left_semi").select("doc_id", "term", "tf")


_VEC = "x AS MATERIALIZED (SELECT doc_id, term, tf * (ln(n / (df + 1)) + 1) AS value FROM tf JOIN v USING (term), c)"


@query("TXT6_cosine", f"""WITH {_TF}, {_VOCAB}, {_VEC}, b AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
y AS MATERIALIZED (SELECT item_id, term, b.tf * (ln(n / (df + 1)) + 1) AS value FROM b JOIN v USING (term), c),
nx AS (SELECT doc_id, sqrt(sum(value * value)) AS n FROM x GROUP BY 1), ny AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM y GROUP BY 1)
SELECT item_id AS a_id, doc_id AS b_id, round(d / (nx.n * ny.n), 6) AS similarity FROM (SELECT item_id, doc_id, sum(x.value * y.value) AS d FROM x JOIN y USING (term) GROUP BY 1, 2) JOIN nx USING (doc_id) JOIN ny USING (item_id) WHERE d / (nx.n * ny.n) >= 0.1""")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    return K.cosine_join(*vectors(spark, d), 0.1).withColumn("similarity", r6("similarity"))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """TF-IDF vectors of the benchmark and of the documents."""
    tf = K.stored_counts(texts(spark, d), text_words())
    v = checkpointed(K.kept_terms(K.vocabulary(tf), texts(spark, d).agg(F.count("*").alias("n"))))
    v = F.broadcast(v) if v.count() <= K.MOST_BROADCAST_TERMS else v
    items = K.term_counts(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), text_words())
    return K.tfidf(items, v).withColumnRenamed("doc_id", "id"), K.tfidf(tf, v).withColumnRenamed("doc_id", "id")


_CONV = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS context FROM conversations"


@query("TXT7_context_weights", f"""WITH e AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS a, list_distinct({_TOKENS.replace("coalesce(text", "coalesce(context")}) AS b FROM ({_CONV}))
SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6) END AS weight FROM e""")
def context_weights(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    e = table(spark, d, "conversations").withColumn("context", F.lag("text").over(w))
    a, b = F.array_distinct(T.tokens(F.col("text"))), F.array_distinct(T.tokens(F.col("context")))
    e = e.select("conv_id", "turn", a.alias("a"), b.alias("b"))
    weight = F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.sqrt(F.size("a") * F.size("b"))), F.lit(0.0))
    return e.select("conv_id", "turn", r6(weight).alias("weight"))


@query("TXT8_sentence_window")
def sentence_window(spark: SparkSession, d: str) -> DataFrame:
    x = texts(spark, d).withColumn("at", F.instr("text", " the ")).where("at > 0")
    return x.select("doc_id", T.sentence_window(F.col("text"), F.col("at"), F.col("at") + 3).alias("context"))


@query("TXT9_sentence_limits", """
WITH t AS (SELECT doc_id, text, length(text) // 2 AS middle FROM documents), x AS (SELECT *, substr(text, 1, middle) AS a, substr(text, middle + 1) AS b FROM t)
SELECT doc_id, (CASE WHEN instr(a, '.') = 0 THEN 0 ELSE length(a) - instr(reverse(a), '.') + 1 END)::INT AS first, (CASE WHEN instr(b, '.') = 0 THEN length(text) ELSE middle + instr(b, '.') END)::INT AS last FROM x""")
def sentence_limits(spark: SparkSession, d: str) -> DataFrame:
    x = texts(spark, d).withColumn("at", F.floor(F.char_length("text") / 2).cast("int"))
    return x.select("doc_id", T.sentence_limits(F.col("text"), F.col("at")).alias("s")).select("doc_id", F.col("s.first").cast("int").alias("first"), F.col("s.last").cast("int").alias("last"))


_BIBLIO = "p_name || ' [' || p_size || ',' || p_size + 2 || '-' || p_size + 4 || '] as in (Zaki, 2001).' || chr(10) || 'References' || chr(10) || '[1] A ' || p_brand || chr(10) || '[2] B ' || p_type || chr(10) || 'Appendix' || chr(10) || 'x'"


def papers_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    text = F.concat("p_name", F.lit(" ["), n, F.lit(","), n + 2, F.lit("-"), n + 4, F.lit("] as in (Zaki, 2001).\nReferences\n[1] A "), "p_brand", F.lit("\n[2] B "), "p_type", F.lit("\nAppendix\nx"))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", text.alias("text"))


@query("TXT12_markers", "SELECT p_partkey, 'numeric' AS format, 3::INT AS n FROM part")
def markers(spark: SparkSession, d: str) -> DataFrame:
    return papers_text(spark, d).select("p_partkey", T.markers(F.col("text")).alias("m")).select("p_partkey", "m.format", F.size("m.found").alias("n"))


@query("TXT13_ranges", "SELECT p_partkey, concat_ws(',', p_size, p_size + 2, p_size + 3, p_size + 4) AS ids FROM part")
def ranges(spark: SparkSession, d: str) -> DataFrame:
    marker = F.regexp_extract("text", T.MARKERS["numeric"], 0)
    return papers_text(spark, d).select("p_partkey", F.array_join(T.expanded_numbers(marker).cast("array<string>"), ",").alias("ids"))


@query("TXT14_references", "SELECT p_partkey, 'A ' || p_brand || '|B ' || p_type AS refs FROM part")
def references(spark: SparkSession, d: str) -> DataFrame:
    return papers_text(spark, d).select("p_partkey", F.array_join(T.split_references(T.reference_section(F.col("text"))), "|").alias("refs"))


@query("TXT15_section", "SELECT p_partkey, 'Abstract' || chr(10) || p_name AS section FROM part")
def section(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.array(F.lit("Title"), F.lit("Abstract"), "p_name", F.lit("1 Introduction"), "p_type").alias("p"))
    return p.select("p_partkey", T.section(F.col("p"), r"^\s*abstract", r"introduction").alias("section"))


@query("TXT16_dehyphenated", "SELECT doc_id, length(replace(replace(text, ' ', '-' || chr(10)), '-' || chr(10), ''))::INT AS n FROM documents")
def dehyphenated(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.char_length(T.dehyphenated(F.replace("text", F.lit(" "), F.lit("-\n")))).alias("n"))


_MARKS = " + ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN {w}::DOUBLE ELSE 0 END" for p, w in T.CONTRIBUTION_WEIGHTS)


@query("TXT17_contributions", rf"SELECT conv_id, turn, role, round(CASE WHEN abs(score) < 1e-9 THEN -0.5 ELSE score END, 6) AS score FROM (SELECT conv_id, turn, role, {_MARKS} AS score FROM (SELECT *, lower(trim(CASE turn % 4 WHEN 0 THEN 'In this paper we present ' WHEN 1 THEN 'thanks, our results and a license: ' WHEN 2 THEN 'We now ' ELSE '' END || text)) AS s FROM conversations))")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("turn") % 4 == 0, "In this paper we present ").when(F.col("turn") % 4 == 1, "thanks, our results and a license: ").when(F.col("turn") % 4 == 2, "We now ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", r6(T.contribution_score(F.concat(head, "text")).cast("double")).alias("score"))


@query("TXT18_title_query", rf"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]', '', 'g')), '\s+'), lambda w: w <> '' AND NOT list_contains({_STOPS}, w)), ' ') AS query FROM benchmark")
def title_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.title_query(F.col("text")).alias("query"))


@query("TXT19_venue_names", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Conference on ' || s_name || ' SIG' WHEN 1 THEN 'Journal of ' || s_name ELSE s_name END AS name FROM supplier")
def venue_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("SIG - Proceedings Conference on ("), "s_name", F.lit(")"))).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit("; Journal of ..."))).otherwise(F.concat(F.lit("proc. "), "s_name"))
    return table(spark, d, "supplier").select("s_suppkey", T.venue_name(raw).alias("name"))


#: Lines and the institutions that they name.
AFFIL_LINES = (
    ("dept. of maths, univ. of rome, 12345", "University Of Rome"), ("georgia institute of technology, (atlanta)", "Georgia Institute Of Technology"), ("nowhere 7", ""),
    ("the polish academy of sciences", "Polish Academy Of Sciences"), ("universita di pisa; italy", "Universita Di Pisa"), ("imperial college-london: uk", "Imperial College-London"),
    ("data centre", "Data Centre"), ("inst. x, umversity of y <b>", "University Of Y"), ("national research council", "National Research Council"),
    ("princeton theological college, usa", "Princeton Theological College"), ("theodor heuss academy", "Theodor Heuss Academy"), ("institut 3; universität zürich", "Universität Zürich"),
)


@query("TXT20_affil_names", "SELECT s_suppkey, CASE s_suppkey % " + str(len(AFFIL_LINES)) + " " + " ".join(f"WHEN {k} THEN '{name}'" for k, (_, name) in enumerate(AFFIL_LINES)) + " END AS name FROM supplier")
def affil_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*(F.lit(line) for line, _ in AFFIL_LINES)), (F.col("s_suppkey") % len(AFFIL_LINES)).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", T.affil_name(raw).alias("name"))


@query("TXT21_author_names", "SELECT s_suppkey, trim(s_name) AS name FROM supplier")
def author_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", T.author_name(F.concat(F.lit("\t "), "s_name", F.lit(" 0002 "))).alias("name"))


@query("TXT22_host_tokens", "SELECT page_id, unnest(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')) AS token FROM pages")
def host_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.split(F.regexp_extract("url", r"://([^/?#]*)", 1), r"\.")).alias("token"))


HOSTS = [(1, ["blog", "org"], "Blogs Organisation"), (2, ["blog"], "Blog House"), (3, ["m", "example"], "Mobile Institute"), (4, ["org"], "Example Organisation")]


@query("TXT22_url_affils", "WITH u AS (SELECT page_id, string_split(translate(regexp_extract(url, '^https*://([.a-z^/][^/]+[.a-z^/])?', 0), '/', '.'), '.') AS t FROM pages) SELECT page_id, CASE " + " ".join(f"WHEN list_has_all(t, {tokens}) THEN '{found}'" for _, tokens, found in HOSTS) + " END AS found FROM u WHERE " + " OR ".join(f"list_has_all(t, {tokens})" for _, tokens, _ in HOSTS))
def url_affils(spark: SparkSession, d: str) -> DataFrame:
    entries = spark.createDataFrame(HOSTS, "priority int, tokens array<string>, found string")
    p = table(spark, d, "pages").select("page_id", F.array_join(T.host_tokens(F.col("url")), " ").alias("host"))
    return R.token_subset_join(p, "host", entries).select("page_id", "found")


@query("TXT23_merged", "SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_type END) AS text FROM part")
def merged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.merged(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type"))).alias("text"))


@query("TXT24_trimmed_contexts", r"SELECT item_id, regexp_extract(text, '(?s)^[^ ]* (.*) [^ ]*$', 1) AS context FROM benchmark")
def trimmed_contexts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.trimmed_context(F.col("text")).alias("context"))


@query("JN16_fuzzy", """
WITH q AS (SELECT c_custkey, c_nationkey, c_name || 'x' AS name FROM customer), m AS (
  SELECT q.c_custkey, s.s_name, round(jaro_winkler_similarity(q.name, s.s_name), 6) AS s FROM q JOIN supplier s ON c_nationkey = s_nationkey)
SELECT c_custkey, s_name, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC, s_name) AS r FROM m WHERE s >= 0.6) WHERE r = 1""")
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.concat("c_name", F.lit("x")).alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return q.join(Z.best_matches(q, s, "nation", "name", 0.6), ["nation", "name"]).select("c_custkey", F.col("match").alias("s_name"), "similarity")
