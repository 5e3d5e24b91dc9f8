"""Steps whose tasks, joins or comparisons must hold on larger tables."""

import re

import pytest
from pyspark.sql import functions as F

from scholion import fixtures
from scholion.operators import credit as C
from scholion.operators import blocks as B
from scholion.operators import corpus as K
from scholion.operators import graph as G
from scholion.operators import learning as L
from scholion.plans import QUERIES
from scholion.plans import graphs as PG
from scholion.plans import rankings as P
from scholion.plans import relational as PR
from scholion.plans import searchers as SQ

SF = "/root/testdata/sf0.001"


def test_tasks_of_credit_follow_the_lines(spark, monkeypatch, capsys):
    monkeypatch.setattr(fixtures, "PAPER_LINES", 1000)
    f = fixtures.fact(spark, SF)
    parts = 1 + fixtures.table(spark, SF, "lineitem").count() // 1000
    assert f.select(F.spark_partition_id()).distinct().count() == parts  # small tasks are not put together
    C.fractional_credit(f).explain()
    plan = capsys.readouterr().out
    assert f", {parts})" in plan and not any("hashpartitioning(paper_id" in line and ", 4)" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["AG2_credit_by_year", "ML3_trend", "ML4_with_trend", "ML5_windowed_features", "ML6_linear", "ML6_robust_linear", "ML12_forecast", "ML14_bayesian_search", "ML15_parameter_sweep"])
def test_papers_of_a_query_lie_in_tasks_that_follow_the_lines(spark, monkeypatch, capsys, name):
    monkeypatch.setattr(fixtures, "PAPER_LINES", 1000)
    monkeypatch.setattr(P, "checkpointed", lambda df, f=P.checkpointed: df.explain() or f(df))
    QUERIES[name](spark, SF).explain()
    by_paper = re.findall(r"hashpartitioning\([^()]*paper_id[^()]*, (\d+)\)", capsys.readouterr().out)
    assert set(by_paper) == {str(1 + fixtures.table(spark, SF, "lineitem").count() // 1000)}


def test_learners_compute_the_years_once(spark, capsys):
    train, names, rows = P.training(spark, SF)
    for frame in (train, rows):
        frame.explain()
        plan = capsys.readouterr().out
        assert "FileScan" in plan and "l_orderkey" not in plan
    features = L.windowed_features(P.yearly(spark, SF))
    want = {(r["affil_id"], r["year"]): r for r in features.collect()}
    score = {(r["affil_id"], r["year"]): r["score"] for r in C.fractional_credit(fixtures.fact(spark, SF), ("affil_id", "year")).collect()}
    got = train.collect()
    assert names == features.columns[2:] and {(r["affil_id"], r["year"]) for r in got} == {k for k in want if (k[0], k[1] + 1) in score}
    assert all([r[c] for c in names] + [r["target"]] == pytest.approx([*want[r["affil_id"], r["year"]][2:], score[r["affil_id"], r["year"] + 1]]) for r in got)
    last = fixtures.papers(spark, SF).agg(F.max("year")).first()[0]
    assert {(r["affil_id"], r["year"]) for r in rows.collect()} == {k for k in want if k[1] == last}


def test_credit_counts_repeated_rows_once(spark):
    rows = [(1, 10, 5, 2000), (1, 10, 5, 2000), (1, 10, 6, 2000), (1, 11, 5, 2000), (2, 10, 6, 2001)]
    got = {r[0]: r[1] for r in C.fractional_credit(spark.createDataFrame(rows, "paper_id int, author_id int, affil_id int, year int")).collect()}
    assert got == {5: 0.75, 6: 1.25}


def test_a_winner_of_just_the_ratio_is_one(spark):
    rows = [(1, "a", 11), (1, "b", 10), (2, "a", 109), (2, "b", 100), (3, "a", 33), (3, "b", 30)]
    got = PR.winners(spark.createDataFrame(rows, "k int, v string, n long"), "k", "v", "n", 1.0, 1.1)
    assert {r["k"] for r in got.collect()} == {1, 3}


@pytest.mark.parametrize("formula", ["tfidf", "bm25"])
def test_searches_with_common_terms_find_the_same(spark, formula):
    docs = spark.createDataFrame([(i, f"all {'even' if i % 2 == 0 else 'odd odd'} w{i % 7} w{i % 11} " + "x " * (i % 5)) for i in range(60)], "doc_id long, text string")
    words = F.split(F.trim("text"), " +")
    asked = {1: "all", 2: "all even", 3: "all w3", 4: "odd w3 w10", 5: "none all", 6: "w1 w2", 7: "none", 8: "all w3 even x"}
    q = spark.createDataFrame([(i, t) for i, text in asked.items() for t in text.split()], "query_id int, term string")
    plain = K.top_k(K.scores(q, docs, words, formula), ("query_id",), "score", "doc_id", 5)
    for common in (0, 12, 1000):
        assert sorted(map(tuple, K.search(q, docs, words, 5, formula, common=common).select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_common_terms_do_not_meet_every_query(spark, tmp_path):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("supplier w"), "id").alias("text"))
    words = F.split("text", " ")
    q = docs.select(F.col("doc_id").alias("query_id"), F.explode(words).alias("term"))
    widest = []
    whole = K.checkpointed

    def counted(df):
        out = whole(df)
        widest.append(out.count())
        return out

    patch = pytest.MonkeyPatch()
    patch.setattr(K, "checkpointed", counted)
    found = K.search(q, docs, words, 3)
    assert found.where("rank = 1 AND query_id = doc_id").count() == n and found.count() == 3 * n
    patch.undo()
    assert widest and max(widest) <= 2 * n


def test_venues_of_equal_names_are_one(spark, tmp_path):
    s = fixtures.table(spark, SF, "supplier")
    s.union(s.withColumn("s_suppkey", F.col("s_suppkey") + 1000)).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert QUERIES["ER4_venue_matching"](spark, str(tmp_path)).count() == s.where("s_suppkey % 5 > 0").count() * 2


def test_even_and_unique_layers_are_weighed_the_same(spark, capsys):
    edges = lambda rows: spark.createDataFrame(rows, "src int, dst int, weight double")
    pa, pp, af = edges([(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0)]), edges([(2, 1, 0.5), (3, 1, 0.2), (3, 2, 0.4)]), edges([(1, 1, 1.0), (1, 1, 1.0)])
    parts = lambda unique: G.assemble((pp, "paper", "paper", False, unique), (pa, "paper", "author", True, unique), (af, "author", "affil", True))
    rho = {("paper", "paper"): 0.3, ("paper", "author"): 0.7, ("author", "paper"): 0.6, ("author", "affil"): 0.4, ("affil", "author"): 1.0}
    got = lambda df: sorted(tuple(r[c] for c in ("src_layer", "src", "dst_layer", "dst", "weight")) for r in df.collect())
    assert got(G.layer_weights(parts(True), rho, even=[("paper", "author"), ("author", "paper")])) == got(G.layer_weights(parts(False), rho))
    # a part whose layers another one joins too is not taken as it is
    assert got(G.assemble((pp, "paper", "paper", False, True), (edges([(2, 1, 9.0)]), "paper", "paper", False, True))) == [("paper", "2", "paper", "1", 9.0), ("paper", "3", "paper", "1", 0.2), ("paper", "3", "paper", "2", 0.4)]
    with pytest.raises(ValueError):
        G.layer_weights(parts(True), rho, "sum", even=[("paper", "author")])


def test_a_step_of_a_walk_does_not_sort_edges(spark, capsys):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 0.5), (2, 3, 0.5)], "src long, dst long, p double")
    blocks, fans = G.edge_blocks(e, 2)
    G.flow_of(spark.createDataFrame([(1, 0.5), (2, 0.5)], "src long, score double"), blocks, fans).explain()
    plan = capsys.readouterr().out
    G.drop_bucketed(blocks)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_walk_that_mixes_vectors_ends_at_the_same_one_in_fewer_steps(spark):
    edges = [(k, k + 1, 1.0) for k in range(6)] + [(k + 1, k, 0.5) for k in range(0, 6, 2)] + [(5, 3, 0.0), (7, 0, 0.0), (2, 6, 3.0)]
    nodes, first = list(range(9)), {0: 1.0, 7: 2.0}
    with pytest.raises(RuntimeError):
        G.small_pagerank(nodes, edges, 0.05, first, most=25)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = G.pagerank(frame([(k,) for k in nodes], "node int"), frame(edges, "src int, dst int, weight double"), 0.05, frame(list(first.items()), "node int, weight double"), most=25, mixed=2)
    assert {r["node"]: r["score"] for r in out.collect()} == pytest.approx(G.small_pagerank(nodes, edges, 0.05, first, most=1000), abs=1e-6)


def test_the_edges_of_the_token_walk_are_not_grouped(spark, monkeypatch, capsys):
    seen = []
    monkeypatch.setattr(G, "assemble", lambda *parts, f=G.assemble: seen.append(f(*parts)) or seen[-1])
    monkeypatch.setattr(G, "pagerank", lambda nodes, edges, *a, **k: edges)
    edges = SQ.token_walk(spark, SF)
    assert edges.count() == edges.select("src", "dst").distinct().count()
    seen[0].explain()
    assert "max_by" not in capsys.readouterr().out


def test_a_step_of_a_walk_moves_values_of_blocks_and_no_edges(spark, monkeypatch):
    """A hub of both kinds: its edges lie in all blocks, and a step sends a value for each node and block at most."""
    n, blocks = 400, 4
    edges = [(0, k, 1.0 + k % 3) for k in range(1, n)] + [(k, 0, 1.0) for k in range(1, n, 2)] + [(k, k + 1, 2.0) for k in range(1, n - 1, 2)]
    monkeypatch.setattr(B, "LEAST_BLOCK", 1)
    seen = []
    monkeypatch.setattr(B, "stored", lambda *a, f=B.stored: seen.append((f(*a), [(r["peer"], r["kind"], r["block"], r["n"], len(r["p"] or "") // 8) for r in f(*a)[0].collect()])) or seen[-1][0])
    e = spark.createDataFrame(edges, "src int, dst int, weight double")
    got = {r["node"]: r["score"] for r in G.pagerank(None, e, 0.3).collect()}
    assert got == pytest.approx(G.small_pagerank(list(range(n)), edges, 0.3), abs=1e-12)
    pairs = [r for r in seen[0][1] if r[1] != B.OWN]
    held = [sum(r[4] for r in pairs if r[2] == b) for b in range(blocks)]
    assert sum(held) == len(edges) and max(held) < 2 * len(edges) / blocks
    moved = sum(r[3] for r in pairs) / 2  # both sides know a pair
    assert moved <= 2 * blocks + n / 2  # a hub's score and sum for each block, and the edges between others


@pytest.mark.parametrize("mixed", [0, 2])
def test_walks_over_many_blocks_are_the_small_walk(spark, monkeypatch, mixed):
    edges = [(k, (k * k + j) % 30, float(j)) for k in range(27) for j in range(3)] + [(k, 7, 1.0) for k in range(25)]
    first = {3: 1.0, 28: 2.0}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    monkeypatch.setattr(B, "LEAST_BLOCK", 1)
    out = G.pagerank(frame([(k,) for k in range(30)], "node int"), frame(edges, "src int, dst int, weight double"), 0.3, frame(list(first.items()), "node int, weight double"), mixed=mixed)
    assert {r["node"]: r["score"] for r in out.collect()} == pytest.approx(G.small_pagerank(list(range(30)), edges, 0.3, first), abs=1e-12 if not mixed else 1e-7)


def test_credit_of_a_prior_is_computed_once(spark, capsys):
    PG.priors(C.fractional_credit(fixtures.fact(spark, SF)), "affil", "affil_id", 0.5).explain()
    plan = capsys.readouterr().out
    assert "FileScan" in plan and "l_orderkey" not in plan


def test_author_citations_of_two_layers_are_joined_once(spark, capsys):
    PG.two_layers(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "FileScan" in plan and "o_custkey" not in plan
