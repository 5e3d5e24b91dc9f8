"""Ranked search, n-gram join and prefix trie against brute force and SQL, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.llm import lexical_search, ngram_join, prefix_trie

DOCS = "doc_id long, text string, lang string"
SF = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))


def sentence(rng, n, vocabulary=60):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [None, "", " ,\n", "W1", "w1 W1 é_É", sentence(rng, 4000), *(sentence(rng, rng.choice([2, 9, 40])) for _ in range(40))]
    texts += [texts[8]] * 4
    out = [(k, t, "en") for k, t in enumerate(texts)] + [(None, texts[9], "en"), (9, texts[9], "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def ranked(rows, items, k):
    docs = [(d, Counter(terms(t))) for d, t, *_ in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 25 + 75 * sum(c.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "block"), [(1 << 19, 1 << 20), (30, 1 << 20), (200, 10)])
def test_search_is_the_ranking_of_all_documents(spark, docs, rows, most, block):
    items = [(1, "w1 w2 W2 é"), (2, "nothing here?"), (3, None), (4, ""), (5, rows[8][1]), (None, "w3 w9"), (7, rows[5][1]), (7, "w4")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for vocabulary in (None, sorted({t for _, x in items for t in terms(x)})):
        found = lexical_search.LexicalIndex(docs, vocabulary, most=most).search(bench, 5, block_bytes=block)
        assert sorted((tuple(r) for r in found.collect()), key=str) == ranked(rows, items, 5)


def test_search_of_empty_tables_and_other_columns(spark, docs, rows):
    bench = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical_search.search_items(docs.limit(0), bench).count() == 0
    assert lexical_search.search_items(docs, bench.limit(0)).count() == 0
    named = docs.selectExpr("'a' || doc_id AS doc_id", "text", "1 AS score", "2 AS rank", "3 AS terms")
    found = lexical_search.search_items(named, bench.withColumn("doc_id", F.lit(5)))
    assert sorted(r["score"] for r in found.collect()) == sorted(r[3] for r in ranked(rows, [(1, "w1 w2")], 10))


def test_search_opens_few_nodes():
    rng = np.random.default_rng(5)
    n, parts = 5000, 2
    docs = [np.sort(rng.choice(n, 3000, replace=False)) for _ in range(parts)]
    impacts = [rng.integers(1, 1000, 3000) for _ in range(parts)]
    best = np.intersect1d(*docs)[7]
    for d, i in zip(docs, impacts, strict=True):
        i[d == best] = 5000
    order = [np.lexsort((d, -i)) for d, i in zip(docs, impacts, strict=True)]
    symbols = np.concatenate([d[o] for d, o in zip(docs, order, strict=True)])
    flat = np.concatenate([i[o] for i, o in zip(impacts, order, strict=True)])
    bits, rest = [], symbols
    for level in range((n - 1).bit_length() - 1, -1, -1):
        bit = (rest >> level) & 1 == 1
        bits.append(np.packbits(bit).tobytes())
        rest = np.concatenate([rest[~bit], rest[bit]])
    shard = lexical_search.DualSorted(np.array([0, 3000, 6000]), flat.astype(np.int32), bits, n)
    score = np.zeros(n, np.int64)
    for d, i, w in zip(docs, impacts, (3, 2), strict=True):
        np.add.at(score, d, w * i)
    want = sorted(((int(s), d) for d, s in enumerate(score.tolist()) if s), key=lambda x: (-x[0], x[1]))
    for k in (1, 3, 200):
        shard.opened = 0
        assert shard.search(np.array([0, 1]), np.array([3, 2]), k) == want[:k]
        assert k > 1 or shard.opened < 500


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def joined(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def families():
    """Edited copies around the threshold, chains of them, a passage in most texts, sizes of neighbouring bands."""
    rng = random.Random(3)
    words = lambda n: [f"v{rng.randrange(9999)}" for _ in range(n)]
    passage, texts = words(40), [None, "", "\n \t", "One", "one", "a b c", "a B c", "a b c d"]
    for n in (17, 20, 45, 300):
        base = words(n)
        texts.append(" ".join(base))
        for edits in range(1, 7):
            base = list(base)
            base[rng.randrange(len(base))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(base[: len(base) - edits % 3]))
    for k in range(30):
        own = words(rng.choice([3, 8, 30, 90]))
        texts.append(" ".join(own[: k % 5] + passage + own[k % 5 :]))
    for k in range(12):
        texts.append(" ".join([*passage, *words(k % 4)]))
    texts.append(" ".join(words(5000)))
    texts += [texts[9], texts[40].upper()]
    return [(k, t, "en") for k, t in enumerate(texts)] + [(None, texts[12], "en"), (3, texts[60], "en"), (None, "only here by null id and four", "en")]


@pytest.mark.parametrize(("most", "block"), [(4000, 500), (3, 2)])
def test_join_is_all_pairs(spark, families, monkeypatch, most, block):
    monkeypatch.setattr(ngram_join, "MOST_OTHERS", most)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = spark.createDataFrame(families, DOCS).repartition(3)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == joined(families)


def test_join_of_empty_tables_and_other_columns(spark, families):
    docs = spark.createDataFrame(families[:16], DOCS)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    named = docs.selectExpr("doc_id AS node", "text AS content", "1 AS n", "2 AS key", "3 AS id")
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(named, "node", "content").collect()), key=str)
    assert got == joined(families[:16])


def test_signatures_bound_the_overlap_from_above():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for _ in range(100):
        a, b = (np.unique(rng.choice(pool, rng.integers(60, 300))) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        for bits in (64, 256):
            x, y = (np.frombuffer(ngram_join.signature(s, bits), np.uint64)[None] for s in (a, b))
            assert (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2 >= shared
            assert (ngram_join._folded(np.frombuffer(ngram_join.signature(a, 2 * bits), np.uint64)[None], bits // 64) == x).all()


def test_bands_of_sets_that_link_are_neighbours():
    n = np.arange(1, 40_000)
    low = -(-85 * n // 100)
    assert (ngram_join.band_of(n) - ngram_join.band_of(np.maximum(low, 1)) <= 1).all()


def trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_is_that_of_all_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 4)
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 40), 101, 102, 103, 5003]:
        if c in (10, 20):
            continue
        n = rng.choice([1, 2, 4, 7, 12, 30])
        shared = rng.choice([0, 2, 5, 20])
        rows += [(c, k, "user", f"common {k}" if k < shared else rng.choice(["é", "x", f"own {rng.randrange(5)}"])) for k in range(n)]
    rows += [(3, None, None, None), (3, None, "user", None), (4, 1, "user", "again"), (4, 1, "user", "again"), (None, 1, "user", "nobody"), (6, 2, None, "z" * 5000)]
    rows += [(30, 200 + k, "user", f"deep {k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    frame = frame.withColumn("depth", F.lit(1)).withColumn("part", F.lit(2))
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).collect()), key=str) == trie(rows)
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0
    few = [r for r in rows if r[0] == 11][:1]  # without turns of its own or of conversation 10
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(few, "conv_id long, turn long, role string, text string")).collect()] == trie(few)


@pytest.mark.parametrize("module", [lexical_search, ngram_join, prefix_trie])
def test_equals_sql(spark, module):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    query = next(f for n, f in vars(module).items() if re.match(r"op\d+_", n))
    df = query(spark, SF)
    out = duck.execute(module.ORACLE_SQL)
    names = [x[0] for x in out.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(out.fetchall(), key=str)


def test_a_worker_of_the_join_gives_memory_back_after_each_batch(monkeypatch):
    import pyarrow as pa

    from scholion.llm import ngram_join as J

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(J.pa, "system_memory_pool", Pool)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e", None]), pa.array([3, 4])], names=["id", "text", "raw"])
    assert [len(x) for x in J.lean(J._signed)(iter([batch, batch]))] == [2, 2] and Pool.released == 2
