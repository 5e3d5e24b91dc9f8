"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with how often it
has occurred before in the text. One sketch takes the PICKS labelled shingles
with the smallest hashes and hashes them in text order; a text has TABLES
sketches. Texts that share a sketch meet in a bucket.

Similarity is m / (n1 + n2 - m) with m the longest common subsequence of the
labelled shingles; so it counts order, and a block move costs. Whatever reaches
a threshold t leaves at most (n1 + n2) (1 - t) / (1 + t) shingles unmatched, so
all its matches lie in a band of that half-width, and within it labelled
shingles are unique, so the alignment is a longest increasing run. Verified
links join texts into classes.

Scale: equal texts are one node from the first aggregation on. In each bucket
a hub is compared with the others: the member with the most company in all its
buckets, which is the original of a family of edited copies. That gives the
first classes, and most buckets then hold one class only: they are closed. In
an open bucket the members outside its largest class are compared with each
other and with all of that class, both dealt out in blocks of MOST_OTHERS
members and every pair of blocks being a group, so a task gathers two blocks at
most. The work is the product of the members outside and all members: linear
in the bucket while few are outside, and no bucket is left out where many are.
So every two texts that share a sketch are in one class or were compared. A
block is bounded in shingles, too, but for a text that is longer by itself. Hubs
are salted by their company, which bounds their members. Broadcasts are behind
a count.

A text without words (null, empty) is a class of its own row id. A text of
fewer than five words is one shingle. Repeated rows share a class. Null ids are
kept and share the class of equal texts. Rows are told apart by id and a hash
of their text, so null and repeated ids do no harm. Ties between hubs and
between classes go to the larger content hash, ties between survivors to the
smaller text hash. Very long texts are sketched and aligned whole. An empty
table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm import _text as X
from scholion.llm.graph import components
from scholion.runtime import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 14
PICKS = 3
#: At most so many ids are broadcast; beyond, the join shuffles.
MOST_BROADCAST_ROWS = 1_000_000
#: Members of a block of a bucket, and shingles; a task gathers two blocks.
MOST_OTHERS = 200
MOST_SHINGLES = 2_000_000
#: One salt for so many members of a hub.
MEMBERS_A_SALT = 2000

_PLACE_BITS = X.U(24)
_TOP = X.U((1 << 64) - (1 << 24))
_FULL = X.U((1 << 64) - 1)


def labelled_shingles(h: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of occurrence-labelled shingles, unique within a document, and document offsets."""
    s, to = X.shingles(h, at, k)
    doc = X.doc_of(to)
    for a in range(0, len(at) - 1, 1 << 15):  # a few documents at a time, so that the number fits beside the hash
        b = min(a + (1 << 15), len(at) - 1)
        own = s[to[a] : to[b]]
        key = ((doc[to[a] : to[b]] - a).astype(np.uint64) << X.U(49)) | (own >> X.U(15))
        ordered = np.sort(key)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            continue
        rows = np.flatnonzero(np.isin(key, np.unique(again)))
        by = np.lexsort((rows, own[rows], key[rows]))
        rows = rows[by]
        fresh = np.concatenate([[True], (own[rows][1:] != own[rows][:-1]) | (key[rows][1:] != key[rows][:-1])])
        nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
        s[to[a] + rows] = np.where(nth > 0, X.mix(own[rows] + nth.astype(np.uint64) * X.U(0x9E3779B97F4A7C15)), own[rows])
    return s, to


def order_minhash(s: np.ndarray, to: np.ndarray, tables: int = TABLES, picks: int = PICKS) -> np.ndarray:
    """Sketches, documents x tables; 0 for documents without shingles."""
    out = np.zeros((len(to) - 1, tables), np.uint64)
    some = np.flatnonzero(np.diff(to))
    if not len(some):
        return out
    heads = to[some]
    sizes = np.diff(to)[some]
    owner = np.repeat(np.arange(len(some)), sizes)
    place = (np.arange(len(s)) - np.repeat(heads, sizes)).astype(np.uint64) & X.U((1 << 24) - 1)
    for t in range(tables):
        x = (s ^ X.U((0x9E3779B97F4A7C15 * (t + 1)) % (1 << 64))) * X.U(0xD6E8FEB86659FD93)
        x ^= x >> X.U(32)
        x = ((x * X.U(0xD6E8FEB86659FD93)) & _TOP) | place
        least = []
        for j in range(picks):
            m = np.minimum.reduceat(x, heads)
            least.append(m)
            if j + 1 < picks:
                x[x == m[owner]] = _FULL
        least = np.stack(least)
        found = least != _FULL
        spot = np.where(found, heads + (least & X.U((1 << 24) - 1)).astype(np.int64), len(s))
        spot.sort(axis=0)
        padded = np.concatenate([s, [X.U(0)]])
        value = np.full(len(some), t + 1, np.uint64)
        for j in range(picks):
            value = X.mix(value * X.U(0x9E3779B97F4A7C15) + padded[spot[j]])
        out[some, t] = value
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Banded alignment of two labelled shingle sequences; exact from `least` on, and under `least` wherever the exact value is."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    oa, ob = np.argsort(a), np.argsort(b)
    place = np.searchsorted(b[ob], a[oa])
    place = np.minimum(place, nb - 1)
    hit = b[ob][place] == a[oa]
    ia, ib = oa[hit], ob[place[hit]]
    near = np.abs(ia - ib) <= (na + nb) * (1 - least) / (1 + least) + 1e-9
    ia, ib = ia[near], ib[near]
    if len(ia) < least * (na + nb - len(ia)):
        return len(ia) / (na + nb - len(ia))
    run = ib[np.argsort(ia)]
    if (run[1:] > run[:-1]).all():
        m = len(run)
    else:
        tails: list[int] = []
        for y in run.tolist():
            k = bisect_left(tails, y)
            if k == len(tails):
                tails.append(y)
            else:
                tails[k] = y
        m = len(tails)
    return m / (na + nb - m)


def _contents(h: np.ndarray, words_at: np.ndarray) -> list[bytes | None]:
    raw = memoryview(h.tobytes())
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(words_at[:-1].tolist(), words_at[1:].tolist(), strict=True)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in X.blocks(batch.column(1), 2 << 20):
            data, at = X.text_buffer(batch.column(1).slice(a, b - a))
            starts, ends, words_at = X.split_words(data, at)
            h = X.hash_words(data, starts, ends)
            shingles, to = labelled_shingles(h, words_at)
            sketches = order_minhash(shingles, to)
            flat = pa.array(sketches.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(_contents(h, words_at), pa.binary()), pa.array(np.diff(to)), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * TABLES), flat)],
                names=["id", "raw", "content", "size", "sketches"],
            )


def _shingle_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in X.blocks(batch.column(1), 2 << 20):
            data, at = X.text_buffer(batch.column(1).slice(a, b - a))
            starts, ends, words_at = X.split_words(data, at)
            h = X.hash_words(data, starts, ends)
            wanted = batch.column(0).slice(a, b - a).to_pylist()
            right = np.array([x == y for x, y in zip(_contents(h, words_at), wanted, strict=True)], bool)
            s, to = labelled_shingles(h, words_at)
            raw = memoryview(s.tobytes())
            rows = np.flatnonzero(right).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([wanted[k] for k in rows], pa.binary()), pa.array([bytes(raw[8 * to[k] : 8 * to[k + 1]]) for k in rows], pa.binary())], names=["content", "shingles"])


def _verify(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            good = [similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) >= least for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4)], names=["a", "b", "company"]).filter(pa.array(good, pa.bool_()))

    return run


def _links(edges: DataFrame, blobs: DataFrame, least: float) -> DataFrame:
    """The edges (a, b, company) whose ends are similar, b being a hub with so much company."""
    salts = F.ceil(F.col("company") / MEMBERS_A_SALT)
    left = edges.withColumn("salt", F.pmod(F.xxhash64("a"), salts)).join(blobs.select(F.col("content").alias("a"), F.col("shingles").alias("sa")), "a")
    hubs = edges.select("b", "company").distinct().join(blobs.select(F.col("content").alias("b"), F.col("shingles").alias("sb")), "b")
    hubs = hubs.select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return left.join(hubs, ["b", "salt"]).select("a", "b", "sa", "sb", "company").mapInArrow(_verify(least), "a binary, b binary, company bigint")


def _bins(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> X.U(56)).astype(np.int64), minlength=256).astype(np.int32)


def _within(least: float) -> Callable[[pa.Table], pa.Table]:
    """Links between members of different classes in one part of a bucket.

    Texts whose lengths, or counts of shingles by leading bits, rule the
    similarity out are not aligned, nor pairs that are connected already. In a
    part after the first only members that differ in `other` meet.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.lexsort((np.array(rows.column("content").to_pylist(), object), pa.compute.binary_length(rows.column("shingles")).to_numpy()))))
        names, roots = rows.column("content").to_pylist(), rows.column("root").to_pylist()
        other, later = rows.column("other").to_numpy(), rows.column("part")[0].as_py() > 0
        texts = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        size = np.array([len(t) for t in texts])
        bins = np.stack([_bins(t) for t in texts])
        number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        root = np.array([number[r] for r in roots])
        a, b = [], []
        for i in range(len(names)):
            to = int(np.searchsorted(size, size[i] / least, side="right"))
            open_to = (root[i + 1 : to] != root[i]) & (other[i + 1 : to] ^ other[i] if later else True)
            near = i + 1 + np.flatnonzero(open_to)
            most = np.minimum(bins[i], bins[near]).sum(1)
            for j in near[most >= least * (size[i] + size[near] - most)].tolist():
                if root[i] != root[j] and similarity(texts[i], texts[j], least) >= least:
                    root[root == root[j]] = root[i]
                    a.append(names[i])
                    b.append(names[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _compared(opened: DataFrame, blobs: DataFrame, least: float) -> DataFrame:
    """Links a, b of the buckets' members outside the largest class with all members.

    The members outside are blocks 0 to n - 1, the largest class those from n
    on. Block i < n meets itself in cell (i, i) and each later block j in cell
    (i, j), where `other` then tells the two apart; cell (0, 0) of a bucket with
    n = 1 also holds the first block of the largest class.
    """
    place = F.xxhash64("content")
    blocks = opened.select("table", "key", "content", "root", "other", "n", "m").withColumn("block", F.when(F.col("other"), F.pmod(place, "n")).otherwise(F.col("n") + F.pmod(place, "m")))
    cells = F.expr("""
        CASE WHEN n = 1 AND other THEN transform(sequence(0L, m - 1), k -> struct(0L AS i, k AS part, true AS other))
             WHEN n = 1 THEN array(struct(0L AS i, block - 1 AS part, false AS other))
             WHEN other THEN transform(sequence(0L, n + m - 1), k -> struct(least(k, block) AS i, greatest(k, block) - least(k, block) AS part, k >= block AS other))
             ELSE transform(sequence(0L, n - 1), k -> struct(k AS i, block - k AS part, false AS other)) END""")
    dealt = blocks.withColumn("cells", cells).select("table", "key", "content", "root", "cells").join(blobs, "content").withColumn("cell", F.explode("cells"))
    dealt = dealt.select("table", "key", "content", "root", "shingles", "cell.*")
    return dealt.groupBy("table", "key", "i", "part").applyInArrow(_within(least), "a binary, b binary")


def _hub_links(members: DataFrame, blobs: DataFrame, least: float) -> DataFrame:
    """Links a, b, company of the buckets' members with b, the member with the most company."""
    hubs = members.groupBy("table", "key").agg(F.max(F.struct("company", "content")).alias("hub")).select("table", "key", F.col("hub.content").alias("b"), F.col("hub.company").alias("hub_company"))
    edges = members.join(hubs, ["table", "key"]).where("content <> b").select(F.col("content").alias("a"), "b", F.col("hub_company").alias("company")).distinct()
    return checkpointed(_links(checkpointed(edges), blobs, least))


def _first_classes(links: DataFrame) -> DataFrame:
    """content, root of the texts with a hub: the best hub's best hub, four steps up at most.

    Hubs rank above their members, so steps never turn back; equal roots are
    connected, but not all that is connected has the same root yet.
    """
    up = links.groupBy("a").agg(F.max_by("b", F.struct("company", "b")).alias("b"))
    for _ in range(2):
        top = up.select(F.col("a").alias("b"), F.col("b").alias("top"))
        up = up.join(top, "b", "left").select("a", F.coalesce("top", "b").alias("b"))
    return up.select(F.col("a").alias("content"), F.col("b").alias("root"))


def _opened(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the buckets with several classes: root, whether it is not the largest, and blocks of members outside the largest class and in it."""
    members = checkpointed(members.join(classes, "content", "left").withColumn("root", F.coalesce("root", "content")))
    by_class = members.groupBy("table", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sizes = by_class.groupBy("table", "key").agg(F.max(F.struct("n", "root", "size")).alias("major"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > major.n")
    blocks = lambda n, size: F.greatest(F.ceil(n / MOST_OTHERS), F.ceil(size / MOST_SHINGLES))
    sizes = sizes.select("table", "key", F.col("major.root").alias("major"), blocks(F.col("n") - F.col("major.n"), F.col("size") - F.col("major.size")).alias("n"), blocks(F.col("major.n"), F.col("major.size")).alias("m"))
    return checkpointed(members.join(sizes, ["table", "key"]).withColumn("other", F.expr("root <> major")))


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id, raw (hash of the text), content of every row; content, pick (the first row) of every content; node, root of the linked ones."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("raw"))
    rows = checkpointed(texts.mapInArrow(_sketch, f"id {id_type}, raw bigint, content binary, size bigint, sketches array<bigint>"))
    pick = F.struct(F.col("id").isNull().alias("no_id"), "id", "raw")
    nodes = checkpointed(rows.where("content IS NOT NULL").groupBy("content").agg(F.min(pick).alias("pick"), F.any_value("size").alias("size"), F.any_value("sketches").alias("sketches")))
    members = nodes.select("content", "size", F.posexplode("sketches").alias("table", "key"))
    counts = members.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(members.join(counts, ["table", "key"]))
    company = members.groupBy("content").agg(F.sum("n").alias("company"))
    found = nodes.join(company, "content")
    n_found = company.count()
    wanted = found.select(F.col("pick.id").alias("wanted_id"), F.col("pick.raw").alias("wanted_raw"), "content")
    wanted = F.broadcast(wanted) if n_found <= MOST_BROADCAST_ROWS else wanted
    blobs = checkpointed(texts.join(wanted, (F.col("raw") == F.col("wanted_raw")) & F.col("id").eqNullSafe(F.col("wanted_id"))).select("content", "text").mapInArrow(_shingle_blobs, "content binary, shingles binary").dropDuplicates(["content"]))
    members = members.join(company, "content").drop("n")
    links = _hub_links(members, blobs, least)
    opened = _opened(members, _first_classes(links))
    links = links.select("a", "b").union(_compared(opened, blobs, least))
    return rows.select("id", "raw", "content"), nodes.select("content", "pick"), components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id of every row; class_id is the smallest id of the row's class."""
    rows, nodes, classes = _classes(docs, id_col, text_col, least)
    alone = nodes.select("content", F.col("pick.id").alias("own"))
    roots = classes.join(alone.withColumnRenamed("content", "node"), "node")
    least_id = roots.groupBy("root").agg(F.min("own").alias("class_id"))
    by_content = roots.join(least_id, "root").select(F.col("node").alias("content"), "class_id")
    by_content = alone.join(by_content, "content", "left").select("content", F.coalesce("class_id", "own").alias("class_id"))
    return rows.select("id", "content").join(by_content, "content", "left").select(F.col("id").alias("doc_id"), F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest id, nulls last, in the columns of `docs`; rows without words stay."""
    rows, nodes, classes = _classes(docs, id_col, text_col, least)
    rooted = nodes.join(classes.withColumnRenamed("node", "content"), "content", "left")
    first = rooted.groupBy(F.coalesce("root", "content")).agg(F.min("pick").alias("pick"))
    kept = first.select("pick.id", "pick.raw", F.lit(True).alias("worded"))
    kept = checkpointed(kept.union(rows.where("content IS NULL").select("id", "raw", F.lit(False)).distinct()))
    own = docs.select(F.struct("*").alias("row"))
    same = F.col("id").eqNullSafe(F.col("row")[id_col]) & (F.col("raw") == F.xxhash64(F.col("row")[text_col]))
    repeated = rows.where("content IS NOT NULL").groupBy("id", "raw").count().where("count > 1")
    if repeated.isEmpty():
        return own.join(kept, same, "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns))
    left = own.join(kept, same)
    nth = F.row_number().over(Window.partitionBy("id", "raw").orderBy("worded"))
    once = left.where("worded").withColumn("nth", nth).where("nth = 1").drop("nth")
    return once.unionByName(left.where("NOT worded")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
