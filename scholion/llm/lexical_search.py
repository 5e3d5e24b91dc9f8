"""Exact ranked lexical search on dual-sorted wavelet trees, one for each shard.

A shard holds some documents of one input partition. Each term's postings are
ordered by falling impact, and all of them together are one sequence of document
numbers, kept as a wavelet matrix. So a term is a range of the sequence in
impact order, and following the bits of document numbers downwards splits the
range by document: a node is an interval of document numbers, a term's range in
it is still in impact order, so that its first posting bounds the term's impact
on every document below. Documents are numbered by rising id.

A query keeps a frontier of nodes with the ranges of its terms and the sum of
their bounds, opens the best nodes first, some at a time, and drops every node
that the k-th best document found so far rules out, with ties going to the
smaller number. At the bottom ranges hold one posting, so bounds are scores, and
the search ends when no node is left: the result is exact. Shards of one task
hand on the k-th best score as a lower bound.

The score of a document is the sum over the query's terms, repeats included, of
w * ((10^9 tf) div (1000 tf + 8 m)), with w = floor(1000 ln((2N + 2) / (2 df +
1))) and m = 25 + (75 n N) div L in integers.

Scale: documents are read once, by tasks that count terms within their shard; no
posting is ever shuffled. N, L and df are sums over the shards. An index row is
bounded in postings and documents, but for one longer document. Queries are
taken in blocks of bounded bytes, each broadcast; every shard answers with k
rows for a query at most. Where all queries' terms fit MOST_TERMS, the index of
`search_items` holds only those; otherwise, and in `postings` by itself, all.

Words are maximal runs of ASCII letters and digits and of all other characters
beyond ASCII; only A-Z are lower-cased. Null and empty texts have no terms and
are no documents of N. Repeated rows are documents of their own; equal scores
are ordered by id, null ids last. Very long texts are indexed whole. Items
without terms have no result, repeated items one each, null item ids stay null.
Empty tables give an empty result. Other columns do not matter.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scholion.llm import _text as X
from scholion.runtime import checkpointed, discard

#: Bounds of a shard.
SHARD_POSTINGS = 1 << 19
SHARD_DOCS = 1 << 16
#: Queries broadcast at once, and terms of the queries that an index is restricted to.
BLOCK_BYTES = 4 << 20
MOST_TERMS = 1 << 20
#: Nodes opened at once: few first, so that the k-th best score rises early.
FIRST_NODES, MOST_NODES = 16, 512

POSTINGS = "ids array<{id}>, sizes array<bigint>, terms array<string>, counts array<bigint>, docs array<int>, tfs array<int>, n_docs bigint, n_terms bigint"
INDEX = "ids array<{id}>, terms array<string>, starts array<bigint>, impacts binary, bits array<binary>"


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and n+1 word offsets of the texts."""
    data, at = X.text_buffer(column)
    starts, ends, words_at = X.split_words(data, at, X.ALNUM)
    chars = X.LOWER[data[X.ALNUM[data]]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chars)), words_at


def _posted(vocabulary: Broadcast | None, id_type: pa.DataType, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards' documents, lengths and postings by term; terms outside the vocabulary count in lengths only."""

    def flush(parts: list, n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids = pa.chunked_array([p[0] for p in parts], id_type).combine_chunks() if parts else pa.array([], id_type)
        sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        words = pa.chunked_array([p[2] for p in parts], pa.large_string()).combine_chunks() if parts else pa.array([], pa.large_string())
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        docs = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)]) if parts else np.zeros(0, np.int64)
        tfs = np.concatenate([p[4] for p in parts]) if parts else np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        code = np.empty(len(by_name), np.int64)
        code[by_name] = np.arange(len(by_name))
        code = code[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        terms = coded.dictionary.take(pa.array(by_name)).cast(pa.string())
        columns = [one(ids, id_type), one(sizes, pa.int64()), one(terms, pa.string()), one(np.bincount(code, minlength=len(by_name)), pa.int64()), one(docs[order], pa.int32()), one(tfs[order], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "terms", "counts", "docs", "tfs", "n_docs", "n_terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(pickle.loads(vocabulary.value), pa.large_string()) if vocabulary else None
        parts, held, rows, n_docs, n_terms = [], 0, 0, 0, 0
        for batch in batches:
            for a, b in X.blocks(batch.column(1)):
                words, at = words_of(batch.column(1).slice(a, b - a))
                size = np.diff(at)
                n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + len(words)
                if known is None:
                    coded = words.dictionary_encode()
                    code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
                else:
                    code, names = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(), known
                doc = X.doc_of(at)
                hit = code >= 0
                pair, tf = np.unique(doc[hit] * max(1, len(names)) + code[hit], return_counts=True)
                owner, term = pair // max(1, len(names)), pair % max(1, len(names))
                some = np.unique(owner)
                parts.append((batch.column(0).slice(a, b - a).take(pa.array(some)), size[some], names.take(pa.array(term)), np.searchsorted(some, owner), tf))
                held, rows = held + len(pair), rows + len(some)
                if held >= most or rows >= SHARD_DOCS:
                    yield flush(parts, n_docs, n_terms)
                    parts, held, rows, n_docs, n_terms = [], 0, 0, 0, 0
        if n_docs:
            yield flush(parts, n_docs, n_terms)

    return run


def postings(docs: DataFrame, vocabulary: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = SHARD_POSTINGS) -> DataFrame:
    """Rows of POSTINGS: the documents and terms of each shard; of the vocabulary's terms, if one is given."""
    kind = docs.schema[id_col].dataType
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(pickle.dumps(sorted(set(vocabulary))))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_posted(known, to_arrow_type(kind), most), POSTINGS.format(id=kind.simpleString()))


def _indexed(n: int, total: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = {name: batch.column(j)[k].values for j, name in enumerate(batch.schema.names) if name not in ("n_docs", "n_terms")}
                ids = own["ids"]
                by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                number = np.empty(len(ids), np.int64)
                number[by_id] = np.arange(len(ids))
                size, docs, tf = own["sizes"].to_numpy(), own["docs"].to_numpy().astype(np.int64), own["tfs"].to_numpy().astype(np.int64)
                m = 25 + np.array([75 * s * n // total for s in size.tolist()], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
                counts = own["counts"].to_numpy()
                starts = np.concatenate([[0], np.cumsum(counts)])
                order = np.lexsort((number[docs], -impact, np.repeat(np.arange(len(counts)), counts)))
                symbols, bits = number[docs][order], []
                for level in range(max(1, int(len(ids) - 1).bit_length()) - 1, -1, -1):
                    bit = (symbols >> level) & 1 == 1
                    bits.append(np.packbits(bit).tobytes())
                    symbols = np.concatenate([symbols[~bit], symbols[bit]])
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                columns = [one(ids.take(pa.array(by_id)), id_type), one(own["terms"], pa.string()), one(starts, pa.int64()), pa.array([impact[order].astype(np.int32).tobytes()], pa.binary()), one(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "starts", "impacts", "bits"])

    return run


class DualSorted:
    """One shard's postings: term ranges in impact order at the top, documents by number at the bottom."""

    def __init__(self, starts: np.ndarray, impacts: np.ndarray, bits: list[bytes], n_docs: int) -> None:
        self.starts, self.levels, n = starts, len(bits), len(impacts)
        self.n_docs = n_docs
        self.zeros = np.zeros((self.levels, n + 1), np.int32)
        self.impacts = np.empty((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n], self.impacts[:, n] = impacts, 0
        for level, raw in enumerate(bits):
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
            np.cumsum(~bit, out=self.zeros[level, 1:])
            here = self.impacts[level, :n]
            self.impacts[level + 1, :n] = np.concatenate([here[~bit], here[bit]])
        self.n_zeros = self.zeros[:, -1].astype(np.int64)
        #: Nodes that searches have opened, for tests and figures.
        self.opened = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> list[tuple[int, int]]:
        """(score, document) of the k best documents that score `least` or more, best first, ties by document."""
        if not len(terms):
            return []
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        low, high = self.starts[terms][None, :].astype(np.int64), self.starts[terms + 1][None, :].astype(np.int64)
        bound = (weights * self.impacts[0][low[0]]).sum()[None]
        best: list[tuple[int, int]] = []
        many, last = FIRST_NODES, self.n_docs
        while True:
            first = prefix << (self.levels - level)
            alive = np.flatnonzero((bound > least) | ((bound == least) & (first <= last)))
            if not len(alive):
                return best
            level, prefix, low, high, bound = level[alive], prefix[alive], low[alive], high[alive], bound[alive]
            if len(alive) > many:
                top = np.argpartition(-bound, many)
                top, rest = top[:many], top[many:]
            else:
                top, rest = np.arange(len(alive)), np.zeros(0, np.int64)
            many = min(MOST_NODES, 2 * many if len(best) == k else many + 2)
            self.opened += len(top)
            at, lo, hi = level[top][:, None], low[top], high[top]
            lo0, hi0 = self.zeros[at, lo].astype(np.int64), self.zeros[at, hi].astype(np.int64)
            ones = self.n_zeros[at]
            lows, highs = np.concatenate([lo0, ones + lo - lo0]), np.concatenate([hi0, ones + hi - hi0])
            below = np.concatenate([level[top], level[top]]) + 1
            numbers = np.concatenate([2 * prefix[top], 2 * prefix[top] + 1])
            bounds = (np.where(highs > lows, self.impacts[below[:, None], lows], 0) * weights).sum(1)
            bottom = (below == self.levels) & (bounds >= least)
            if bottom.any():
                best += zip(bounds[bottom].tolist(), numbers[bottom].tolist(), strict=True)
                best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    least, last = best[-1]
            inner = (below < self.levels) & (bounds >= least)
            level, prefix = np.concatenate([level[rest], below[inner]]), np.concatenate([prefix[rest], numbers[inner]])
            low, high, bound = np.concatenate([low[rest], lows[inner]]), np.concatenate([high[rest], highs[inner]]), np.concatenate([bound[rest], bounds[inner]])


def _searched(queries: Broadcast, k: int, id_type: pa.DataType, item_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item_no, item_id, doc_id, score) of each shard's best documents for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pickle.loads(queries.value)  # (number, id, {term: weight})
        known: dict[int, list[int]] = {}  # the best scores of earlier shards of this task
        for batch in batches:
            for row in range(len(batch)):
                ids, terms, starts, impacts, bits = (batch.column(j)[row] for j in range(5))
                ids = ids.values
                shard = DualSorted(starts.values.to_numpy(), np.frombuffer(impacts.as_buffer(), np.int32), bits.as_py(), len(ids))
                place = {t: j for j, t in enumerate(terms.as_py())}
                out: tuple[list, list, list, list] = ([], [], [], [])
                for number, item, weights in asked:
                    own = [(place[t], w) for t, w in weights.items() if t in place]
                    scores = known.setdefault(number, [])
                    found = shard.search(np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64), k, scores[-1] if len(scores) == k else 1)
                    known[number] = sorted([*scores, *(s for s, _ in found)], reverse=True)[:k]
                    for score, doc in found:
                        for column, value in zip(out, (number, item, doc, score), strict=True):
                            column.append(value)
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], item_type), ids.take(pa.array(out[2], pa.int64())), pa.array(out[3], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_no", "item_id", "doc_id", "score"])

    return run


class LexicalIndex:
    """Shards of an index as a written table, with N, L and the df of each term."""

    def __init__(self, docs: DataFrame, vocabulary: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = SHARD_POSTINGS) -> None:
        self.id_type = docs.schema[id_col].dataType
        posted = checkpointed(postings(docs, vocabulary, id_col, text_col, most))
        self.n, self.total = (int(x or 0) for x in posted.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        self.df = checkpointed(posted.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df")))
        self.shards = checkpointed(posted.mapInArrow(_indexed(self.n, self.total, to_arrow_type(self.id_type)), INDEX.format(id=self.id_type.simpleString())))
        discard(posted)

    def _weights(self, terms: set[str]) -> dict[str, int]:
        """w of the terms that documents hold."""
        spark = self.df.sparkSession
        asked = spark.createDataFrame(pa.table({"term": pa.array(sorted(terms), pa.string())}))
        return {r.term: math.floor(1000 * math.log((2 * self.n + 2) / (2 * r.df + 1))) for r in self.df.join(F.broadcast(asked), "term").collect()}

    def search(self, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """item_id, rank, doc_id, score of each item's k best documents."""
        spark = self.shards.sparkSession
        item_type = items.schema[item_col].dataType
        kind = f"item_no long, item_id {item_type.simpleString()}, doc_id {self.id_type.simpleString()}, score long"
        found = None
        for block in _blocks(items.select(item_col, text_col), block_bytes):
            weights = self._weights({t for _, _, counts in block for t in counts})
            asked = [(number, item, {t: c * weights[t] for t, c in counts.items() if weights.get(t)}) for number, item, counts in block]
            shared = spark.sparkContext.broadcast(pickle.dumps(asked))
            part = self.shards.mapInArrow(_searched(shared, k, to_arrow_type(self.id_type), to_arrow_type(item_type)), kind)
            found = part if found is None else found.union(part)
        if found is None:
            found = spark.createDataFrame([], kind)
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """(number, id, counts of terms) of the items that have terms, some at a time."""
    block, size = [], 0
    for number, (item, text) in enumerate(items.where(F.col(items.columns[1]).isNotNull()).toLocalIterator()):
        counts = Counter(words_of(pa.array([text], pa.string()))[0].to_pylist())
        if not counts:
            continue
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((number, item, counts))
        size += len(text)
    if block:
        yield block


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in X.blocks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([words_of(batch.column(0).slice(a, b - a))[0].unique().cast(pa.string())], names=["term"])


def search_items(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's k best documents, by an index of the items' terms."""
    terms = checkpointed(items.select("text").mapInArrow(_terms, "term string").distinct())
    few = terms.count() <= MOST_TERMS
    return LexicalIndex(docs, [r.term for r in terms.toLocalIterator()] if few else None).search(items, k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_items(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


WORDS_SQL = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, {WORDS_SQL.format(text="text")} AS words FROM documents
), corpus AS (
  SELECT count(*) AS n, sum(len(words))::BIGINT AS total FROM docs WHERE len(words) > 0
), items AS (
  SELECT row_number() OVER () AS item_no, item_id, unnest({WORDS_SQL.format(text="text")}) AS term FROM benchmark
), asked AS (
  SELECT item_no, item_id, term, count(*) AS qtf FROM items GROUP BY ALL
), tfs AS (
  SELECT row_no, doc_id, len(words) AS size, unnest(words) AS term FROM docs
), posted AS (
  SELECT row_no, doc_id, size, term, count(*) AS tf FROM tfs WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posted, corpus GROUP BY term
), scored AS (
  SELECT item_no, item_id, row_no, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN posted USING (term), corpus GROUP BY ALL
), numbered AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM numbered WHERE rank <= 10
"""
