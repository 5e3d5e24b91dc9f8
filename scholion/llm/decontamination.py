"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside one Arrow batch. Its words are mapped to
the alphabet of the benchmark's words; any other word, and the end of a
document, is a separator, which no benchmark window contains. The shard's
suffixes are sorted, the Burrows-Wheeler transform goes into a wavelet matrix,
and every window of the benchmark is searched backwards, all at once.
Occurrences are located by walking to sampled suffix positions, and the spans
are merged per document.

The documents are never shuffled. The benchmark is broadcast in blocks of at
most `block_bytes` of text, made one after another; a task loads one block at a
time for each shard, so what driver and executors hold at once is bounded
whatever the benchmark's size.

Nulls and texts without words have no hits; so does an empty benchmark, and an
empty table gives an empty result. A text longer than a shard is a shard of its
own. Repeated rows are each judged. Item ids may have any type; items that share
an id are one. Other columns are passed through untouched.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scholion.llm import _text as X
from scholion.llm._suffix import suffix_ranks

SAMPLE_EVERY = 8
SPAN_FIELDS = ("first", "last", "first_byte", "last_byte")


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before position i."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        symbols = symbols.astype(np.uint16 if sigma < 1 << 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols & symbols.dtype.type(1 << level)) != 0
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = (c >> (self.levels - 1 - k)) & 1 == 1
            before_i, before_s = ones[i], ones[start]
            i = np.where(up, zeros + before_i, i - before_i)
            start = np.where(up, zeros + before_s, start - before_s)
        return i - start


class FMIndex:
    """Symbols 1..sigma-1 with separators 0; the last symbol is a separator."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        rank = suffix_ranks(text)
        n = len(text)
        places = np.empty(n, np.int64)
        places[rank] = np.arange(n)
        self.bwt = text[places - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        # the start of a run is always sampled, so that no walk passes a separator
        sampled = (places % SAMPLE_EVERY == 0) | (self.bwt == 0)
        self.mark = np.concatenate([[0], np.cumsum(sampled)])
        self.sample = places[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of `phrases`, all of one length."""
        c = phrases[:, -1]
        low, high = self.first[c], self.first[c + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[:, j]
            low = self.first[c] + self.wavelet.rank(c, low)
            high = self.first[c] + self.wavelet.rank(c, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        steps = 0
        while len(left):
            found = self.mark[rows + 1] > self.mark[rows]
            out[left[found]] = self.sample[self.mark[rows[found]]] + steps
            left, rows = left[~found], rows[~found]
            c = self.bwt[rows]
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The windows of one block of benchmark texts, over the alphabet of their words."""

    def __init__(self, texts: list[str], window: int) -> None:
        column = pa.array(texts, pa.string())
        data, at = X.text_buffer(column)
        starts, ends, words_at = X.split_words(data, at)
        low = X.LOWER[data].tobytes()
        h = X.hash_words(data, starts, ends)
        self.vocabulary, first, code = np.unique(h, return_index=True, return_inverse=True)
        self.words = [low[s:e] for s, e in zip(starts[first], ends[first], strict=True)]
        code = (code + 1).astype(np.int32)
        n = np.diff(words_at)
        #: (words a window, distinct windows as rows of codes, offsets of their owners, owners)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(np.minimum(n[n > 0], window)).tolist():
            own = np.flatnonzero(n >= window if size == window else n == size)
            count = n[own] - size + 1
            place = np.arange(count.sum()) + np.repeat(words_at[own] - (np.cumsum(count) - count), count)
            rows, which = np.unique(code[place[:, None] + np.arange(size)], axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1).astype(np.int64) * len(texts) + np.repeat(own, count))
            self.by_length.append((size, rows.astype(np.int64), np.searchsorted(pairs, np.arange(len(rows) + 1) * len(texts)), pairs % len(texts)))

    def codes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for those that the block does not have."""
        if not len(self.vocabulary) or not len(starts):
            return np.zeros(len(starts), np.int64)
        h = X.hash_spans(low, starts, ends)
        place = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == h, place + 1, 0)


def find_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, words_at: np.ndarray, phrases: Phrases) -> list[np.ndarray]:
    """Hits in a shard: (document, first word, words) of each, and (document, text) pairs."""
    code = phrases.codes(low, starts, ends)
    n = len(code)
    closes = np.zeros(n + 1, bool)  # a separator follows word i - 1
    closes[words_at] = True
    known = code > 0
    closes[1:] |= ~known
    place = np.flatnonzero(known)
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, 2), np.int64)]
    if not len(place) or not phrases.by_length:
        return none
    ends_run = closes[place + 1] | np.concatenate([place[1:] != place[:-1] + 1, [True]])
    to = np.arange(len(place)) + np.concatenate([[0], np.cumsum(ends_run)[:-1]])
    text = np.zeros(len(place) + int(ends_run.sum()), np.int64)
    text[to] = code[place]
    origin = np.zeros(len(text), np.int64)
    origin[to] = place
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    docs, firsts, sizes, items = [], [], [], []
    for size, rows, owner_at, owners in phrases.by_length:
        a, b = index.search(rows)
        hit = np.flatnonzero(b > a)
        if not len(hit):
            continue
        count = (b - a)[hit]
        row = np.repeat(a[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        word = origin[index.locate(row)]
        which = np.repeat(hit, count)
        # an exact check of the words behind the hashes
        checked = {k: b" ".join(phrases.words[c - 1] for c in rows[k]) for k in hit.tolist()}
        one = {}
        for k, w in zip(which.tolist(), word.tolist(), strict=True):
            one.setdefault(k, w)
        wrong = [k for k, w in one.items() if b" ".join(low[s:e].tobytes() for s, e in zip(starts[w : w + size], ends[w : w + size], strict=True)) != checked[k]]
        if wrong:
            good = ~np.isin(which, wrong)
            which, word = which[good], word[good]
        doc = np.searchsorted(words_at, word, side="right") - 1
        docs.append(doc)
        firsts.append(word)
        sizes.append(np.full(len(word), size))
        pairs = np.unique(np.stack([doc, which], axis=1), axis=0)
        items.extend(np.stack([np.full(owner_at[k + 1] - owner_at[k], d), owners[owner_at[k] : owner_at[k + 1]]], axis=1) for d, k in pairs.tolist())
    if not docs:
        return none
    return [np.concatenate(docs), np.concatenate(firsts), np.concatenate(sizes), np.concatenate(items)]


def _loaded(block: Broadcast) -> tuple[Phrases, list]:
    """A block's phrases and ids; the worker does not keep the bytes, so that it holds one block at a time."""
    out = pickle.loads(block.value)
    if getattr(block, "_path", None):
        vars(block).pop("_value", None)
    return out


def _searcher(shared: list, field: str, shard_bytes: int, item_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _loaded(shared[0]) if len(shared) == 1 else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(field))
            for a, b in X.blocks(column, shard_bytes):
                n = b - a
                data, at = X.text_buffer(column.slice(a, n))
                starts, ends, words_at = X.split_words(data, at)
                low = X.LOWER[data]
                cover = np.zeros(len(starts) + 1, np.int64)
                found: set[tuple] = set()
                for block in shared:
                    phrases, ids = only or _loaded(block)
                    _, word, size, pairs = find_spans(low, starts, ends, words_at, phrases)
                    np.add.at(cover, word, 1)
                    np.add.at(cover, word + size, -1)
                    found.update((d, ids[i]) for d, i in pairs.tolist())
                hit = np.cumsum(cover)[:-1] > 0
                edge = hit.copy()
                edge[1:] &= ~hit[:-1]
                inner = words_at[:-1][words_at[1:] > words_at[:-1]]
                edge[inner] = hit[inner]
                tail = hit.copy()
                tail[:-1] &= ~hit[1:]
                last = words_at[1:][words_at[1:] > words_at[:-1]] - 1
                tail[last] = hit[last]
                froms, tos = np.flatnonzero(edge), np.flatnonzero(tail)
                owner = np.searchsorted(words_at, froms, side="right") - 1
                base = at[owner]
                spans = [froms - words_at[owner], tos + 1 - words_at[owner], starts[froms] - base, ends[tos] - base]
                items = sorted(found)
                new = [
                    pa.array(np.diff(words_at).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in spans], names=SPAN_FIELDS)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(np.array([d for d, _ in items], np.int64), np.arange(n + 1)).astype(np.int32)), pa.array([i for _, i in items], item_type)),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), *new], names=["row", "n_words", "spans", "items"])

    return search


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, some at a time; one block without items if there are none."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(item_col, text_col).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        if ids and size + len(text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text)
    yield ids, texts


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20, shard_bytes: int = 4 << 20
) -> DataFrame:
    """`row` (a struct of all columns of `docs`), `n_words`, merged `spans` and `items`.

    A span is a struct of first and last word (excluded) and first and last
    byte (excluded) of a maximal run of hit words; `items` are the sorted ids
    of the items of which a window occurs. An item whose id or text is null has
    no windows.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(pickle.dumps((Phrases(texts, window), ids))) for ids, texts in _item_blocks(benchmark, item_col, item_text_col, block_bytes)]
    item_type = benchmark.schema[item_col].dataType
    frame = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField(name, T.LongType()) for name in SPAN_FIELDS])
    fields = [T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(item_type))]
    return frame.mapInArrow(_searcher(shared, "text", shard_bytes, to_arrow_type(item_type)), T.StructType(fields))


def hit_digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items, one row for each row of `benchmark_hits`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    return hits.select(
        F.col("row")[id_col].alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(hits: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The columns of the documents, with hit runs cut out of the text.

    Each cut leaves one space. A document of which nothing but white space is
    left goes. `size_col`, if there is one, is the length of what is left.
    """
    raw = F.encode(F.col("row")[text_col], "utf-8")
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("spans", lambda s: F.array(s["first_byte"], s["last_byte"]))), F.array(F.octet_length(F.col("row")[text_col]).cast("long")))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.decode(F.substring(raw, (F.element_at(bounds, 2 * i + 1) + 1).cast("int"), (F.element_at(bounds, 2 * i + 2) - F.element_at(bounds, 2 * i + 1)).cast("int")), "utf-8"),
    )
    left = F.when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(F.array_join(pieces, " "))
    out = hits.withColumn("_left", left).where((F.size("spans") == 0) | (F.trim("_left") != ""))
    names = next(f.dataType.names for f in hits.schema.fields if f.name == "row")
    kept = {text_col: F.col("_left"), size_col: F.when(F.size("spans") == 0, F.col("row")[size_col]).otherwise(F.char_length("_left").cast("long"))} if size_col in names else {text_col: F.col("_left")}
    return out.select(*(kept.get(c, F.col("row")[c]).alias(c) for c in names))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hit_digest(benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """The same digest by comparing every window with every place, for tests."""
    import re

    def words(text: str | None) -> list[str]:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, phrase in items:
            w = words(phrase)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                part = w[i : i + window]
                for j in range(len(own) - len(part) + 1):
                    if own[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        found.add(item)
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out
