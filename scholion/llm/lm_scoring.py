"""Language-model scores by deleted interpolation of word n-grams.

P(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights for each
bucket of the context's frequency. The weights are learned by expectation
maximisation on counts from which each training token is left out (deleted),
over all training tokens.

Counting works on packed blocks. A block is some megabytes of documents; it
sends each range of hashes one row with its distinct n-grams, sorted, and their
counts. A range adds up what all blocks sent and answers each block in its own
order, so the answer is counts alone. Blocks then hold all counts of their
tokens. A frequent n-gram is one entry for each block, and rows are never more
than distinct n-grams.

The number of ranges follows the bytes of the texts, so a range stays some
megabytes. A block finds the ranges of its own n-grams and never goes through
all ranges, so its work does not grow with the corpus; where there are more
ranges than a block has n-grams, a row is one n-gram, so rows are at most the
distinct n-grams of all blocks.

Unigrams are known by 64-bit hashes, bigrams by 47 bits, so with B distinct
bigrams a share of about B / 2^47 of them is counted together with another: one
in 14,000 at 10^10. The input must give the same rows in the same blocks when it
is scanned again, as files do; a checksum of each block's n-grams and of their
counts tells, and other rows are an error and never a wrong score.

EM sees a histogram of the tokens: context bucket, and the two probabilities
rounded to a quarter of a power of two. Its weights differ from those of
exact EM by less than 0.02 in the tests; each token is scored with its exact
counts.

Null texts are empty: one end token. Null ids train. Repeated rows count and
are scored as often as they occur. A text longer than a block is a block of its
own. Without training rows N is 0, and the model is uniform over the one unknown
word. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import _text as X
from scholion.runtime import checkpointed

END, START = X.U(0x1B873593CC9E2D51), X.U(0x85EBCA6BC2B2AE35)
#: Buckets of context counts: 0, 1, 2-3, 4-7, ...
BUCKETS = 24
#: Probabilities are rounded to bins of a quarter of a power of two, down to 2^-31.
BINS, PER_OCTAVE = 128, 4
LEAST_RANGES = 128
#: Bytes of text for each range of n-grams.
RANGE_BYTES = 12 << 20
BIGRAM_BITS = 47
LEAST_WEIGHT = 1e-4
BLOCK_BYTES = 8 << 20
#: Packed counts of at most so many bytes are not compressed, which their first byte tells.
FEW_BYTES, FEW_FLAG = 32, 16


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, each document's end among them, and their document offsets."""
    data, at = X.text_buffer(column)
    starts, ends, words_at = X.split_words(data, at, X.NONSPACE)
    h = X.hash_words(data, starts, ends)
    to = words_at + np.arange(len(words_at))
    out = np.empty(to[-1], np.uint64)
    last = np.zeros(len(out), bool)
    last[to[1:] - 1] = True
    out[last], out[~last] = END, h
    return out, to


def bigrams_of(tokens: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before; a document's first comes after START."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[to[:-1]] = START
    return X.mix(before * X.U(0x9E3779B97F4A7C15) + tokens * X.U(0xD6E8FEB86659FD93)) >> X.U(64 - BIGRAM_BITS)


class Block:
    """Tokens, bigrams, and the distinct ones in order, of a block of documents."""

    def __init__(self, column: pa.Array, held_out: np.ndarray) -> None:
        self.tokens, self.to = tokens_of(column)
        self.trains = np.repeat(~held_out, np.diff(self.to))
        self.n_train_docs = int((~held_out).sum())
        self.unigrams, self.unigram_of = np.unique(np.append(self.tokens, START), return_inverse=True)
        self.bigrams, self.bigram_of = np.unique(bigrams_of(self.tokens, self.to), return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        one = np.bincount(self.unigram_of[:-1][self.trains], minlength=len(self.unigrams))
        one[self.unigram_of[-1]] = self.n_train_docs
        return one, np.bincount(self.bigram_of[self.trains], minlength=len(self.bigrams))

    def checksum(self) -> int:
        """Equal for two blocks with the same n-grams and training counts."""
        return sum(_checksum(k, c) for k, c in zip((self.unigrams, self.bigrams), self.counts(), strict=True)) % (1 << 64)


def _checksum(keys: np.ndarray, counts: np.ndarray) -> int:
    """A sum over the n-grams, so that parts of a block add up to the block's."""
    return int((X.mix(keys.astype(np.uint64) + X.U(1)) * (2 * counts.astype(np.uint64) + X.U(1))).sum(dtype=np.uint64))


def _floor(r: int, ranges: int, bits: int) -> int:
    """The least key of range r."""
    return -((-r << bits) // ranges)


def _ranges_of(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """The range, floor(key * ranges / 2^bits), of each key, for up to 2^32 ranges."""
    k = keys.astype(np.uint64) << X.U(64 - bits)
    high, low = k >> X.U(32), k & X.U(0xFFFFFFFF)
    return ((high * X.U(ranges) + ((low * X.U(ranges)) >> X.U(32))) >> X.U(32)).astype(np.int64)


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """Range, begin and end of the runs of sorted keys: work follows the keys, however many ranges there are."""
    of = _ranges_of(keys, ranges, bits)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=len(of) > 0)


def _pack(counts: np.ndarray) -> bytes:
    """Counts in 32 bits, or in 64 if one of them needs more; a few as they are, others compressed."""
    wide = len(counts) > 0 and int(counts.max()) >= 1 << 32
    plain = counts.astype("<u8" if wide else "<u4").tobytes()
    few = len(plain) <= FEW_BYTES
    return bytes([(8 if wide else 4) + (FEW_FLAG if few else 0)]) + (plain if few else zstandard.compress(plain, 1))


def _unpack(blob: bytes) -> np.ndarray:
    data = memoryview(blob)[1:]
    return np.frombuffer(data if blob[0] & FEW_FLAG else zstandard.decompress(data), "<u8" if blob[0] & 8 else "<u4").astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    task = TaskContext.get()
    part, k = (task.partitionId() if task else 0), 0
    for batch in batches:
        for a, b in X.blocks(batch.column(1), BLOCK_BYTES):
            yield (part << 24) + k, batch.slice(a, b - a)
            k += 1


def _send(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _blocks(batches):
            block = Block(rows.column(1), rows.column(2).to_numpy(zero_copy_only=False))
            one, two = block.counts()
            ids, keys, counts = [], [], []
            for r, a, b in _cuts(block.unigrams, ranges, 64):
                ids.append(r)
                keys.append(block.unigrams[a:b].tobytes())
                counts.append(_pack(one[a:b]))
            for r, a, b in _cuts(block.bigrams, ranges, BIGRAM_BITS):
                rest = block.bigrams[a:b] - X.U(_floor(r, ranges, BIGRAM_BITS))
                ids.append(ranges + r)
                keys.append(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                counts.append(_pack(two[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([number] * len(ids), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["r", "block", "keys", "counts"])

    return run


def _answer(ranges: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        r = rows.column("r")[0].as_py()
        keys = []
        for blob in rows.column("keys").to_pylist():
            if r < ranges:
                keys.append(np.frombuffer(blob, np.uint64))
            else:
                wide = np.zeros((len(blob) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
                keys.append(wide.reshape(-1).view("<u8"))
        sizes = [len(k) for k in keys]
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        sent = [_unpack(c) for c in rows.column("counts").to_pylist()]
        low = X.U(0 if r < ranges else _floor(r - ranges, ranges, BIGRAM_BITS))
        checks = [_checksum(k + low, c) for k, c in zip(keys, sent, strict=True)]
        total = np.bincount(which, weights=np.concatenate(sent), minlength=len(every)).astype(np.int64)  # exact below 2^53
        blocks, answers = rows.column("block").to_pylist(), []
        for part in np.split(which, np.cumsum(sizes)[:-1]):
            answers.append(_pack(total[part]))
        types = n = 0
        if r < ranges:
            words = total[every != START]
            types, n = int((words > 0).sum()), int(words.sum())
        return pa.table({"r": pa.array([r] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()), "answer": pa.array(answers, pa.binary()), "check": pa.array(np.array(checks, np.uint64).view(np.int64)), "types": pa.array([types, *[0] * (len(blocks) - 1)], pa.int64()), "n": pa.array([n, *[0] * (len(blocks) - 1)], pa.int64())})

    return run


def _cells(c12: np.ndarray, c1: np.ndarray, c2: np.ndarray, n: int) -> np.ndarray:
    """Number of the histogram cell (context bucket, bigram probability, unigram probability) of each token."""
    bucket = np.minimum(np.ceil(np.log2(c1 + 1.0)).astype(np.int64), BUCKETS - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(c12 > 0, np.clip(1 - np.log2(c12 / np.maximum(c1, 1)) * PER_OCTAVE, 1, BINS - 1), 0).astype(np.int64)
        one = np.where(c2 > 0, np.clip(1 - np.log2(c2 / max(n, 1)) * PER_OCTAVE, 1, BINS - 1), 0).astype(np.int64)
    return (bucket * BINS + two) * BINS + one


def learn_weights(cells: dict[int, int], types: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket, by expectation maximisation on the histogram."""
    out = np.full((BUCKETS, 3), 1 / 3)
    key = np.array(sorted(cells), np.int64)
    count = np.array([cells[k] for k in key.tolist()], float)
    bucket, two, one = key // (BINS * BINS), key // BINS % BINS, key % BINS
    p = np.stack([np.where(two > 0, 2.0 ** (-(two - 0.5) / PER_OCTAVE), 0), np.where(one > 0, 2.0 ** (-(one - 0.5) / PER_OCTAVE), 0), np.full(len(key), 1 / (types + 1))], axis=1)
    for b in range(BUCKETS):
        own = bucket == b
        if b == 0:
            out[b] = [0, 0.5, 0.5]
        if not own.any():
            continue
        w = out[b].copy()
        for _ in range(rounds):
            share = w * p[own]
            share /= share.sum(1, keepdims=True)
            w = (share * count[own][:, None]).sum(0) / count[own].sum()
        out[b] = w
    # buckets that training never saw take the nearest one's, and nothing is impossible
    seen = [b for b in range(1, BUCKETS) if (bucket == b).any()]
    for b in range(1, BUCKETS):
        if seen and b not in seen:
            out[b] = out[min(seen, key=lambda s: abs(s - b))]
    out[:, 1:] = np.maximum(out[:, 1:], LEAST_WEIGHT)
    out[1:, 0] = np.maximum(out[1:, 0], LEAST_WEIGHT)
    return out / out.sum(1, keepdims=True)


def _meet(ranges: int, n: int, types: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Base figures and packed counts of a block's documents, and its histogram in a row without figures."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth").combine_chunks()
        held_out = rows.column("held_out").to_numpy()
        block = Block(rows.column("text").combine_chunks(), held_out)
        got = sorted(zip(answers.column("r").to_pylist(), answers.column("answer").to_pylist(), strict=True))
        empty = [np.zeros(0, np.int64)]
        one = np.concatenate([_unpack(x) for r, x in got if r < ranges] or empty)
        two = np.concatenate([_unpack(x) for r, x in got if r >= ranges] or empty)
        if len(one) != len(block.unigrams) or len(two) != len(block.bigrams) or sum(answers.column("check").to_pylist()) % (1 << 64) != block.checksum():
            raise RuntimeError("the input gave other rows when it was scanned again; checkpoint it first")
        c2 = one[block.unigram_of[:-1]]
        c12 = two[block.bigram_of]
        c1 = np.empty_like(c2)
        c1[1:] = c2[:-1]
        c1[block.to[:-1]] = one[block.unigram_of[-1]]
        base = np.log10((c2 + 1) / (n + types + 1))
        heads = block.to[:-1]
        cell = np.bincount(_cells(np.maximum(c12 - 1, 0), np.maximum(c1 - 1, 0), np.maximum(c2 - 1, 0), n - 1)[block.trains], minlength=1)
        where = np.flatnonzero(cell)
        packed = [_pack(np.concatenate([c12[a:b], c1[a:b], c2[a:b]])) for a, b in zip(block.to[:-1], block.to[1:], strict=True)]
        k = len(packed)
        return pa.table({
            "id": pa.concat_arrays([rows.column("id").combine_chunks(), pa.nulls(1, rows.column("id").type)]),
            "held_out": pa.array([*held_out.tolist(), None], pa.bool_()),
            "n_tokens": pa.array([*np.diff(block.to).tolist(), None], pa.int64()),
            "n_known": pa.array([*np.add.reduceat((c2 > 0).astype(np.int64), heads).tolist(), None], pa.int64()),
            "base_score": pa.array([*np.add.reduceat(base, heads).tolist(), None], pa.float64()),
            "counts": pa.array([*packed, _pack(np.concatenate([where, cell[where]]))], pa.binary()),
            "is_doc": pa.array([True] * k + [False]),
        })

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * BINS * BINS, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            where, n = _unpack(blob).reshape(2, -1)
            total[where] += n
    where = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], names=["cell", "n"])


def _score(weights: np.ndarray, n: int, types: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for blob in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                c12, c1, c2 = _unpack(blob).reshape(3, -1).astype(float)
                w = weights[np.minimum(np.ceil(np.log2(c1 + 1)).astype(np.int64), BUCKETS - 1)]
                p = w[:, 0] * c12 / np.maximum(c1, 1) + w[:, 1] * c2 / max(n, 1) + w[:, 2] / (types + 1)
                scores.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: F.Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    if held_out is None:
        held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-n_bytes // RANGE_BYTES))
    sent = source.mapInArrow(_send(ranges), "r int, block long, keys binary, counts binary")
    answers = checkpointed(sent.groupBy("r").applyInArrow(_answer(ranges), "r int, block long, answer binary, check long, types long, n long"))
    total = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n, types = int(total[0]), int(total[1])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in _blocks(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, k)), pa.array(np.arange(rows.num_rows))], names=["id", "text", "held_out", "block", "nth"])

    blocks = source.mapInArrow(number, f"id {id_type}, text string, held_out boolean, block long, nth long")
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, counts binary, is_doc boolean"
    # several times as many tasks as blocks, so that few blocks meet in one
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * (n_bytes // BLOCK_BYTES + 1))
    sides = (d.repartition(dealt, "block").groupBy("block") for d in (blocks, answers.select("r", "block", "answer", "check")))
    met = checkpointed(next(sides).cogroup(next(sides)).applyInArrow(_meet(ranges, n, types), schema))
    cells = met.where("NOT is_doc").select("counts").mapInArrow(_histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # BUCKETS * BINS * BINS rows at most
    weights = learn_weights({r["cell"]: r["n"] for r in cells}, types)
    scored = met.where("is_doc").select("id", "held_out", "n_tokens", "n_known", "base_score", "counts").mapInArrow(_score(weights, n, types), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
