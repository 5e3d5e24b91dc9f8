"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as a
vector of hashed word and style features; gated attention weights the encoded
passages, and the weighted sum is scored. Only the document's label is known in
training, so the attention learns which passages decide it. The features see
the text alone.

Training takes a bounded sample (MOST_TRAINING_DOCS labelled documents outside
the held-out fold, all passages of each) on the driver; scoring
is a map over all whole texts, with the small model broadcast.

Null and empty texts are a bag of one empty passage, so they get a score too.
Very long texts are scored whole, as a bag of many passages. Repeated rows are
judged alike; null ids are scored and never train. Labels that are null are not
used; without labels of both kinds, or of any, every score is the share of label
1, or 0.5. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import _text as X

PASSAGE = 64
HASHED = 32
MOST_TRAINING_DOCS = 6000
CUTOFF = 0.3
HIDDEN, ATTENTION = 24, 12
STYLE = 16
WIDTH = STYLE + HASHED

_UPPER, _DIGIT, _PUNCT, _SYMBOL, _STOP, _OTHER, _LINE = (np.zeros(256, dtype=bool) for _ in range(7))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_SYMBOL[[35, 36, 37, 38, 42, 60, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True
_STOP[[33, 46, 63]] = True
_OTHER[128:] = True
_LINE[10] = True


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of all passages, and n+1 passage offsets of the documents."""
    n_docs = len(at) - 1
    starts, ends, words_at = X.split_words(data, at, X.NONSPACE)
    n_words = np.diff(words_at)
    count = np.maximum(1, -(-n_words // PASSAGE))
    bags = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((bags[-1], WIDTH))
    if not len(starts):
        return out, bags
    doc = X.doc_of(words_at)
    passage = bags[doc] + (np.arange(len(starts)) - words_at[doc]) // PASSAGE
    fresh = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    own = passage[fresh]
    words = np.diff(np.concatenate([fresh, [len(starts)]])).astype(float)
    h = X.hash_words(data, starts, ends)
    # bytes of a passage: from its first word to the next passage's first word or the document's end
    low = starts[fresh]
    # every count is a difference of running totals at the bounds
    high = ends[np.concatenate([fresh[1:], [len(starts)]]) - 1]

    def tally(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return (total[high] - total[low]).astype(float)

    size = np.maximum(high - low, 1).astype(float)
    lengths = (ends - starts).astype(float)
    mean_length = np.add.reduceat(lengths, fresh) / words
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    pair = np.sort((passage.astype(np.uint64) << X.U(40)) | (h >> X.U(24)))
    distinct = np.concatenate([[True], pair[1:] != pair[:-1]])
    kinds = np.bincount((pair[distinct] >> X.U(40)).astype(np.int64), minlength=bags[-1])[own]
    last_byte = data[ends - 1]
    doubled = np.zeros(len(starts))
    long_words = np.flatnonzero(ends - starts >= 2)
    doubled[long_words] = (data[ends[long_words] - 1] == data[ends[long_words] - 2]) & ~X.ALNUM[data[ends[long_words] - 1]]
    stops = tally(_STOP)
    style = [
        np.log1p(words) / 5,
        mean_length / 10,
        tally(_UPPER) / size * 3,
        tally(_DIGIT) / size * 5,
        tally(_PUNCT) / size * 5,
        tally(_SYMBOL) / size * 10,
        tally(_OTHER) / size,
        np.log1p(tally(_LINE)),
        kinds / words,
        np.add.reduceat(same, fresh) / words,
        np.add.reduceat((~X.ALNUM[last_byte]).astype(float), fresh) / words,
        np.add.reduceat(doubled, fresh) / words * 3,
        np.add.reduceat((~X.ALNUM[data[starts]]).astype(float), fresh) / words * 3,
        stops / words,
        np.add.reduceat((lengths > 20).astype(float), fresh) / words * 5,
        np.ones(len(own)),
    ]
    out[own, :STYLE] = np.stack(style, axis=1)
    hashed = np.bincount(passage * HASHED + (h >> X.U(59)).astype(np.int64), minlength=bags[-1] * HASHED).reshape(-1, HASHED)
    out[own, STYLE:] = hashed[own] / words[:, None] * 3
    return out, bags


def _softmax_by_bag(logits: np.ndarray, bags: np.ndarray) -> np.ndarray:
    owner = X.doc_of(bags)
    top = np.maximum.reduceat(logits, bags[:-1])
    e = np.exp(logits - top[owner])
    return e / np.add.reduceat(e, bags[:-1])[owner]


class AttentionModel:
    """h = tanh(x W + b); a = softmax(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum a h + d)."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(WIDTH), np.ones(WIDTH), None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = _softmax_by_bag((v * u) @ p["w"], bags)
        m = np.add.reduceat(a[:, None] * h, bags[:-1])
        s = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "h": h, "v": v, "u": u, "a": a, "m": m, "s": s}

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bags)
        owner = X.doc_of(bags)
        ds = (f["s"] - y) * weight / len(y)
        dm = ds[:, None] * p["c"]
        da = (dm[owner] * f["h"]).sum(1)
        dlogit = f["a"] * (da - np.add.reduceat(f["a"] * da, bags[:-1])[owner])
        dg = dlogit[:, None] * p["w"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dm[owner] + dv @ p["V"].T + du @ p["U"].T
        dz = dh * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ dz, "b": dz.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ dlogit, "c": f["m"].T @ ds, "d": np.array([ds.sum()])}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, seed: int = 11) -> AttentionModel:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                sizes = bags[pick + 1] - bags[pick]
                to = np.concatenate([[0], np.cumsum(sizes)])
                rows = np.arange(to[-1]) + np.repeat(bags[pick] - to[:-1], sizes)
                grads = self.gradient(x[rows], to, y[pick], weight[pick])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (0.97**epoch) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return np.full(len(bags) - 1, self.constant) if self.constant is not None else self.forward(x, bags)["s"]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in X.blocks(batch.column(0)):
            x, bags = passages(*X.text_buffer(batch.column(0).slice(a, b - a)))
            kept = [x[s:e] for s, e in zip(bags[:-1], bags[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.float32).tobytes() for v in kept], pa.binary()), batch.column(1).slice(a, b - a)], names=["x", "label"])


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = AttentionModel()
        model.p, model.mean, model.scale, model.constant = shared.value
        for batch in batches:
            for a, b in X.blocks(batch.column(1), 2 << 20):
                x, bags = passages(*X.text_buffer(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(x, bags))], names=["doc_id", "score"])

    return run


def fold(id_col: str, n: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_of: int = 5, most_docs: int = MOST_TRAINING_DOCS) -> AttentionModel:
    """A model from at most `most_docs` labels whose fold is not 0, those with the smallest hashes of their ids.

    Where ids repeat, at most twice as many rows train, those with the smallest
    hashes of ids and texts.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .where(fold(id_col, held_out_of) != 0)
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_label")
        .limit(most_docs)
    )
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).select(F.col(text_col).alias("_text"), "_label", F.xxhash64(F.col("_id").cast("string"), text_col).alias("_h"))
    rows = rows.orderBy("_h", "_label").limit(2 * most_docs).select("_text", "_label")
    got = sorted((bytes(r[0]), r[1]) for r in rows.mapInArrow(_encode, "x binary, label double").collect())
    bag = [np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for x, _ in got]
    x = np.concatenate(bag) if bag else np.zeros((0, WIDTH))
    bags = np.concatenate([[0], np.cumsum([len(b) for b in bag])]).astype(np.int64)
    return AttentionModel().fit(x, bags, np.array([y for _, y in got]))


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.p, model.mean, model.scale, model.constant))
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_score(shared), f"doc_id {id_type}, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
