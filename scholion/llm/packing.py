"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most `capacity` tokens. Pieces of one
length are interchangeable, so the packing is found on the histogram of piece
lengths: at most `capacity` counts, whatever the corpus. Each step opens a
sequence with the longest length left and finds, by subset-sum dynamic
programming on bitsets, the fullest feasible combination of the others; the
combination is removed as often as the counts allow, which uses a length up.
Pieces then take the place that belongs to their length and their rank among
pieces of that length. Ranks come from counts per task, so no length, however
frequent, is gathered in one task.

Ids are those of the vocabulary's JSON file in `tokenizers`: its added tokens,
as `<|endoftext|>`, have their own ids wherever a text holds them.

A null text is empty; an empty text is one piece of the end token alone.
Repeated rows are packed as often as they occur; other columns do not matter.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm import _text as X
from scholion.runtime import checkpointed

CAPACITY = 1024
END_ID = 2


class Encoder:
    """A byte-level BPE with the ids that the library `tokenizers` gives for the JSON file of the vocabulary.

    `added` are strings with an id of their own wherever they stand in a text,
    as `<|endoftext|>`; without them such strings are ordinary text. A text that
    the fast encoder's pattern gives up on (runs of about a million blanks) is
    left to `tokenizers` itself, which reads `json_path`.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int], json_path: str | None = None) -> None:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added, self.json_path, self.slow = set(added), json_path, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=self.added, disallowed_special=())
        except ValueError:
            if self.json_path is None:
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a vocabulary's JSON file."""
    with open(json_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    import public_tokenizers

    json_path = public_tokenizers.path(f"{name}.json")
    return Encoder(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, added_tokens(json_path), json_path)


def _tokenise(encoder: Callable, capacity: int, end_id: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b in X.blocks(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(a, b - a)
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, text in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                    tokens = np.append(encode(text or "").astype("<u4"), np.uint32(end_id)).astype("<u4")
                    first = len(tokens) % capacity or capacity
                    at = [0, *range(first, len(tokens) + 1, capacity)]
                    for j, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        owner.append(k)
                        piece.append(j)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(tokens[s:e].tobytes()))
                        if keep_ids:
                            kept.append(tokens[s:e].astype(np.int32))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
                nth = np.arange(len(size)) - np.maximum.accumulate(np.where(fresh, np.arange(len(size)), 0))
                local = np.empty(len(size), np.int64)
                local[order] = nth + seen[ordered]
                seen += np.bincount(size, minlength=capacity + 1)
                columns = [ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part)), pa.array(local)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often to take them, so that their sum is the largest that is at most `room`."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        most = min(counts[length], room // length)
        steps.append((length, most, reach))
        left, chunk = most, 1
        while left:
            take = min(chunk, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        take = next(j for j in range(most + 1) if target >= j * length and before >> (target - j * length) & 1)
        if take:
            out[length] = take
            target -= take * length
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """(first sequence, sequences, length -> pieces a sequence) of every step."""
    left = {k: v for k, v in counts.items() if v}
    steps, at = [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // v for k, v in chosen.items())
        steps.append((at, times, chosen))
        at += times
        for k, v in chosen.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return steps


def _places(steps: list[tuple[int, int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces a sequence, offset)."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    for at, times, chosen in steps:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            out.setdefault(length, []).append((used.get(length, 0), at, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _assign(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                rows = places[size]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * size
            kept = [k for k, name in enumerate(names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence), pa.array(offset)], names=[*(names[k] for k in kept), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder: Callable = public_encoder, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    `encoder` makes a function from text to ids on each executor. With
    `keep_ids` the pieces' ids come along, from which `sequences` makes the
    token sequences.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part long, local long" + ", ids array<int>" * keep_ids
    pieces = checkpointed(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_tokenise(encoder, capacity, end_id, keep_ids), schema))
    counts = checkpointed(pieces.groupBy("length", "part").agg(F.max("local").alias("n")).withColumn("n", F.col("n") + 1))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # `capacity` rows at most
    places = _places(plan({r["length"]: r["n"] for r in totals}, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local")).drop("part", "local", "base")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    out = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_assign(spark.sparkContext.broadcast(places)), out)


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences of pieces that kept their ids: sequence_id, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
