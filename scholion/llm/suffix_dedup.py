"""Removal of repeated passages with run-length indexes.

Every byte is removed that a string of `span` bytes covers which also starts
earlier: in a smaller document, or before in the same one.

1. Each text is cut into segments. A window of `span` bytes has the smallest
   hash of its `ANCHOR`-byte substrings; consecutive windows with one such hash
   are a segment. Equal windows have equal hashes wherever they stand, so all
   windows that may match are in segments of one hash.
2. Segments of equal content are brought together by (hash, content): all but
   the first place are repeats as a whole. Each task keeps one place for each
   content it has seen, so copies are settled before the shuffle.
3. Segments that share a hash but differ, or that hold their hash twice, need
   their bytes. They are sorted into shards of whole hashes. A shard is
   indexed: suffixes are sorted, the Burrows-Wheeler transform is run-length
   encoded, and positions are sampled at run heads with the position and the
   match length of the suffix above. Streaming over the text, the last sample
   gives each position its match and length; chains of matches of at least
   `span` bytes are followed to their earliest place, and all others are marked.

The index never leaves its shard, and no document or group is gathered: a
hash's distinct contents are the largest unit, and where they exceed
MOST_SEGMENTS or MOST_BYTES they are split by the hash of each window instead.

Null texts are empty; texts shorter than `span` keep everything. Ids may be
null or repeated: rows are ordered by id, nulls first, then by content, and
equal rows one after another. Windows never cross rows. An empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm import _text as X
from scholion.llm._suffix import suffix_ranks
from scholion.runtime import checkpointed

SPAN = 100
ANCHOR = 32
SHARD_BYTES = 1 << 20
#: A hash with more distinct segments than this is split by window.
MOST_SEGMENTS = 4000
#: Bytes of the segments of one hash that are indexed together; an index takes some hundred bytes a byte.
MOST_BYTES = 4 << 20
#: A segment has at most so many windows; a longer run of windows with one hash is several segments.
MOST_WINDOWS = 1 << 15
SEPARATOR = 0

_MULTIPLIERS = [X.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ANCHOR bytes at each place."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)).copy()
    words ^= words >> X.U(29)
    words *= X.U(0xBF58476D1CE4E5B9)
    words ^= words >> X.U(32)
    h = words[:n] * _MULTIPLIERS[0]
    for j in range(1, ANCHOR // 8):
        h += words[8 * j : 8 * j + n] * _MULTIPLIERS[j]
    h ^= h >> X.U(31)
    h *= X.U(0x94D049BB133111EB)
    h ^= h >> X.U(30)
    return h


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    rows = -(-len(h) // w)
    padded = np.full(rows * w, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    blocks = padded.reshape(rows, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(data: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """hash, first byte, last byte (excluded), document, and whether the hash occurs twice, of every segment."""
    w = span - ANCHOR + 1
    h = anchor_hashes(data)
    least = sliding_least(h, w)
    sizes = np.diff(at)
    none = np.zeros(0, np.int64)
    docs = np.flatnonzero(sizes >= span)
    if not len(docs):
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool)
    fresh = np.zeros(len(least) + 1, bool)
    fresh[0] = True
    fresh[1:-1] = least[1:] != least[:-1]
    fresh[at[docs]] = True
    stop = at[docs + 1] - span + 1  # the first place at which no window starts
    fresh[stop] = True
    starts = np.flatnonzero(fresh)
    starts, nexts = starts[:-1] if starts[-1] == len(least) else starts, np.append(starts[1:], len(least))
    nexts = nexts[: len(starts)]
    k = np.searchsorted(at, starts, side="right") - 1
    good = (starts < at[k + 1] - span + 1) & (sizes[k] >= span)
    starts, nexts, k = starts[good], nexts[good], k[good]
    value = least[starts]
    # a periodic text is one segment, which is dealt in parts that share no window
    parts = -(-(nexts - starts) // MOST_WINDOWS)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, nexts = np.repeat(starts, parts) + nth * MOST_WINDOWS, np.repeat(nexts, parts)
        nexts = np.minimum(nexts, starts + MOST_WINDOWS)
        k, value = np.repeat(k, parts), np.repeat(value, parts)
    # the hash stands twice among a segment's anchors if it does so at two of the places where it is the least
    places = np.flatnonzero(np.concatenate([h[: len(least)] == least, np.zeros(len(h) - len(least), bool)]) | np.concatenate([np.zeros(len(h) - len(least), bool), h[w - 1 :] == least]))
    low, high = np.searchsorted(places, starts), np.searchsorted(places, nexts - 1 + w)
    twice = np.zeros(len(starts), bool)
    several = np.flatnonzero(high - low > 1)
    if len(several):
        count = (high - low)[several]
        rows = np.repeat(low[several] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        same = h[places[rows]] == np.repeat(value[several], count)
        twice[several] = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(count)[:-1]])) > 1
    return value, starts, nexts - 1 + span, k, twice


class RunLengthIndex:
    """A run-length Burrows-Wheeler transform with samples at run heads.

    `heads` are the sampled text positions, in order; `above` is the position
    of the suffix that stands before the sampled one, and `match` how many
    symbols they share. Inside a run the suffix above moves along with the
    text, so the last sample before a position gives its match, too.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray) -> None:
        rank = suffix_ranks(text)
        n = len(text)
        places = np.empty(n, np.int64)
        places[rank] = np.arange(n)
        bwt = text[places - 1]
        head = np.ones(n, bool)
        # separators differ from each other, so each is a run of its own
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == SEPARATOR)
        rows = np.flatnonzero(head)
        self.runs = len(rows)
        order = np.argsort(places[rows])
        self.heads = places[rows][order]
        self.above = places[rows - 1][order]
        self.above[self.heads == places[0]] = -1
        self.match = self._shared(text, ends)

    def _shared(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols that each sampled suffix shares with the one above, up to a separator."""
        a, b = self.heads, self.above
        room = np.where(b < 0, 0, np.minimum(ends[a] - a, ends[np.maximum(b, 0)] - b))
        out = np.zeros(len(a), np.int64)
        raw = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
        words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        live = np.flatnonzero(room > 0)
        while len(live):
            x, y = words[a[live] + out[live]], words[b[live] + out[live]]
            differ = x ^ y
            same = differ == 0
            # bytes before the first that differs
            low = differ & (~differ + X.U(1))
            equal = np.where(same, 8, np.floor(np.log2(np.maximum(low, X.U(1)).astype(np.float64))).astype(np.int64) // 8)
            out[live] = np.minimum(out[live] + equal, room[live])
            live = live[same & (out[live] < room[live])]
        return out

    def stream(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The position above and the match length of every text position."""
        at = np.arange(n)
        mark = np.zeros(n, np.int64)
        mark[self.heads] = 1
        k = np.cumsum(mark) - 1
        gone = at - self.heads[np.maximum(k, 0)]
        match = np.where(k >= 0, self.match[np.maximum(k, 0)] - gone, 0)
        return np.where(match > 0, self.above[np.maximum(k, 0)] + gone, -1), np.maximum(match, 0)


def repeated_starts(pieces: list[bytes], place: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the windows of which an equal one has a smaller place.

    `place` holds for each piece an ordered number; windows are compared by
    the piece's number plus their offset.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(at[-1], np.int64)
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    text[:] = joined
    text += 1
    text[at[1:] - 1] = SEPARATOR
    ends = np.repeat(at[1:] - 1, sizes + 1)
    index = RunLengthIndex(text, ends)
    above, match = index.stream(len(text))
    linked = match >= span
    held = ends - np.arange(len(text)) >= span
    key = np.repeat(place - at[:-1], sizes + 1) + np.arange(len(text))
    # pointer jumping: each position finds the top of its chain of matches
    up = np.where(linked, above, np.arange(len(text)))
    live = np.flatnonzero(linked)
    while len(live):
        nxt = up[up[live]]
        moved = nxt != up[live]
        up[live] = nxt
        live = live[moved]
    rows = np.flatnonzero(held)
    root = up[rows]
    best = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(best, root, key[rows])
    late = rows[key[rows] > best[root]]
    piece = np.searchsorted(at, late, side="right") - 1
    return piece, late - at[piece]


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals, with those that overlap or touch made one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    fresh = np.concatenate([[True], first[1:] > last[:-1]])
    return first[fresh], last[np.concatenate([fresh[1:], [True]])]


def _cut(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of the texts; of equal ones among a few documents all but the first have `again`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in X.blocks(batch.column(1), 1 << 21):
                data, at = X.text_buffer(batch.column(1).slice(a, b - a))
                value, first, last, doc, twice = segments(data, at, span)
                raw = memoryview(np.ascontiguousarray(data))
                digest = xxhash.xxh3_64_intdigest
                content = np.array([digest(raw[s:e]) for s, e in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                place = batch.column(0).slice(a, b - a).to_numpy()[doc]
                order = np.lexsort((first - at[doc], place, content, value))
                same = np.concatenate([[False], (value[order][1:] == value[order][:-1]) & (content[order][1:] == content[order][:-1])]) if len(order) else np.zeros(0, bool)
                again = np.zeros(len(order), bool)
                again[order] = same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(content.view(np.int64)), pa.array(place), pa.array((first - at[doc]).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(twice & ~again), pa.array(again)],
                    names=["h", "content", "place", "start", "n", "twice", "again"],
                )

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, content, place, start): the repeats, and the first places of contested hashes.

    A hash is contested if it has several contents, or if it stands twice in
    one. The last hash of a batch waits for the next batch; its contents are
    what is held in memory, not their copies.
    """
    names = ["h", "content", "place", "start", "n", "twice", "again"]

    def judge(rows: dict[str, np.ndarray], final: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
        h, content, again = rows["h"], rows["content"], rows["again"]
        size = len(h)
        fresh_h = np.concatenate([[True], h[1:] != h[:-1]])
        fresh = (fresh_h | np.concatenate([[True], content[1:] != content[:-1]])) & ~again
        # an `again` row is a repeat whatever stands before it
        firsts = np.flatnonzero(fresh)
        group = np.cumsum(fresh_h) - 1
        contents = np.bincount(group[firsts], minlength=group[-1] + 1)
        twice = np.bincount(group, weights=rows["twice"], minlength=group[-1] + 1) > 0
        contested = ((contents > 1) | twice)[group] & fresh
        done = np.ones(size, bool) if final else group < group[-1]
        held = ~done & fresh
        out = np.flatnonzero(~fresh | (contested & done))
        kind = contested[out].astype(np.int8)
        batch = pa.RecordBatch.from_arrays([pa.array(rows["place"][out]), pa.array(rows["start"][out]), pa.array(rows["n"][out]), pa.array(h[out]), pa.array(kind)], names=["place", "start", "n", "h", "kind"])
        return batch, {k: v[held] for k, v in rows.items()}

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in names}
        if rest is not None:
            rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
        out, rest = judge(rows, False)
        if out.num_rows:
            yield out
    if rest is not None and len(rest["h"]):
        out, _ = judge(rest, True)
        yield out


def _bytes_of(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bytes of contested segments; windows instead, where their hash has very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, content, place, start, piece = [], [], [], [], []
            for key, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = memoryview(text.as_buffer())
                for s in own:
                    if not s["hot"]:
                        h.append(s["h"])
                        content.append(0)
                        place.append(key)
                        start.append(s["start"])
                        piece.append(bytes(raw[s["start"] : s["start"] + s["n"]]))
                        continue
                    for k in range(s["start"], s["start"] + s["n"] - span + 1):
                        x = xxhash.xxh3_128_intdigest(raw[k : k + span])
                        h.append((x >> 64) - (1 << 63))
                        content.append((x & ((1 << 64) - 1)) - (1 << 63))
                        place.append(key)
                        start.append(k)
                        piece.append(None)
                if len(h) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(content, pa.int64()), pa.array(place, pa.int64()), pa.array(start, pa.int32()), pa.array(piece, pa.binary())], names=["h", "content", "place", "start", "piece"])
                    h, content, place, start, piece = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(content, pa.int64()), pa.array(place, pa.int64()), pa.array(start, pa.int32()), pa.array(piece, pa.binary())], names=["h", "content", "place", "start", "piece"])

    return run


def _resolve(span: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeated intervals of contested segments, from shards of whole hashes sorted by hash and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        keys: list[tuple[int, int]] = []
        size, last, before = 0, None, None

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(pieces)), key=keys.__getitem__)
            # documents far enough apart that a place is one number, and places inside one keep their distances
            document = np.array([keys[k][0] for k in order], np.int64)
            offset = np.array([keys[k][1] for k in order], np.int64)
            _, number = np.unique(document, return_inverse=True)
            longest = int(offset.max()) + max(len(p) for p in pieces) + 1
            piece, late = repeated_starts([pieces[k] for k in order], number * longest + offset, span)
            where = document[piece] if len(piece) else np.zeros(0, np.int64)
            at = offset[piece] + late if len(piece) else np.zeros(0, np.int64)
            by = np.lexsort((at, where))
            where, at = where[by], at[by]
            fresh = np.concatenate([[True], (where[1:] != where[:-1]) | (at[1:] > at[:-1] + span)]) if len(at) else np.zeros(0, bool)
            close = np.concatenate([fresh[1:], [True]]) if len(at) else fresh
            return pa.RecordBatch.from_arrays([pa.array(where[fresh]), pa.array(at[fresh].astype(np.int32)), pa.array((at[close] + span - at[fresh]).astype(np.int32))], names=["place", "start", "n"])

        for batch in batches:
            windows: list[tuple[int, int]] = []
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "content", "place", "start", "piece")), strict=True)
            for h, content, place, start, piece in rows:
                if piece is None:
                    if before == (h, content):
                        windows.append((place, start))
                    before = (h, content)
                    continue
                if size >= shard_bytes and h != last:
                    yield flush()
                    pieces, keys, size = [], [], 0
                pieces.append(piece)
                keys.append((place, start))
                size += len(piece)
                last = h
            if windows:
                yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in windows], pa.int64()), pa.array([w[1] for w in windows], pa.int32()), pa.array([span] * len(windows), pa.int32())], names=["place", "start", "n"])
        if pieces:
            yield flush()

    return run


def _spans_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans of each row's list of (start, n) structs, as a flat list."""
    for batch in rows:
        out = []
        for own in batch.column(1).to_pylist():
            first = np.array([x["start"] for x in own], np.int64)
            a, b = _merged(first, first + np.array([x["n"] for x in own], np.int64))
            out.append(np.stack([a, b], axis=1).reshape(-1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["place", "spans"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`row` (a struct of all columns of `docs`) and a `place` that is unique and in the order of ids; the id itself where it will do."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct("*").alias("row"))
    own = F.col("row")[id_col]
    if kind in ("bigint", "int", "smallint", "tinyint") and docs.groupBy(id_col).count().where(f"count > 1 OR `{id_col}` IS NULL").limit(1).count() == 0:
        return rows.select("row", own.cast("long").alias("place"))
    parts = checkpointed(rows.orderBy(own.asc_nulls_first(), F.xxhash64(F.col("row")[text_col])).withColumn("m", F.monotonically_increasing_id()))
    counts = parts.groupBy(F.shiftright("m", 33).alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = parts.withColumn("part", F.shiftright("m", 33)).join(F.broadcast(base), "part")
    return numbered.select("row", (F.col("base") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("place"))


#: Spans of at most so many bytes are broadcast; beyond, the texts are shuffled to them.
MOST_BROADCAST_BYTES = 32 << 20


def repeated_spans(texts: DataFrame, span: int = SPAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """place, spans (flat list of first and last byte) of the rows of `texts` (place, text) that hold repeats."""
    cut = texts.mapInArrow(_cut(span), "h long, content long, place long, start int, n int, twice boolean, again boolean")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # repeats are settled already, so they need not meet their hash
    dealt = cut.repartition(n, F.when(F.col("again"), F.xxhash64("place", "start")).otherwise(F.col("h")))
    decided = checkpointed(dealt.sortWithinPartitions("h", "content", "place", "start").mapInArrow(_decide, "place long, start int, n int, h long, kind byte"))
    contested = decided.where("kind = 1")
    # a hot hash has over MOST_SEGMENTS rows or MOST_BYTES, so hot ones are few, and the rows of all stay where they are
    sizes = contested.groupBy("h").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"))
    hot = checkpointed(sizes.where((F.col("rows") > MOST_SEGMENTS) | (F.col("bytes") > MOST_BYTES)).select(F.col("h").alias("hot_h")))
    contested = contested.join(F.broadcast(hot) if hot.count() <= MOST_BROADCAST_BYTES // 64 else hot, F.col("h") == F.col("hot_h"), "left").select("place", F.struct("start", "n", "h", F.col("hot_h").isNotNull().alias("hot")).alias("s"))
    wanted = contested.groupBy("place").agg(F.collect_list("s").alias("segments"))  # at most the document's own
    held = texts.join(wanted, "place").select("place", "text", "segments")
    pieces = held.mapInArrow(_bytes_of(span), "h long, content long, place long, start int, piece binary")
    found = pieces.repartition(n, "h").sortWithinPartitions("h", "content", "place", "start").mapInArrow(_resolve(span, shard_bytes), "place long, start int, n int")
    spans = decided.where("kind = 0").select("place", "start", "n").union(found)
    return spans.groupBy("place").agg(F.collect_list(F.struct("start", "n")).alias("s")).mapInArrow(_spans_of, "place long, spans array<int>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs, digest = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            spans = spans or []
            sha, at = hashlib.sha256(), 0
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                sha.update(raw[at:a])
                at = b
            sha.update(raw[at:])
            size.append(len(raw))
            removed.append(sum(spans[1::2]) - sum(spans[::2]))
            runs.append(len(spans) // 2)
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """`row` (a struct of all columns of `docs`) and `spans`, null for rows without repeats."""
    numbered = _numbered(docs, id_col, text_col)
    spans = checkpointed(repeated_spans(numbered.select("place", F.col("row")[text_col].alias("text")), span))
    n_bytes = spans.agg(F.sum(16 + 4 * F.size("spans"))).first()[0] or 0
    side = F.broadcast(spans) if n_bytes <= MOST_BROADCAST_BYTES else spans
    return numbered.join(side, "place", "left").select("row", "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", span: int = SPAN) -> DataFrame:
    """The columns of `docs` with repeated bytes cut out of the text; texts of which nothing but white space is left go.

    A character of which bytes are left over is dropped. `size_col`, if there
    is one, is the length of what is left.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode() if spans else b""
                bounds = [0, *(spans or []), len(raw)]
                out.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(bounds[::2], bounds[1::2], strict=True)) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "left"])

    names = docs.columns
    found = with_spans(docs, id_col, text_col, span).select("row", F.col("row")[text_col].alias("text"), "spans")
    schema = found.select("row", F.col("text").alias("left")).schema
    d = found.mapInArrow(cut, schema).where(F.col("row")[text_col].isNull() | (F.col("left") == F.col("row")[text_col]) | (F.trim("left") != ""))
    new = {text_col: F.col("left")} | ({size_col: F.when(F.col("left") == F.col("row")[text_col], F.col("row")[size_col]).otherwise(F.char_length("left").cast("long"))} if size_col in names else {})
    return d.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "row.text", "spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute_force(texts: list[str | None], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of texts in order, for tests."""
    seen: set[bytes] = set()
    out = []
    for text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - span + 1):
            w = raw[i : i + span]
            if w in seen:
                gone[i : i + span] = True
            seen.add(w)
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out
