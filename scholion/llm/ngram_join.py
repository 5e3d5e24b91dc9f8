"""Jaccard self-join of word n-gram sets, in size-banded tiles with bitmap signatures.

A document is its set of distinct four-word shingles; two link when 100 times
the size of the intersection is at least 85 times that of the union. Linked sets
share one of their first n - ceil(0.85 n) + 1 elements in any common order, and
their sizes are in one or in neighbouring bands (a band spans the ratio 0.849).
So a set goes, for each of those elements, into the tile of the element and its
own band, and as a guest into that of the next band. Within a tile every two
sets of different classes, at least one of them at home, are tested by their
signatures: parity bitmaps of hashed elements, as wide as half a set, whose
difference in bits is at most that of the sets, so that it bounds the overlap
from above. Two sets are taken up only in the tile of the first element that
they share, and if what follows it in both leaves enough to share. What passes
is verified by intersecting the sorted sets.

Families of edited copies would fill tiles with pairs that are linked anyway. So
first every tile's members are tested against one of them, the one with the most
company, which the tiles of a family agree on; tiles in which one class is left
are done. In the others, members outside the tile's largest class meet each
other and that class, in cells of BLOCK by BLOCK members.

Elements that many unlinked sets share (a common passage) are hot: a tile with
more than MOST_OTHERS members outside its largest class. Its members are joined
once more among themselves, in an order in which the elements that more than
MOST_OTHERS of them have come last. Two sets whose shared first elements are all
hot are both among those members, so no link is lost, and the join of the other
tiles stands. An element that is still first, all others being taken before it,
is compared in full.

Scale: equal sets are one node. First elements move as 64-bit keys, those of one
set only are dropped by an aggregation; signatures move with the tiles that are
open, sets only with pairs that pass the bounds. Nothing is collected but the
hot elements' keys, at most MOST_HOT, which only decide an order.

Shingles are compared as 64-bit hashes. Fewer than four words are one shingle.
A text without words (null, empty) has none, links with nothing and is a class
of its own. Equal texts and repeated rows share a class, null ids too; a class
is named by its smallest id, null if it has none. Very long texts are taken
whole. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import _text as X
from scholion.llm.graph import components
from scholion.runtime import checkpointed, discard

SHINGLE = 4
#: Two sets link from this many hundredths on.
PERCENT = 85
#: Members outside a tile's largest class, beyond which its element is hot.
MOST_OTHERS = 4000
#: Members of a block of a tile; a cell has two.
BLOCK = 500
#: Hot elements that are broadcast to be put last.
MOST_HOT = 1 << 20
#: At most so many rows are broadcast in a join; beyond, it shuffles.
MOST_BROADCAST_ROWS = 1_000_000
#: Pairs of one node that meet in one task.
PAIRS_A_SALT = 2000
_BAND = math.log(100 / (PERCENT - 0.1))
LEAST_BITS = 256
#: Bytes of text whose words and sets a task holds at once.
TEXT_BYTES = 1 << 19
#: Earlier elements by which a pair that met before is known; pairs that share none of them are only tested again.
EARLIER = 4


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, which gives memory that it no longer uses back to the system after each batch: a worker stays when its task ends."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return released


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The least intersection with which sets of these sizes link."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def firsts(n: int) -> int:
    """How many first elements a set of n has to show."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / _BAND).astype(np.int64)


def width_of(band: np.ndarray) -> np.ndarray:
    """Bits of the signatures in a band's tiles: a power of two, from half the largest size on."""
    half = np.exp((np.asarray(band) + 1) * _BAND) / 2
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(half)).astype(np.int64))


def signature(s: np.ndarray, bits: int) -> bytes:
    """Parities of the number of elements that hash to each place."""
    return np.packbits((np.bincount((s & X.U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _sets(column: pa.Array) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The sorted set of each text and its 128-bit hash, None without words."""
    data, at = X.text_buffer(column)
    starts, ends, words_at = X.split_words(data, at, X.NONSPACE)
    s, to = X.shingles(X.hash_words(data, starts, ends), words_at, SHINGLE)
    own = [np.unique(s[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
    return own, [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in own]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in X.blocks(batch.column(1), TEXT_BYTES):
            own, content = _sets(batch.column(1).slice(a, b - a))
            n = np.array([len(x) for x in own], np.int64)
            band = band_of(n)
            bits = width_of(band + 1).tolist()
            keys = [x[: firsts(len(x))].view(np.int64) for x in own]
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(content, pa.binary()), pa.array(n), pa.array(band), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([signature(x, w) for x, w in zip(own, bits, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "raw", "content", "n", "band", "keys", "bits"])


def _set_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and sorted set of the texts that are a node's own."""
    for batch in batches:
        for a, b in X.blocks(batch.column(1), TEXT_BYTES):
            own, content = _sets(batch.column(1).slice(a, b - a))
            wanted = batch.column(2).slice(a, b - a).to_pylist()
            rows = [k for k in range(b - a) if content[k] == wanted[k]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(rows, pa.int64())), pa.array([own[k].tobytes() for k in rows], pa.binary())], names=["node", "elements"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All elements of the sets (node, elements) as keys."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]) if len(batch) else np.zeros(0, np.int64))], names=["key"])


def _late(hot: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first elements of the sets (node, elements) in the order in which hot ones come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.sort(np.frombuffer(hot.value, np.int64).view(np.uint64))
        for batch in batches:
            nodes, keys, pos = [], [], []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                keys.append(np.concatenate([s[~late], s[late]])[: firsts(len(s))].view(np.int64))
                nodes.append(np.full(len(keys[-1]), node))
                pos.append(np.arange(len(keys[-1])))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, pos, keys)], names=["node", "pos", "key"])

    return run


def _rows_of(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The values, all of `size` bytes, of some rows of a binary column as a matrix of 64-bit words."""
    taken = column.take(pa.array(rows))
    _, at, data = taken.buffers()
    offset = np.frombuffer(at, np.int32)[taken.offset]
    return np.frombuffer(data, np.uint64, len(rows) * size // 8, int(offset)).reshape(len(rows), size // 8) if len(rows) else np.zeros((0, size // 8), np.uint64)


def _folded(m: np.ndarray, words: int) -> np.ndarray:
    """Signatures of fewer bits: parities of halves add up."""
    while m.shape[1] > words:
        half = m.shape[1] // 2
        m = m[:, :half] ^ m[:, half:]
    return m


def _possible(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bit counts leave an overlap that is large enough; rows of a and b are signatures of one width."""
    apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return (na + nb - apart) // 2 >= needed(na, nb)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, na, nb, abits, bbits) that their signatures do not rule out."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        wa, wb = (np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in (batch.column(4), batch.column(5)))
        good = np.zeros(len(batch), bool)
        for x, y in set(zip(wa.tolist(), wb.tolist(), strict=True)):
            rows = np.flatnonzero((wa == x) & (wb == y))
            w = min(x, y) // 8
            good[rows] = _possible(na[rows], nb[rows], _folded(_rows_of(batch.column(4), rows, x), w), _folded(_rows_of(batch.column(5), rows, y), w))
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, sa, sb) whose sorted sets link."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(100 * shared >= PERCENT * (len(both) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes that signatures do not rule out, cell by cell.

    Rows come sorted by cell: key, band, i, part, node, root, home, other, n,
    pos (how many elements come before the key), before (the first of those that
    have tiles), bits. In a part after the first only members that differ in `other`
    meet. Members that share an element before the key meet in its tile.
    All cells of a batch are taken at once, by the distance of two members.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, band, i, part, node, root, n, pos = (t.column(c).to_numpy() for c in ("key", "band", "i", "part", "node", "root", "n", "pos"))
        before = t.column("before").combine_chunks()
        before = before.chunk(0) if isinstance(before, pa.ChunkedArray) else before
        earlier: dict[int, frozenset] = {}

        def taken(x: int) -> frozenset:
            if x not in earlier:
                earlier[x] = frozenset(before[x].as_py())
            return earlier[x]

        home, other = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "other"))
        size = width_of(band) // 8
        column = t.column("bits").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        held = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
        bits: dict[int, np.ndarray] = {}
        place = np.zeros(len(n), np.int64)
        for w in np.unique(size).tolist():
            rows = np.flatnonzero(size == w)
            bits[w] = np.concatenate([np.zeros((0, w // 8), np.uint64), *(_folded(_rows_of(column, rows[held[rows] == v], v), w // 8) for v in np.unique(held[rows]).tolist())])
            place[np.concatenate([rows[held[rows] == v] for v in np.unique(held[rows]).tolist()])] = np.arange(len(rows))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (part[1:] != part[:-1])])
        cell = np.cumsum(new)
        left, right = [], []
        for d in range(1, int(np.bincount(cell).max(initial=0))):
            x = np.flatnonzero(cell[d:] == cell[:-d])
            if not len(x):
                break
            y = x + d
            low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = (root[x] != root[y]) & (home[x] | home[y]) & ((part[x] == 0) | (other[x] != other[y])) & (100 * low >= PERCENT * high) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= needed(n[x], n[y]))
            x, y = x[ok], y[ok]
            for w in np.unique(size[x]).tolist():
                own = size[x] == w
                xs, ys = x[own], y[own]
                good = np.flatnonzero(_possible(n[xs], n[ys], bits[w][place[xs]], bits[w][place[ys]]))
                good = good[[taken(p).isdisjoint(taken(q)) for p, q in zip(xs[good].tolist(), ys[good].tolist(), strict=True)]] if len(good) else good
                left.append(np.minimum(node[xs[good]], node[ys[good]]))
                right.append(np.maximum(node[xs[good]], node[ys[good]]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        ab = np.unique(np.stack([a, b], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = [t.column(c).to_numpy() for c in ("key", "band", "i", "part")]
        same = np.logical_and.reduce([c == c[-1] for c in last]) if len(t) else np.zeros(0, bool)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pairs(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield pairs(rest)


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        kind = docs.schema[id_col].dataType.simpleString()
        self.texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("raw"))
        schema = f"id {kind}, raw bigint, content binary, n bigint, band bigint, keys array<bigint>, bits binary"
        signed = checkpointed(self.texts.mapInArrow(lean(_signed), schema))
        pick = F.struct(F.col("id").isNull().alias("no_id"), "id", "raw")
        nodes = signed.where("content IS NOT NULL").groupBy("content").agg(F.min(pick).alias("pick"), *[F.any_value(c).alias(c) for c in ("n", "band", "keys", "bits")])
        self.nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
        self.rows = checkpointed(signed.select("id", "content", "n"))
        self.repeated = not signed.where("content IS NOT NULL").groupBy("id", "raw").count().where("count > 1").isEmpty()
        discard(signed)
        self.links: list[DataFrame] = []

    def members(self, keyed: DataFrame) -> DataFrame:
        """key, band, home, node, pos, n, c: members of tiles with two at least, one at home, from node, pos, key; c is their number."""
        shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        met = keyed.join(shared, "key").join(self.nodes.select("node", "n", "band"), "node")
        tiles = F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("home"))))
        met = checkpointed(met.select("key", "node", "pos", "n", tiles.alias("x")).select("key", F.col("x.tile").alias("band"), "x.home", "node", "pos", "n"))
        filled = met.groupBy("key", "band").agg(F.count("*").alias("c"), F.max("home").alias("some")).where("c > 1 AND some").select("key", "band", "c")
        out = checkpointed(met.join(filled, ["key", "band"]))
        discard(met)
        return out

    def elements(self, wanted: DataFrame) -> DataFrame:
        """node, elements of the nodes in `wanted`, read from the texts again."""
        few = wanted.count() <= MOST_BROADCAST_ROWS
        own = self.nodes.join(wanted, "node", "left_semi").select("node", "content", F.col("pick.id").alias("own_id"), F.col("pick.raw").alias("own_raw"))
        own = F.broadcast(own) if few else own
        met = self.texts.join(own, (F.col("raw") == F.col("own_raw")) & F.col("id").eqNullSafe(F.col("own_id")))
        blobs = met.select("node", "text", "content").mapInArrow(lean(_set_blobs), "node bigint, elements binary")
        return checkpointed(blobs.dropDuplicates(["node"]) if self.repeated else blobs)

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs a, b that link, b being in many pairs maybe."""
        light = self.nodes.select("node", "n", "bits")
        a = light.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("abits"))
        b = light.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bbits"))
        met = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
        left = checkpointed(met.select("a", "b", "na", "nb", "abits", "bbits").mapInArrow(lean(_bounded), "a bigint, b bigint"))
        salts = left.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_SALT).alias("salts"))
        ends = salts.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("sb")), "b").select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        begun = left.join(salts, "b").join(sets.select(F.col("node").alias("a"), F.col("elements").alias("sa")), "a").select("a", "b", F.pmod(F.xxhash64("a"), "salts").alias("salt"), "sa")
        return checkpointed(begun.join(ends, ["b", "salt"]).select("a", "b", "sa", "sb").mapInArrow(lean(_exact), "a bigint, b bigint"))

    def found(self) -> DataFrame:
        out = self.links[0]
        for more in self.links[1:]:
            out = out.union(more)
        return out

    def hub_pairs(self, members: DataFrame) -> DataFrame:
        """Each tile's members with the one that has the most company."""
        company = members.groupBy("node").agg(F.sum("c").alias("company"))
        ranked = members.join(company, "node")
        hubs = ranked.groupBy("key", "band").agg(F.max(F.struct("company", "node")).alias("hub")).select("key", "band", F.col("hub.node").alias("b"))
        return checkpointed(members.join(hubs, ["key", "band"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct())

    def opened(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """Members of tiles with several classes: root, whether it is not the largest one (other), how many are not (others) and how many are (most)."""
        members = checkpointed(members.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
        by_class = members.groupBy("key", "band", "root").agg(F.count("*").alias("k"))
        tiles = by_class.groupBy("key", "band").agg(F.max(F.struct("k", "root")).alias("major"), F.sum("k").alias("k")).where("k > major.k")
        tiles = tiles.select("key", "band", F.col("major.root").alias("major"), (F.col("k") - F.col("major.k")).alias("others"), F.col("major.k").alias("most"))
        return checkpointed(members.join(tiles, ["key", "band"]).withColumn("other", F.expr("root <> major")))

    def tile_pairs(self, opened: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs of the tiles' members outside the largest class with all members, that signatures do not rule out.

        Members outside are blocks 0 to p - 1, the largest class those from p
        on. Block i < p meets itself in cell (i, 0) and each later block j in
        cell (i, j - i), where `other` then tells the two apart.
        """
        opened = opened.where(f"home OR {100 + PERCENT} * (n - pos) >= {2 * PERCENT} * n")  # a guest's partners are larger
        place = F.xxhash64("node", "key")
        blocks = opened.withColumns({"p": F.ceil(F.col("others") / BLOCK), "q": F.ceil(F.col("most") / BLOCK)}).withColumn("block", F.when(F.col("other"), F.pmod(place, "p")).otherwise(F.col("p") + F.pmod(place, "q")))
        cells = F.expr("""
            CASE WHEN p = 1 AND other THEN transform(sequence(0L, q - 1), k -> struct(0L AS i, k AS part, true AS side))
                 WHEN p = 1 THEN array(struct(0L AS i, block - 1 AS part, false AS side))
                 WHEN other THEN transform(sequence(0L, p + q - 1), k -> struct(least(k, block) AS i, greatest(k, block) - least(k, block) AS part, k >= block AS side))
                 ELSE transform(sequence(0L, p - 1), k -> struct(k AS i, block - k AS part, false AS side)) END""")
        own = members.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("pos", "key"))), 1, EARLIER).alias("own"))  # of a node's first elements
        held = self.nodes.select("node", "bits").join(own, "node")
        before = F.transform(F.filter("own", lambda x: x["pos"] < F.col("pos")), lambda x: x["key"])
        dealt = blocks.withColumn("cell", F.explode(cells)).join(held, "node")
        dealt = dealt.select("key", "band", "cell.i", "cell.part", "node", "root", "home", F.col("cell.side").alias("other"), "n", "pos", before.alias("before"), "bits")
        order = ["key", "band", "i", "part"]
        return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(_tiles), "a bigint, b bigint").distinct()

    def run(self) -> DataFrame:
        """content, component of the nodes, by pick."""
        members = self.members(self.nodes.select("node", F.posexplode("keys").alias("pos", "key")).withColumn("pos", F.col("pos").cast("long")))
        sets = self.elements(members.select("node").distinct())
        self.links.append(self.verified(self.hub_pairs(members), sets))
        opened = self.opened(members, components(self.found()))
        hot = opened.where(f"others > {MOST_OTHERS}").select("node").distinct()
        if hot.isEmpty():
            self.links.append(self.verified(checkpointed(self.tile_pairs(opened, members)), sets))
            return components(self.found())
        self.links.append(self.verified(checkpointed(self.tile_pairs(opened.where(f"others <= {MOST_OTHERS}"), members)), sets))
        again = checkpointed(sets.join(hot, "node", "left_semi").select("node", "elements"))
        counts = again.mapInArrow(lean(_elements), "key bigint").groupBy("key").count().where(f"count > {MOST_OTHERS}")
        last = [r[0] for r in counts.orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key").collect()]
        shared = again.sparkSession.sparkContext.broadcast(np.array(last, np.int64).tobytes())
        members = self.members(checkpointed(again.mapInArrow(lean(_late(shared)), "node bigint, pos bigint, key bigint")))
        self.links.append(self.verified(self.hub_pairs(members), sets))
        opened = self.opened(members, components(self.found()))
        self.links.append(self.verified(checkpointed(self.tile_pairs(opened, members)), sets))
        return components(self.found())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    join = _Join(docs, id_col, text_col)
    classes = join.run()
    named = join.nodes.select("node", "content", F.col("pick.id").alias("own"))
    rooted = named.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    by_content = rooted.join(least, "root").select("content", "component_id")
    out = join.rows.join(by_content, "content", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), spread AS (
  SELECT row_no, len(words) AS n_words, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM texts
), grams AS (
  SELECT row_no, n_words, pos, concat_ws(' ', w, lead(w, 1) OVER own, lead(w, 2) OVER own, lead(w, 3) OVER own) AS e FROM spread WINDOW own AS (PARTITION BY row_no ORDER BY pos)
), shingles AS (
  SELECT DISTINCT row_no, e FROM grams WHERE pos <= greatest(1, n_words - {SHINGLE - 1})
), sets AS (
  SELECT t.row_no, any_value(t.doc_id) AS doc_id, count(s.e) AS n FROM texts t LEFT JOIN shingles s ON s.row_no = t.row_no GROUP BY t.row_no
), elements AS (
  SELECT s.row_no, n, e FROM sets s JOIN shingles USING (row_no)
), pairs AS (
  SELECT x.row_no AS a, y.row_no AS b, x.n AS na, y.n AS nb, count(*) AS common FROM elements x JOIN elements y ON x.e = y.e AND x.row_no <> y.row_no GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= {PERCENT} * (na + nb - common)
), reach(a, b) AS (
  SELECT row_no, row_no FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach r ON r.a = s.row_no JOIN sets o ON o.row_no = r.b GROUP BY s.row_no, s.doc_id, s.n
"""
