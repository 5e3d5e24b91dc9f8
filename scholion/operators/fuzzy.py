"""The best fuzzy match of each name, by Jaro-Winkler similarity over a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import KERNEL_CELLS, jaro_winkler_codes
from scholion.runtime import checkpointed

#: Similarities are compared to so many digits.
DIGITS = 6
#: Slack of bounds for rounding.
SLACK = 1e-9
HEAD = 4
PREFIX_SCALE = 0.1
#: Names of a side of a block that meet in one task.
CELL_NAMES = 20_000
#: Bounds that a task holds at once, and pairs of names that it compares at once.
BOUNDS, PAIRS = 1 << 21, 1 << 16
#: Characters, by occurrence, that are counted at once.
TOKENS = 1024


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10**DIGITS + 0.5) / 10**DIGITS


class _Names:
    """Distinct names as code points, those of the same characters and head side by side: they are one class, as no bound can tell them apart."""

    def __init__(self, names: list[str]) -> None:
        names = sorted(names)
        codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32) for x in names]
        ordered = [np.sort(c) for c in codes]
        kinds: dict[tuple, int] = {}
        kind = np.array([kinds.setdefault((c.tobytes(), x[:HEAD]), len(kinds)) for c, x in zip(ordered, names, strict=True)])
        self.rank = np.argsort(kind, kind="stable")  # a name's place among the sorted ones
        self.names = [names[k] for k in self.rank.tolist()]
        self.count = np.bincount(kind)
        self.first = np.cumsum(self.count) - self.count
        self.length = np.array([len(x) for x in self.names])
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([*(codes[k] for k in self.rank.tolist()), np.zeros(1, np.int32)])
        self.ordered = [ordered[k] for k in self.rank[self.first].tolist()]  # of a class

    def codes(self, rows: np.ndarray, width: int, blank: int) -> np.ndarray:
        place = np.arange(width)
        return np.where(place < self.length[rows][:, None], self.flat[np.minimum(self.at[rows][:, None] + place, len(self.flat) - 1)], blank)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """The class and the token, a character with its occurrence in the name, of each character of the classes."""
        n = np.array([len(x) for x in self.ordered])
        kind, code = np.repeat(np.arange(len(n)), n), np.concatenate(self.ordered).astype(np.int64)
        new = np.ones(len(code), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (code[1:] != code[:-1])
        starts = np.flatnonzero(new)
        return kind, (code << 32) + np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))


def _overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], na: int, nb: int) -> np.ndarray:
    """The most matches of names of two classes: how many tokens they share."""
    out = np.zeros((na, nb), np.float32)
    shared = np.intersect1d(a[1], b[1])
    for k in range(0, len(shared), TOKENS):
        part = shared[k : k + TOKENS]
        x, y = np.zeros((na, len(part)), np.float32), np.zeros((nb, len(part)), np.float32)
        for m, (kind, token) in ((x, a), (y, b)):
            own = np.searchsorted(part, token)
            good = part[np.minimum(own, len(part) - 1)] == token
            m[kind[good], own[good]] = 1
        out += x @ y.T
    return out


def _bounds(common: np.ndarray, la: np.ndarray, lb: np.ndarray, a_head: np.ndarray, b_head: np.ndarray) -> np.ndarray:
    """The largest similarity, as it is rounded, that names of two classes can have, from their overlap and heads."""
    la, lb = la[:, None], lb[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / la + common / lb + 1) / 3, 0.0)
    jaro[(la == 0) & (lb == 0)] = 1.0
    same, run = np.zeros(common.shape, np.int8), np.ones(common.shape, bool)
    for k in range(HEAD):
        run &= a_head[:, k][:, None] == b_head[:, k][None, :]
        same += run
    return rounded(np.where(jaro > 0.7, jaro + same * PREFIX_SCALE * (1 - jaro), jaro) + SLACK)


def best_of(left: list[str], right: list[str], least: float) -> tuple[list[str], list[str | None], np.ndarray, np.ndarray]:
    """The left names, the most similar right name of each, the similarity, and with how many it was compared; lists of distinct names, not empty.

    Classes are bounded first, all with all. A name is compared with the class of
    the largest bound, then with those of ever smaller ones, as long as a bound
    reaches the largest similarity that it has found.
    """
    a, b = _Names(left), _Names(right)
    best, chosen, tried = np.full(len(a.names), least), np.full(len(a.names), -1), np.zeros(len(a.names), np.int64)
    place = np.full(len(a.names), len(b.names))  # of the chosen name
    kinds, tokens = a.tokens()
    of_b, b_head, b_length = b.tokens(), b.codes(b.first, HEAD, -2), b.length[b.first]

    def compared(l: np.ndarray, r: np.ndarray) -> None:
        longest = np.maximum(a.length[l], b.length[r])
        order = np.argsort(longest, kind="stable")
        l, r, longest = l[order], r[order], longest[order]
        s = np.zeros(len(l))
        k = 0
        while k < len(l):
            width = max(HEAD, int(longest[min(len(l), k + PAIRS // 8) - 1]))
            own = slice(k, k + min(PAIRS // 8, max(1, KERNEL_CELLS // width)))
            s[own] = jaro_winkler_codes(a.codes(l[own], width, -1), b.codes(r[own], width, -2), a.length[l[own]], b.length[r[own]])
            k = own.stop
        s = rounded(s)
        order = np.lexsort((b.rank[r], -s, l))
        first = order[np.diff(l[order], prepend=-1) != 0]
        l_, r_, s_ = l[first], r[first], s[first]
        good = (s_ > best[l_]) | ((s_ == best[l_]) & (b.rank[r_] < place[l_]))
        best[l_[good]], chosen[l_[good]], place[l_[good]] = s_[good], r_[good], b.rank[r_[good]]
        np.add.at(tried, l, 1)

    step = max(1, BOUNDS // len(b.count))
    for start in range(0, len(a.count), step):
        own = np.arange(start, min(start + step, len(a.count)))
        taken = slice(*np.searchsorted(kinds, [start, own[-1] + 1]))
        common = _overlaps((kinds[taken] - start, tokens[taken]), of_b, len(own), len(b.count))
        bound = _bounds(common, a.length[a.first[own]], b_length, a.codes(a.first[own], HEAD, -1), b_head)
        top, above, below = bound.max(1), np.full(len(own), np.inf), 0.0
        while True:
            floor = np.minimum.reduceat(best[: a.first[own[-1]] + a.count[own[-1]]], a.first[own])
            low = np.maximum(top - below, floor)
            x, y = np.nonzero((bound >= low[:, None]) & (bound < above[:, None]))
            order = np.argsort(-bound[x, y], kind="stable")
            x, y = x[order], y[order]
            ends = np.cumsum(a.count[own[x]] * b.count[y])
            for k in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                flat = np.arange(k, min(k + PAIRS, int(ends[-1])))
                pair = np.searchsorted(ends, flat, "right")
                within = flat - (ends - a.count[own[x]] * b.count[y])[pair]
                l, r = a.first[own[x[pair]]] + within // b.count[y[pair]], b.first[y[pair]] + within % b.count[y[pair]]
                most = bound[x[pair], y[pair]]
                can = (most > best[l]) | ((most == best[l]) & (b.rank[r] < place[l]))
                if can.any():
                    compared(l[can], r[can])
            if (top - below <= floor).all():
                break
            above, below = np.minimum(above, low), 2 * below or 0.01
    return a.names, [b.names[k] if k >= 0 else None for k in chosen.tolist()], best, tried


def _cells(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cell, name, match, similarity and tried of the left names of each cell, from rows cell, left, name in order of cell."""

    def of(cell: str, t: pa.Table) -> pa.RecordBatch:
        left = t.column("left").to_numpy()
        names = t.column("name").to_pylist()
        sides = [[x for x, own in zip(names, left.tolist(), strict=True) if own == side] for side in (True, False)]
        found = best_of(*sides, least) if all(sides) else ([], [], np.zeros(0), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([cell] * len(found[0]), pa.int64()), pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2]), pa.array(found[3])], names=["cell", "name", "match", "similarity", "tried"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[0].column(0)[0] != batch.column(0)[a]:
                    yield of(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield of(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))

    return run


def names_of(df: DataFrame, block: str, name: str) -> DataFrame:
    """block and name of the distinct names; null blocks and names meet nothing."""
    return df.select(F.col(block).alias("block"), F.col(name).alias("name")).where("block IS NOT NULL AND name IS NOT NULL").distinct()


def best_matches(left: DataFrame, right: DataFrame, block: str, name: str, least: float, compared: list[int] | None = None) -> DataFrame:
    """block, name, match, similarity: for each distinct left name the most similar right name of its block, the smallest of ties.

    `block` and `name` are columns of both sides. The names of a block are dealt
    to cells of some CELL_NAMES of either side, so that all left ones meet all
    right ones (`best_of`), and the best of a name's cells is its match. The
    result is that of comparing all pairs; similarities are rounded to six
    digits first, as ties are. Equal names are compared once. `compared` gets the
    number of pairs of names that are compared.
    """
    names = [checkpointed(names_of(d, block, name)) for d in (left, right)]
    p, q = (d.groupBy("block").agg(F.ceil(F.count("*") / CELL_NAMES).alias(x)) for d, x in zip(names, "pq", strict=True))
    blocks = checkpointed(p.join(q, "block"))
    cells = checkpointed(blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") * F.col("q") - 1)).alias("k")).select("block", "k", F.monotonically_increasing_id().alias("cell")))

    def dealt(d: DataFrame, own: str, other: str, is_left: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("name"), own)
        all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        k = mine * F.col("q") + F.col("o") if is_left else F.col("o") * F.col("q") + mine
        return d.join(blocks, "block").select("*", all_.alias("o")).select("block", k.alias("k"), F.lit(is_left).alias("left"), "name")

    rows = dealt(names[0], "p", "q", True).unionByName(dealt(names[1], "q", "p", False)).join(cells, ["block", "k"]).select("cell", "left", "name")
    n = cells.count()
    parts = max(1, min(n, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 8)))
    met = rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_cells(least), "cell bigint, name string, match string, similarity double, tried bigint")
    if compared is not None:
        met = checkpointed(met)
        compared.append(met.agg(F.coalesce(F.sum("tried"), F.lit(0))).first()[0])
    # the largest similarity, then the smallest name
    placed = met.where("match IS NOT NULL").join(cells, "cell")
    found = placed.groupBy("block", "name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("_m"))
    return found.select(F.col("block").alias(block), F.col("name").alias(name), F.col("_m.match").alias("match"), (-F.col("_m.s")).alias("similarity"))
