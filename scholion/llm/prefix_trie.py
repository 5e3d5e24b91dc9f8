"""The trie of conversations' prefixes, from each conversation's first owned depth.

Every conversation c is rebuilt: the first h original turns of conversation
c - c % 5, then its own turns after its first h, with h = crc32(decimal c) % 9.
A node of depth d is a distinct sequence of d rebuilt turns. It is named by its
smallest member, the conversation that owns it. What a conversation owns is a
chain that begins at some depth and goes to its end, as the members of a longer
prefix are among those of a shorter one. So the depth where it begins is found
by binary search: each round looks up one prefix digest of every open
conversation and the minimum over all conversations of that digest, both by
joins with tables bucketed by their keys. Chains hang on the chain that owns the
node above their first. Sums over whole chains and what hangs on them go up the
tree of chains by doubling (a round doubles the levels summed), sums over parts
of chains come from running totals along them.

A prefix digest is the running exclusive-or of two 64-bit hashes of (place,
role, text), so it is built over ranges of places: no conversation is ever in
one task, whatever its length. Ends of a node are sorted by ranges, packed into
chunks of text, and hashed chunk after chunk as SHA-256 has to be.

Scale: turns move once by range with their texts, from then on as hashes and
lengths. A round of the search moves the probes of open conversations only.
Rounds are logarithms of the longest conversation and of the deepest nesting.

Null roles and texts are empty. Rows without conv_id are no conversation and are
left out. Turns of a conversation are ordered by turn, null first, then role,
then text, so repeated turns and rows each count. Very long texts are hashed
whole. An empty table has no node, not even a root. Negative ids take the
remainder towards zero. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.runtime import bucketed, checkpointed, discard, drop_bucketed

#: Consecutive ids share the beginning of one conversation.
FAMILY = 5
#: Shared turns are fewer than this.
MOST_SHARED = 9
CHUNK_BYTES = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in ranges of `order`, with its part and its place, written once."""
    placed = df.repartitionByRange(_parts(df.sparkSession), *order).sortWithinPartitions(*order)
    return placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})


def _running(df: DataFrame, key: str, order: Column, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """df with running aggregates: name -> (aggregate function, column), by `key` in `order`, itself included.

    Ranges are summed apart; totals of a key's earlier ranges are added. A key
    with most of the rows is so spread over many tasks.
    """
    placed = checkpointed(_ranged(df, F.col(key), order).drop("at"))
    agg = {"sum": F.sum, "bit_xor": F.bit_xor}
    plus = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    totals = placed.groupBy(key, "part").agg(*[agg[f](c).alias(f"_{n}") for n, (f, c) in sums.items()])
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "part", *[F.coalesce(agg[f](f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n, (f, _) in sums.items()])
    within = Window.partitionBy(key, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(totals, [key, "part"])
    return out.withColumns({n: plus[f](agg[f](c).over(within), F.col(f"_{n}")) for n, (f, c) in sums.items()}).drop("part", *[f"_{n}" for n in sums])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, len of every rebuilt conversation; conv_id, depth, c1, c2 (hashes of role and text), n_bytes of their turns."""
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = {"c1": F.xxhash64("role", "text"), "c2": F.xxhash64(F.lit("second"), "text", "role"), "n_bytes": F.octet_length("text").cast("long")}
    placed = checkpointed(_ranged(turns, F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")).withColumns(hashes).drop("turn", "role", "text"))
    spans = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = checkpointed(spans.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("own"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED, "base": F.expr(f"conv_id - conv_id % {FAMILY}")})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = checkpointed(convs.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    known = spans.join(convs.select("conv_id", "h", "shared"), "conv_id").drop("n")
    turns = checkpointed(placed.join(known, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "h", "shared", "c1", "c2", "n_bytes"))
    own = turns.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "c1", "c2", "n_bytes")
    heads = turns.where(F.col("place") < MOST_SHARED).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "c1", "c2", "n_bytes")
    head = convs.where("shared > 0").select("conv_id", "base", "shared").join(heads, "base").where("depth <= shared").select("conv_id", "depth", "c1", "c2", "n_bytes")
    return convs.select("conv_id", "len"), own.union(head)


def first_owned(convs: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, len, first: the least depth whose prefix no smaller conversation has; len + 1 where there is none.

    prefixes: conv_id, depth, da, db; minima: depth, da, db, owner.
    """
    open_, done = convs.select("conv_id", "len", F.lit(1).cast("long").alias("low"), (F.col("len") + 1).alias("high")), None
    while True:
        closed = open_.where("low >= high").select("conv_id", "len", F.col("low").alias("first"))
        done = closed if done is None else done.union(closed)
        probes = open_.where("low < high").withColumn("depth", F.expr("(low + high) DIV 2"))
        if probes.isEmpty():
            return done
        met = probes.join(prefixes.select("conv_id", "depth", "da", "db"), ["conv_id", "depth"]).join(minima.select("depth", "da", "db", "owner"), ["depth", "da", "db"])
        owned = F.col("owner") == F.col("conv_id")
        open_ = checkpointed(met.select("conv_id", "len", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high")))


def chain_sums(chains: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """conv_id and `columns`, each summed over the chain and all that hang on it, from conv_id, up (null at the root), columns."""
    state = checkpointed(chains.select("conv_id", "up", *columns))
    while not state.where("up IS NOT NULL").isEmpty():
        more = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        higher = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        new = state.join(more, "conv_id", "left").join(higher, "up", "left")
        new = checkpointed(new.select("conv_id", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]))
        discard(state)
        state = new
    return state.select("conv_id", *columns)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the decimal ids of one node, from rows (node, depth, id) sorted by all three."""
    names = ["conv_id", "depth", "first", "ids"]

    def row(chunk: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, (*chunk[0], chunk[1], ",".join(chunk[2])), strict=True))], schema=pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    chunk: list | None = None
    size = 0
    for batch in batches:
        for node, depth, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk is None or chunk[0] != (node, depth) or size >= CHUNK_BYTES:
                if chunk is not None:
                    yield row(chunk)
                chunk, size = [(node, depth), own, []], 0
            chunk[2].append(str(own))
            size += len(chunk[2][-1]) + 1
    if chunk is not None:
        yield row(chunk)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's chunks, which come one after the other; one chunk is held at a time."""
    last, digest, out = None, None, []
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        for node, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last == (node, depth):
                digest.update(b"," + ids.encode())
                continue
            if last is not None:
                out.append({"conv_id": last[0], "depth": last[1], "sha": digest.hexdigest()})
            last, digest = (node, depth), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": last[0], "depth": last[1], "sha": digest.hexdigest()}], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, sha of each node's ends, from rows conv_id, depth, id."""
    placed = ends.select("conv_id", "depth", "id").repartitionByRange(_parts(ends.sparkSession), "conv_id", "depth", "id").sortWithinPartitions("conv_id", "depth", "id")
    chunks = placed.mapInArrow(_packed, "conv_id long, depth long, first long, ids string")
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hashed, "conv_id long, depth long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations)
    turns = turns.select("conv_id", "depth", "n_bytes", F.xxhash64("depth", "c1").alias("ta"), F.xxhash64("depth", "c2").alias("tb"))
    prefixes = _running(turns, "conv_id", F.col("depth"), {"da": ("bit_xor", "ta"), "db": ("bit_xor", "tb")}).drop("ta", "tb")
    prefixes = bucketed(prefixes, ["conv_id", "depth"], _parts(spark))
    minima = prefixes.groupBy("depth", "da", "db").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    minima = bucketed(minima, ["depth", "da", "db"], _parts(spark))

    found = checkpointed(first_owned(convs, prefixes, minima))
    # the node above each chain's first; for conversations that own nothing, the node where they end
    at = found.withColumn("depth", F.col("first") - 1).where("depth > 0")
    above = at.join(prefixes, ["conv_id", "depth"]).join(minima.select("depth", "da", "db", "owner"), ["depth", "da", "db"]).select("conv_id", F.col("owner").alias("above"))
    found = checkpointed(found.join(above, "conv_id", "left"))
    nodes = checkpointed(minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")))
    drop_bucketed(prefixes)
    drop_bucketed(minima)

    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    heads = found.where("first <= len").select("conv_id", F.col("first").alias("depth"), "above", F.lit(True).alias("head"))
    nodes = nodes.join(heads, ["conv_id", "depth"], "left")
    nodes = nodes.select("conv_id", "depth", "n_convs", "saved", "head", F.when(F.col("head"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"))
    children = nodes.where("depth > 1").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    chains = nodes.groupBy("conv_id").agg(F.max(F.when(F.col("head"), F.col("parent_conv_id"))).alias("up"), F.max(F.when(F.col("head"), F.col("depth"))).alias("first"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    chains = checkpointed(chains)
    sums = checkpointed(chains.select("conv_id", "up", "first").join(chain_sums(chains, ("saved", "leaf")), "conv_id"))
    hung = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaf").alias("hung_leaf"))
    nodes = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("hung_saved", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("hung_leaf", F.lit(0))})
    nodes = _running(nodes.drop("hung_saved", "hung_leaf", "head"), "conv_id", F.desc("depth"), {"saved_tokens": ("sum", "saved"), "n_leaves": ("sum", "leaf")})

    top = sums.where("up IS NULL").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), F.greatest(F.coalesce(F.sum("leaf"), F.lit(0)), F.lit(1)).alias("n_leaves"))
    top = root.join(F.broadcast(top)).withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    # a chain hangs on the root where no owner stands above it; the root itself is its smallest conversation's
    first = root.select(F.col("conv_id").alias("least"))
    named = nodes.join(F.broadcast(first)).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "least"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tree = named.select(*columns).union(top.select(*columns))

    owner = F.when(F.col("first") <= F.col("len"), F.col("conv_id")).otherwise(F.col("above"))
    ends = found.join(F.broadcast(first)).select(F.when(F.col("len") == 0, F.col("least")).otherwise(owner).alias("conv_id"), F.col("len").alias("depth"), F.col("conv_id").alias("id"))
    return tree.join(end_digests(ends), ["conv_id", "depth"], "left").select(*columns, F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE_SQL = """
WITH RECURSIVE crc_table(n, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) AS t(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), digits(conv_id, pos, crc) AS (
  SELECT DISTINCT conv_id, 1, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT d.conv_id, d.pos + 1, xor(d.crc >> 8, t.c) FROM digits d JOIN crc_table t ON t.k = 8 AND t.n = xor(d.crc, ascii(substr(d.conv_id::VARCHAR, d.pos, 1))::BIGINT) & 255
  WHERE d.pos <= length(d.conv_id::VARCHAR)
), convs AS (
  SELECT conv_id, xor(crc, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM digits WHERE pos = length(conv_id::VARCHAR) + 1
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), built AS (
  SELECT c.conv_id, 0 AS side, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h
  UNION ALL SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, place) AS depth, role, text FROM built
), prefixes(conv_id, depth, digest, bytes) AS (
  SELECT conv_id, 0::BIGINT, '', 0::BIGINT FROM convs
  UNION ALL SELECT t.conv_id, t.depth, md5(p.digest || md5(t.role) || md5(t.text)), octet_length(encode(t.text))::BIGINT FROM prefixes p JOIN turns t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1
), lens AS (
  SELECT conv_id, max(depth) AS len FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT p.digest, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN l.len = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM prefixes p JOIN lens l ON l.conv_id = p.conv_id GROUP BY p.digest, p.depth
), parents AS (
  SELECT n.*, u.conv_id AS parent_conv_id, u.digest AS up FROM nodes n
  LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.digest = p.digest AND u.depth = p.depth
), kids AS (
  SELECT up, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM parents p LEFT JOIN kids k ON k.up = p.digest AND k.depth = p.depth
), below AS (
  SELECT p.digest, p.depth, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves
  FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.digest, p.depth
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.digest = n.digest AND b.depth = n.depth
"""
