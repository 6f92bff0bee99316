"""Prefix trie of conversations, by a splitter skeleton.

A conversation is a path: a key of 128 bits for each turn, from its role and text, and the bytes of its text.  Only these move, some 25 bytes a turn; texts stay where they are read.
Paths are dealt into shards by ranges of (path, id).  The splitters come from a sample of the paths, so they settle how even the shards are and nothing else.  A node whose conversations
stand in more than one shard is the start of a splitter, as all paths between two that share a start share it too.  So the trie of the splitters, the skeleton, is broadcast, each shard is sorted and
finishes all other nodes while it reads, with a stack of the open nodes, and for a node of the skeleton it gives what it knows: sums, the least id, and the ids that end there, in chunks.
Those are reduced by node.  The hash of the ids of a skeleton node runs over its chunks in order, a task holding one chunk at a time; a hash of a list cannot be split further.

Equal conversations follow each other by id, so a large group of copies is many shards.  A shard holds the finished children of its open nodes, at most its own rows.  A conversation's turns are held
by one task (28 bytes a turn), as a text is.  The sample is at most some ``SAMPLE_BYTES``, and the skeleton is a part of it.

Turns of a conversation are ordered by number, null first; equal numbers follow each other by their key.  A null role or text counts as empty.  Rows without a conversation id belong to none and are left out.
Repeated turns are turns.  An empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspark.llm.common import cut

KEY = 16
SHARD_BYTES, MOST_SHARDS, SAMPLE_BYTES = 8 << 20, 16_384, 16 << 20
#: Ids in a chunk of a skeleton node, and rows in a batch of results.
CHUNK, BATCH = 4096, 8192


def turn_key(role: Column, text: Column) -> Column:
    """32 hexadecimal digits; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)


def rebuilt_paths(conversations: DataFrame, *, group: int = 5, most: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, path (keys of the turns, joined), sizes (bytes of their texts) of every conversation, rebuilt on the first one of its group.

    It takes the first h turns of conversation id - id % group (the sign of the remainder is the id's, as in SQL), h being crc32(id) % most, and then its own after its first h.
    """
    c, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(c.cast("long").alias("id"), F.col(turn_col).alias("turn"), turn_key(F.col(role_col), text).alias("key"), F.octet_length(text).alias("size"))
    groups = conversations.where(c.isNotNull()).groupBy((c - c % group).cast("long").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    ids = F.array_distinct(F.transform("turns", lambda t: t["id"]))
    each = groups.select("base", "turns", F.explode(ids).alias("id"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int")
    of = lambda i: F.filter("turns", lambda t: t["id"] == i)
    own, base = of(F.col("id")), of(F.col("base"))
    rebuilt = each.select("id", F.concat(F.slice(base, F.lit(1), h), F.slice(own, h + 1, F.size(own))).alias("turns"))
    return rebuilt.select("id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share."""
    n = min(len(a), len(b)) // KEY * KEY
    if a[:n] == b[:n]:
        return n // KEY
    at = 0
    while a[at : at + KEY] == b[at : at + KEY]:
        at += KEY
    return at // KEY


@dataclass
class Skeleton:
    """The trie of the splitters: nodes in the order of their paths, the root first."""

    splitters: list[tuple[bytes, int]] = field(default_factory=list)
    #: Of each splitter, the nodes on its path, the root first.
    nodes: list[list[int]] = field(default_factory=list)
    depth: list[int] = field(default_factory=lambda: [0])
    parent: list[int | None] = field(default_factory=lambda: [None])
    #: Bytes of the last text.
    size: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def of(cls, splitters: list[tuple[bytes, int, list[int]]]) -> Skeleton:
        made, before = cls(), b""
        for path, id_, sizes in splitters:
            on = (made.nodes[-1] if made.nodes else [0])[: common_turns(path, before) + 1]
            for d in range(len(on), len(path) // KEY + 1):
                on = [*on, len(made.depth)]
                made.depth.append(d)
                made.parent.append(on[-2])
                made.size.append(sizes[d - 1])
            made.splitters.append((path, id_))
            made.nodes.append(on)
            before = path
        return made

    def rows(self) -> list[tuple]:
        """node, depth, parent, the nodes up to the root, and the children and bytes that the skeleton itself adds to the node and its subtree."""
        children, below = [0] * len(self.depth), list(self.size)
        for n in range(len(self.depth) - 1, 0, -1):
            children[self.parent[n]] += 1
            below[self.parent[n]] += below[n]

        def up(n: int | None) -> Iterator[int]:
            while n is not None:
                yield n
                n = self.parent[n]

        # Only ends of splitters can be childless, so only they need their path.
        return [(n, self.depth[n], p, [] if children[n] else list(up(n)), children[n], below[n]) for n, p in enumerate(self.parent)]


def splitters_of(paths: DataFrame, *, shards: int, sample_bytes: int = SAMPLE_BYTES, total: int, seed: int = 0) -> list[tuple[bytes, int, list[int]]]:
    """Up to ``shards`` - 1 of the sampled (path, id, sizes), at even steps of their bytes."""
    if shards < 2:
        return []
    sampled = paths if total <= sample_bytes else paths.sample(fraction=sample_bytes / total, seed=seed)
    rows = sorted({(bytes(r["path"]), r["id"]): list(r["sizes"]) for r in sampled.select("path", "id", "sizes").toLocalIterator()}.items())
    weights = [len(path) + 32 for (path, _), _ in rows]
    step, passed, out = sum(weights) / shards, 0.0, []
    for (key, sizes), w in zip(rows, weights, strict=True):
        if passed >= step * (len(out) + 1):
            out.append((*key, sizes))
        passed += w
    return out


def sharded(paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The paths with their shard, each shard a partition, sorted by path and id."""
    schema = T.StructType([*paths.schema.fields, T.StructField("shard", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(skeleton.splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"])

    return paths.mapInArrow(run, schema).repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "id")


class _Open:
    """An open node of a shard, and the sums of what is closed below it."""

    __slots__ = ("children", "ends", "ends_at", "finished", "leaves", "least", "n", "node", "once", "size", "weighted")

    def __init__(self, node: int | None, size: int) -> None:
        self.node, self.size, self.least, self.n, self.children, self.leaves = node, size, None, 0, 0, 0
        #: Bytes times conversations, and bytes counted once for each node that is no skeleton node.
        self.weighted = self.once = 0
        #: Digest of the ids that end here; of a skeleton node the ids of the chunk, and the number of the next one.
        self.ends, self.ends_at = (hashlib.sha256() if node is None else []), 0
        #: Finished children, which wait for this node's least id.
        self.finished: list[tuple] = []


#: Finished nodes have no ``node``; partial ones have, and so have chunks, which have no ``depth``. ``above`` is the parent's skeleton node.
_FIELDS = "node int, above int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, weighted bigint, once bigint, ends_sha256 string, shard int, chunk bigint, ids string"
_N = len(_FIELDS.split(", "))


def _shard_rows(rows: Iterator[tuple[int, int, bytes, list[int]]], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of ``_FIELDS`` from (shard, id, path, sizes) in their order."""
    stack: list[_Open] = []
    shard = 0

    def close() -> Iterator[tuple]:
        x, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        x.weighted += x.n * x.size
        if x.node is None:
            x.once += x.size
            x.leaves += not x.children
            ends = x.ends.hexdigest()
            yield from ((None, None, c[0], c[1], x.least, *c[2:], None, None, None) for c in x.finished)
            row = (x.least, depth, x.n, x.children, x.leaves, x.weighted, x.once, ends)
            above.children += 1
            if above.node is None:
                above.finished.append(row)
            else:
                yield (None, above.node, row[0], row[1], None, *row[2:], None, None, None)
        else:
            if x.ends:
                yield (x.node, *[None] * (_N - 4), shard, x.ends_at, ",".join(x.ends))
            yield (x.node, None, x.least, depth, None, x.n, x.children, x.leaves, x.weighted, x.once, None, shard, None, None)
        if above is not None:
            above.n, above.leaves, above.weighted, above.once = above.n + x.n, above.leaves + x.leaves, above.weighted + x.weighted, above.once + x.once
            above.least = x.least if above.least is None else min(above.least, x.least)

    before, lower, upper = None, None, None
    for number, id_, path, sizes in rows:
        if before is None or number != shard:
            while stack:
                yield from close()
            shard, before = number, b""
            around = [k for k in (number - 1, number) if 0 <= k < len(skeleton.splitters)]
            ends = [(skeleton.splitters[k][0], skeleton.nodes[k]) for k in around]
            stack.append(_Open(0, 0))
        same = common_turns(path, before)
        while len(stack) > same + 1:
            yield from close()
        turns = len(path) // KEY
        if turns + 1 > len(stack):
            shared = max(((common_turns(path, p), on) for p, on in ends), key=lambda x: x[0], default=(0, [0]))
            for d in range(len(stack), turns + 1):
                stack.append(_Open(shared[1][d] if d <= shared[0] else None, sizes[d - 1]))
        x = stack[-1]
        if x.node is None:
            x.ends.update((b"," if x.n else b"") + str(id_).encode())
        else:
            x.ends.append(str(id_))
            if len(x.ends) == CHUNK:
                yield (x.node, *[None] * (_N - 4), shard, x.ends_at, ",".join(x.ends))
                x.ends, x.ends_at = [], x.ends_at + 1
        x.n += 1
        x.least = id_ if x.least is None else min(x.least, id_)
        before = path
    while stack:
        yield from close()


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _shard_parts(shards: DataFrame, skeleton: Skeleton) -> DataFrame:
    schema = T.StructType.fromDDL(_FIELDS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in ("shard", "id", "path", "sizes")], strict=True))
        yield from _in_batches(_shard_rows(rows, skeleton), arrow)

    return shards.mapInArrow(run, schema)


def _hashed_chunks(chunks: DataFrame) -> DataFrame:
    """node, ends_sha256: the hash of a node's chunks, joined by commas in the order of shards and chunks."""
    schema = T.StructType.fromDDL("node int, ends_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, digest = None, None
            for b in batches:
                for k, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    if k != node:
                        if node is not None:
                            yield node, digest.hexdigest()
                        node, digest = k, hashlib.sha256(ids.encode())
                    else:
                        digest.update(b"," + ids.encode())
            if node is not None:
                yield node, digest.hexdigest()

        yield from _in_batches(rows(), arrow)

    return chunks.repartition("node").sortWithinPartitions("node", "shard", "chunk").select("node", "ids").mapInArrow(run, schema)


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _skeleton_nodes(parts: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The rows of the skeleton's nodes, with ``node``: what the shards know, reduced, and what the skeleton itself adds."""
    spark = parts.sparkSession
    own = spark.createDataFrame(skeleton.rows(), "node int, depth bigint, above int, path array<int>, own_children bigint, own_bytes bigint")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighted", "once")]
    known = parts.where("node is not null and depth is not null").groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums)
    ends = _hashed_chunks(parts.where("node is not null and ids is not null").select("node", "shard", "chunk", "ids"))
    nodes = known.join(own, "node").join(ends, "node", "left").withColumn("n_children", F.col("n_children") + F.col("own_children"))
    leaves = nodes.where("n_children = 0").select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("own_leaves"))
    nodes = nodes.join(leaves, "node", "left")
    parents = known.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "above", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("own_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("weighted") - F.col("once") - F.col("own_bytes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie_nodes(paths: DataFrame, *, shard_bytes: int = SHARD_BYTES, most_shards: int = MOST_SHARDS, least_shards: int | None = None, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """A row for every node of the trie of ``paths`` (id, path, sizes), the root included."""
    paths = cut(paths)
    total = paths.agg(F.sum(F.length("path") + 32)).first()[0] or 0
    least = 2 * paths.sparkSession.sparkContext.defaultParallelism if least_shards is None else least_shards
    shards = min(most_shards, max(least, -(-total // shard_bytes)))
    skeleton = Skeleton.of(splitters_of(paths, shards=shards, sample_bytes=sample_bytes, total=total))
    parts = cut(_shard_parts(sharded(paths, skeleton), skeleton))
    top = cut(_skeleton_nodes(parts, skeleton))
    finished = parts.where("node is null").withColumn("saved_tokens", F.col("weighted") - F.col("once"))
    # As many rows as the skeleton has nodes, which the sample bounds.
    parents = F.broadcast(top.select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv_id")))
    finished = finished.join(parents, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    return finished.select(_RESULT).unionByName(top.select(_RESULT))
