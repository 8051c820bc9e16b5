"""The trie of conversation prefixes, by a skeleton of splitter paths (operator 13).

A conversation is its turns in order; conversations that begin alike share the nodes of
their common turns. The root has no turns. Per node: its smallest conversation, how many
pass through it, its children, the childless nodes below it, and the tokens that storing
each shared turn once saves below it.

1. A turn is reduced to a digest of role and text and its number of words, so that no text
   is shuffled. A conversation is one row: the path of its turns' digests.
2. Splitters are (path, conversation) pairs of a bounded sample. They cut all conversations,
   in order of path and conversation, into shards, so that copies of one conversation are
   split as well. The trie of the splitters' paths, the skeleton, is broadcast: a node
   that spans shards is on it, as everything between two rows that share a prefix shares it.
3. Each shard is sorted and read once, with the open nodes on a stack. Nodes beside the
   skeleton are finished there; of skeleton nodes a shard gives its part.
4. The parts are reduced per skeleton node, and its sums over the subtree are those of the
   skeleton nodes below it.

A node's conversations that end there are hashed in order of their keys, in pieces of text
that shards have joined already.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import Scratch, stored

WORDS = r"[^\x20\x09-\x0D]+"
DIGEST = 16
# Sampled rows per shard, and turns of a splitter that count.
SAMPLED = 64
SPLITTER_TURNS = 256
# Bytes of joined keys in one piece, and rows read at once.
PIECE = 1 << 16

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
# A shard's rows: finished nodes, parts of skeleton nodes and pieces of their ends.
PART = (
    "kind string, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, words long, ends_sha256 string, shard int, piece long, ends string"
)
PART_NAMES = [c.split()[0] for c in PART.split(",")]
PART_TYPES = [
    pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.int32(), pa.int64(), pa.string(),
]


def turn_digest(role: str, text: str) -> Column:
    """Sixteen bytes that stand for a turn: null is as empty, and (role, text) can't run together."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, _turns): each conversation's turns in order, as (digest, words).

    Turns are ordered by `turn`, null first, and equal ones by their digest. Rows without
    conv_id belong to no conversation.
    """
    narrow = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"),
            turn_digest("role", "text").alias("d"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).alias("w"),
        ).alias("_turn"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("_turn")), lambda t: F.struct(t["d"], t["w"]))
    return narrow.groupBy("conv_id").agg(ordered.alias("_turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation c after the first h turns of c - c % 20; h is crc32(c) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = convs.filter("conv_id % 20 = 0").select(
        F.col("conv_id").alias("_base"), F.slice("_turns", 1, 3).alias("_head")
    )
    met = convs.select("conv_id", "_turns", base.alias("_base"), h.alias("_h")).join(heads, "_base", "left")
    none = F.slice("_turns", 1, 0)
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), F.col("_h"))).otherwise(none)
    own = F.expr("slice(_turns, _h + 1, greatest(size(_turns) - _h, 0))")
    return met.select("conv_id", F.concat(head, own).alias("_turns"))


def as_paths(convs: DataFrame) -> DataFrame:
    """(conv_id, _path, _words): the digests of all turns end to end, and each turn's words."""
    path = F.unhex(F.array_join(F.transform("_turns", lambda t: F.hex(t["d"])), ""))
    return convs.select("conv_id", path.alias("_path"), F.transform("_turns", lambda t: t["w"]).alias("_words"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """shards - 1 places in the order of (path, conversation), from a sample of bounded size."""
    if shards < 2:
        return []
    part = F.substring("_path", 1, SPLITTER_TURNS * DIGEST)
    sample = paths.select(part.alias("_path"), "conv_id", F.xxhash64("conv_id").alias("_by"))
    rows = sample.orderBy("_by", "conv_id").limit(SAMPLED * shards).collect()
    rows = sorted((bytes(r["_path"]), r["conv_id"]) for r in rows)
    return sorted({rows[i * len(rows) // shards] for i in range(1, shards)}) if rows else []


def skeleton(cuts: list[tuple[bytes, int]]) -> set[bytes]:
    """The nodes that may span shards: all prefixes of the splitters' paths."""
    return {b""} | {path[:end] for path, _ in cuts for end in range(DIGEST, len(path) + 1, DIGEST)}


def node_name(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=DIGEST).digest()


def _shards(cuts: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["_path"].to_pylist(), batch["conv_id"].to_pylist())
            shard = [bisect_right(cuts, row) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "_shard"]
            )

    return run


@dataclass
class Open:
    """A node whose conversations are being read."""

    depth: int
    words: int
    name: bytes | None = None  # of a skeleton node
    conv: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: object = None
    joined: list[str] = field(default_factory=list)
    held: int = 0
    pieces: int = 0
    waiting: list[list] = field(default_factory=list)  # finished children, for their parent's key


class Shard:
    """Reads the sorted conversations of a shard and keeps the nodes on the way open."""

    def __init__(self, number: int, spine: set[bytes]):
        self.number, self.spine = number, spine
        self.path, self.stack, self.out = b"", [], []
        self._open(b"", 0)

    def _open(self, path: bytes, words: int) -> None:
        name = node_name(path) if path in self.spine else None
        self.stack.append(Open(len(path) // DIGEST, words, name))

    def _row(self, kind: str, **values) -> list:
        row = dict.fromkeys(PART_NAMES) | values | {"kind": kind, "shard": self.number}
        return [row[name] for name in PART_NAMES]

    def read(self, conv: int, path: bytes, words: list[int]) -> None:
        old = self.path
        if path != old:
            most = min(len(path), len(old)) // DIGEST
            common = 0
            while common < most and path[common * DIGEST : (common + 1) * DIGEST] == old[common * DIGEST : (common + 1) * DIGEST]:
                common += 1
            while len(self.stack) > common + 1:
                self._close()
            for depth in range(common + 1, len(path) // DIGEST + 1):
                self._open(path[: depth * DIGEST], words[depth - 1])
            self.path = path
        for node in self.stack:
            node.convs += 1
            if node.conv is None or conv < node.conv:
                node.conv = conv
        top = self.stack[-1]
        if top.name is None:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(b",%d" % conv)
            return
        top.joined.append(str(conv))
        top.held += len(top.joined[-1]) + 1
        if top.held >= PIECE:
            self._piece(top)

    def _piece(self, node: Open) -> None:
        self.out.append(self._row("ends", node=node.name, piece=node.pieces, ends=",".join(node.joined)))
        node.joined, node.held, node.pieces = [], 0, node.pieces + 1

    def _close(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if node.name is None:
            saved = node.saved + (node.convs - 1) * node.words
            leaves = node.leaves or 1
            for row in node.waiting:
                row[PART_NAMES.index("parent_conv_id")] = node.conv
                self.out.append(row)
            ends = (node.ends or hashlib.sha256()).hexdigest()
            row = self._row(
                "node", conv_id=node.conv, depth=node.depth, n_convs=node.convs, n_children=node.children,
                n_leaves=leaves, saved_tokens=saved, ends_sha256=ends,
            )
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            if above.name is None:
                above.waiting.append(row)
            else:  # the parent's key is known after the reduction only
                row[PART_NAMES.index("parent")] = above.name
                self.out.append(row)
            return
        if node.joined:
            self._piece(node)
        self.out.append(
            self._row(
                "part", node=node.name, parent=above.name if above else None, depth=node.depth, conv_id=node.conv,
                n_convs=node.convs, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved,
                words=node.words,
            )
        )

    def close(self) -> None:
        while self.stack:
            self._close()

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * len(PART_NAMES)
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, PART_TYPES)], PART_NAMES
        )


def _nodes(spine: set[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            numbers = batch["_shard"].to_pylist()
            words = batch["_words"]
            for i, (conv, path) in enumerate(zip(batch["conv_id"].to_pylist(), batch["_path"].to_pylist())):
                if shard is None or shard.number != numbers[i]:
                    if shard is not None:
                        shard.close()
                        yield shard.taken()
                    shard = Shard(numbers[i], spine)
                shard.read(conv, path, words[i].as_py() if path != shard.path else [])
                if len(shard.out) >= 8192:
                    yield shard.taken()
        if shard is not None:
            shard.close()
            yield shard.taken()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, joined by commas."""
    node = sums = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([sums.hexdigest()])], ["node", "ends_sha256"]
        )

    for batch in batches:
        for name, text in zip(batch["node"].to_pylist(), batch["ends"].to_pylist()):
            if name == node:
                sums.update(b"," + text.encode())
                continue
            if node is not None:
                yield out()
            node, sums = name, hashlib.sha256(text.encode())
    if node is not None:
        yield out()


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie over (conv_id, _path, _words); conv_id has to be unique.

    Columns as in NODE. Without any conversation there is no row, not even a root. A
    conversation without turns belongs to the root only. Equal conversations share all
    nodes; the smallest conv_id stands for each. One conversation has to fit a row, as
    digests of sixteen bytes a turn.
    """
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "trie") as scratch:
        paths = scratch.stored(paths, "paths")
        cuts = splitters(paths, shards)
        spine = skeleton(cuts)
        dealt = paths.mapInArrow(_shards(cuts), "conv_id long, _path binary, _words array<int>, _shard int")
        dealt = dealt.repartitionById(len(cuts) + 1, "_shard").sortWithinPartitions("_shard", "_path", "conv_id")
        parts = stored(dealt.mapInArrow(_nodes(spine), PART), "trie-parts")

    top = parts.filter("kind = 'part'").groupBy("node", "parent", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    top = stored(top, "trie-top")
    # Each skeleton node's own share, at all nodes above it and at itself.
    lines = [
        (node_name(path), [node_name(path[:end]) for end in range(0, len(path) + 1, DIGEST)]) for path in spine
    ]
    lines = F.broadcast(spark.createDataFrame(lines, "node binary, above array<binary>"))
    below = top.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("_spine"))
    own = top.join(F.broadcast(below.withColumnRenamed("parent", "node")), "node", "left")
    own = own.withColumn("n_children", F.col("n_children") + F.coalesce("_spine", F.lit(0)))
    share = own.select(
        "node",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("_saved"),
    )
    sums = share.join(lines, "node").select(F.explode("above").alias("node"), "_leaves", "_saved")
    sums = sums.groupBy("node").agg(F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))
    pieces = parts.filter("kind = 'ends'").select("node", "shard", "piece", "ends")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece")
    ends = pieces.mapInArrow(_hashed, "node binary, ends_sha256 string")
    keys = F.broadcast(top.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent")))
    none = hashlib.sha256().hexdigest()
    spanning = (
        own.join(F.broadcast(sums), "node")
        .join(ends, "node", "left")
        .join(keys, "parent", "left")
        .select(
            "conv_id", "depth", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children",
            F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
    names = spanning.columns
    inside = parts.filter("kind = 'node'").join(keys, "parent", "left")
    inside = inside.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return inside.select(*names).unionByName(spanning)
