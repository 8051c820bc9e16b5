"""Near-duplicate documents by fast similarity sketching (operator 4).

A document is the set of its distinct shingles of `words` words; with fewer words, but
not none, of the whole sequence as one. Documents without words are linked with nothing.
Two documents are linked if intersection / union reaches `percent` / 100.

1. Equal sets fall together into one node, so copies cost nothing later on.
2. Each node gets a sketch of ROWS * BANDS coordinates. In round after round every
   shingle is hashed into one bin, and a bin keeps the lowest value of the first round
   that reaches it; the last rounds go through the bins one by one, so that each
   coordinate is filled. Sets of some size are done after two or three rounds.
3. Nodes with an equal band meet in a bucket. Two nodes at 0.8 miss each other with
   probability (1 - 0.8**6)**48 < 5e-7.
4. Each bucket's first node is verified against the others on full sets: of its first
   nodes, a node meets the one with most bands in common before those it is then still
   apart from. Nodes that links join need no further look at each other.
5. What is left are pairs of a bucket in different components. They are verified in
   blocks of bounded size, which emit links only. Buckets with the same first node that
   fit into one block together are one group there, as they share most of their nodes. No
   link between components is lost, and no list of all pairs is made.

All verifications use complete sets of 64-bit shingle hashes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import Scratch, keyed, likely_rows, listed_rows, same, stored
from twinsieve.llm.textbatch import Texts, distinct_by_text, mix, row_chunks, seeded, sums_by
from twinsieve.operators.groups import is_short, join_groups

ROWS, BANDS = 6, 48
COORDINATES = ROWS * BANDS
# Nodes of one side in a block.
BLOCK = 256
# Stored tables without sets or texts, of up to so many rows, are broadcast to joins.
BROADCAST_ROWS = 100_000
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array, words: int):
    """Text number and hash of each text's distinct shingles, sorted by both."""
    found = Texts(texts, lower=True).words()
    hashes, n = found.hashes(), len(found.text)
    rolled = seeded(hashes, 0)
    for i in range(1, min(words, n)):  # of the words from each word on, as far as its text goes
        inside = found.text[i:] == found.text[:-i]
        rolled[:-i] += np.where(inside, seeded(hashes[i:], i), _U(0))
    left = found.first[1:][found.text] - np.arange(n)
    whole = (left < words) & (np.arange(n) == found.first[:-1][found.text])
    keep = (left >= words) | whole
    return distinct_by_text(found.text[keep], mix(rolled[keep]))[:2]


def sketch(text: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
    """Sketches of n sets, given as sorted set numbers and items. Sets are not empty."""
    t = COORDINATES
    filled = np.full(n * t, _EMPTY)
    for i in range(2 * t):
        h = seeded(items, i)
        if i < t:
            coordinate = ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64)
        else:
            coordinate = i - t
        value = (_U(i) << _U(52)) | (h & _U((1 << 52) - 1))
        np.minimum.at(filled, text * t + coordinate, value)
        open_sets = (filled.reshape(n, t) == _EMPTY).any(1)
        if not open_sets.any():
            break
        more = open_sets[text]
        text, items = text[more], items[more]
    return filled.reshape(n, t)


def band_hashes(sketches: np.ndarray) -> np.ndarray:
    bands = sketches.reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for row in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + bands[:, :, row])
    return out.view(np.int64)


def set_names(text: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
    """A 128-bit name of each set, as bytes."""
    halves = [sums_by(text, seeded(items, 1001 + i), n) for i in (0, 1)]
    return np.stack([mix(h) for h in halves], axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, data]).cast(pa.binary())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_chunks(batch["_text"]):
                text, items = shingles(batch["_text"][a:b], words)
                n = b - a
                size = np.bincount(text, minlength=n)
                # Number the sets that are not empty.
                full = np.flatnonzero(size)
                at = (np.cumsum(size > 0) - 1)[text]
                bands = band_hashes(sketch(at, items, len(full)))
                names = _binary(set_names(at, items, len(full)))
                place = np.where(size > 0, np.cumsum(size > 0) - 1, -1)
                take = pa.array(place, pa.int64(), mask=place < 0)
                lists = _lists(bands.reshape(-1), np.full(len(full), BANDS))
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"][a:b], batch["_fp"][a:b], pa.array(size, pa.int64()),
                     names.take(take), lists.take(take)],
                    ["_id", "_fp", "_n", "_node", "_bands"],
                )

    return run


def _set_tables(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_chunks(batch["_text"]):
                text, items = shingles(batch["_text"][a:b], words)
                sizes = np.bincount(text, minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch["_node"][a:b], _lists(items.view(np.int64), sizes)], ["_node", "_set"]
                )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def _block_links(percent: int):
    """Links between the left and the right nodes of a block, across components."""

    def run(block: pa.Table) -> pa.Table:
        left = np.asarray(block["_left"])
        nodes, comps = block["_node"].to_pylist(), block["_comp"].to_pylist()
        lists = block["_set"].combine_chunks()
        sets = [np.asarray(lists[i].values) for i in range(len(nodes))]
        out: list[tuple[bytes, bytes]] = []
        joined: dict[bytes, bytes] = {}

        def root(c: bytes) -> bytes:
            while (up := joined.get(c, c)) != c:
                c = up
            return c

        rights = np.flatnonzero(~left)
        for i in np.flatnonzero(left):
            for j in rights:
                if root(comps[i]) != root(comps[j]) and _linked(sets[i], sets[j], percent):
                    out.append((nodes[i], nodes[j]))
                    joined[root(comps[i])] = root(comps[j])
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def _near(table: DataFrame) -> DataFrame:
    """A stored table, broadcast to joins where it is short."""
    return F.broadcast(table) if is_short(table, BROADCAST_ROWS) else table


def _blocks(
    lefts: DataFrame, rights: DataFrame, sets: DataFrame, group: str, percent: int, scratch: Scratch
) -> DataFrame:
    """Verify lefts against rights within each value of `group`, in blocks.

    Both have (group, _node, _comp). Emits linked pairs of different components.
    """
    sizes = [
        side.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        for side, name in ((lefts, "_lb"), (rights, "_rb"))
    ]
    blocks = _near(scratch.stored(sizes[0].join(sizes[1], group), "blocks"))
    own = lambda n: F.pmod(F.xxhash64("_node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = None
    for side, is_left in ((lefts, True), (rights, False)):
        near, far = ("_lb", "_rb") if is_left else ("_rb", "_lb")
        rows = side.join(blocks, group).select(
            group, "_node", "_comp", F.lit(is_left).alias("_left"),
            own(near).alias("_near"), every(far).alias("_far"),
        )
        names = ("_near", "_far") if is_left else ("_far", "_near")
        rows = rows.select(
            group, "_node", "_comp", "_left", F.col(names[0]).alias("_l"), F.col(names[1]).alias("_r")
        )
        out = rows if out is None else out.unionByName(rows)
    out = scratch.stored(out, "block-rows")
    if is_short(out, BROADCAST_ROWS):
        with_sets = sets.join(F.broadcast(out), "_node").select(*out.columns, "_set")
    else:  # sets of these nodes only are shuffled
        out = out.withColumn("_at_node", F.xxhash64("_node"))
        near = likely_rows(sets.withColumn("_at_node", F.xxhash64("_node")), out, "_at_node")
        with_sets = out.drop("_at_node").join(near.drop("_at_node"), "_node")
    return with_sets.groupBy(group, "_l", "_r").applyInArrow(
        _block_links(percent), "a binary, b binary"
    )


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node has one partner at most, and no partner has one itself."""
    ends = pairs.select(F.col("a").alias("_node"), F.lit(1).alias("_up")).unionByName(
        pairs.select(F.col("b").alias("_node"), F.lit(0).alias("_up"))
    )
    seen = ends.groupBy("_node").agg(F.sum("_up").alias("_ups"), F.count("*").alias("_all"))
    return not seen.filter("_ups > 1 or (_ups = 1 and _all > 1)").count()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(_node, _root) of all nodes with edges; _root is the smallest node reached.

    Alternates two steps until all is stars: each node hands its smallest neighbour
    to its larger ones, then to its smaller ones. Paths shrink by half at least. Edges
    go from the larger node to the smaller one, so the middle of a star is its smallest.
    """

    def met(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        lowest = _near(scratch.stored(pairs.groupBy("a").agg(F.min("b").alias("_low")), "low"))
        lowest = lowest.select("a", F.least("a", "_low").alias("_low"))
        return lowest, pairs.join(lowest, "a")

    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.stored(now.distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # As many rows as there are edges; equal ones fall together after the second step.
        large = met(both)[1].filter("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        large = scratch.stored(large.filter("a != b"), "large")
        lowest, pairs = met(large)
        small = pairs.select(F.col("b").alias("a"), F.col("_low").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("_low").alias("b")))
        now = scratch.stored(small.filter("a != b").distinct(), "small")
    roots = now.select(F.col("b").alias("_node")).distinct()
    return now.select(F.col("a").alias("_node"), F.col("b").alias("_root")).unionByName(
        roots.select("_node", F.col("_node").alias("_root"))
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(_id, _fp, n_shingles, component_id, kept) for every row; _fp is the text's hash.

    component_id is the smallest key reachable over links; null keys come after all
    others. The row with that key is kept, of several such rows the one with the
    smallest _fp. Rows equal in key and text get the same answer each.
    """
    narrow = keyed(docs, key, text)
    kind = narrow.schema["_id"].dataType.simpleString()
    columns = f"_id {kind}, _fp long, _n long, _node binary, _bands array<long>"
    with Scratch(docs.sparkSession, "near-dups") as scratch:
        # The bands are most of this table, and nobody needs them after the links.
        sketched = scratch.stored(narrow.mapInArrow(_sketched(words), columns), "sketches")
        rows = stored(sketched.drop("_bands"), "near-rows")
        links = scratch.stored(_links(narrow, sketched, words, percent, scratch), "links")
        roots = stored(components(links, scratch), "near-roots")

    nodes = rows.filter("_node is not null").groupBy("_node")
    first = F.struct(F.col("_id").isNull().alias("_late"), "_id", "_fp")
    nodes = nodes.agg(F.min(first).alias("_first"), F.count("*").alias("_copies"))
    nodes = stored(nodes.join(roots, "_node", "left"), "near-nodes")
    nodes = nodes.withColumn("_root", F.hex("_root"))
    lowest = nodes.filter("_root is not null").groupBy("_root")
    lowest = stored(lowest.agg(F.min("_first").alias("_lowest"), F.count("*").alias("n")), "near-lowest")
    classes = nodes.filter("_root is not null or _copies > 1")
    classes = join_groups(classes, lowest, ["_root"], spread_by="_node")
    classes = stored(
        classes.select("_node", F.coalesce("_lowest", "_first").alias("_class")), "near-classes"
    )
    answered = rows.join(classes, "_node", "left")
    best = F.coalesce("_class", first)
    return answered.select(
        "_id", "_fp", F.col("_n").alias("n_shingles"), best["_id"].alias("component_id"),
        (first == best).alias("kept"),
    )


def _links(narrow: DataFrame, rows: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs that connect all nodes which any chain of links connects, and no others."""
    stored = scratch.stored
    # One row stands for each distinct set.
    one = rows.filter("_node is not null").groupBy("_node")
    one = one.agg(F.min(F.struct("_id", "_fp", "_n")).alias("_row"), F.any_value("_bands").alias("_bands"))
    one = stored(one, "one")
    scratch.drop(rows)
    bands = one.select(F.explode("_bands").alias("_bucket"), "_node", F.col("_row._n").alias("_n"))
    # Most bands are alone in their bucket. They are shuffled as hash and count only.
    repeated = bands.groupBy("_bucket").count().filter("count > 1").select("_bucket")
    shared = stored(likely_rows(bands, stored(repeated, "repeated"), "_bucket"), "shared")
    # Buckets of the same nodes say the same; one of them is enough.
    buckets = shared.groupBy("_bucket").agg(
        F.count("*").alias("_m"),
        F.min(F.struct("_node", "_n")).alias("_first"),
        F.max("_node").alias("_last"),
        F.sum(F.shiftright(F.xxhash64("_node"), 24)).alias("_sum"),
    )
    buckets = buckets.filter("_m > 1").groupBy("_m", "_first", "_last", "_sum")
    buckets = buckets.agg(F.min("_bucket").alias("_bucket"))
    buckets = buckets.select("_bucket", "_m", F.col("_first._node").alias("_pivot"), F.col("_first._n").alias("_pivot_n"))
    buckets = stored(buckets, "buckets")
    if is_short(buckets, BROADCAST_ROWS):
        members = shared.join(F.broadcast(buckets), "_bucket")
    else:
        members = likely_rows(shared, buckets, "_bucket").join(buckets, "_bucket")
    members = stored(members, "members")
    scratch.drop(shared)

    wanted = members.select("_node").distinct().join(one.select("_node", "_row"), "_node")
    wanted = stored(wanted.select("_node", "_row._id", "_row._fp"), "wanted")
    scratch.drop(one)
    if is_short(wanted, BROADCAST_ROWS):
        chosen = narrow.join(F.broadcast(wanted), same(narrow, wanted, "_id", "_fp")).select("_node", "_text")
    else:
        chosen = listed_rows(narrow, wanted).select("_node", "_text")
    sets = stored(chosen.mapInArrow(_set_tables(words), "_node binary, _set array<long>"), "sets")
    if sets.count() > wanted.count():  # rows repeated with their key
        sets = stored(sets.dropDuplicates(["_node"]), "sets-once")

    # Each node with the first nodes of its buckets, where the sizes allow a link.
    allowed = F.least("_n", "_pivot_n") * 100 >= F.greatest("_n", "_pivot_n") * percent
    stars = members.filter(F.expr("_node != _pivot") & allowed).groupBy("_pivot", "_node")
    stars = stored(stars.agg(F.count("*").alias("_bands")), "stars")

    # First links: each node with the one that it shares most bands with.
    nearest = stars.groupBy("_node").agg(F.min(F.struct(-F.col("_bands"), "_pivot")).getField("_pivot").alias("_pivot"))
    nearest = stored(nearest.withColumn("_comp", F.col("_node")), "nearest")
    centres = nearest.select("_pivot").distinct().select(
        "_pivot", F.col("_pivot").alias("_node"), F.col("_pivot").alias("_comp")
    )
    first = stored(_blocks(centres, nearest, sets, "_pivot", percent, scratch), "first")
    # Each of these goes from a node to a smaller one. Two steps along them are label enough.
    up = first.select(F.greatest("a", "b").alias("_node"), F.least("a", "b").alias("_up")).distinct()
    up = _near(stored(up, "up"))
    top = up.select(F.col("_node").alias("_up"), F.col("_up").alias("_top"))
    roots = up.join(top, "_up", "left").select("_node", F.coalesce("_top", "_up").alias("_root"))
    roots = _near(stored(roots, "first-roots"))

    # Second links: with the others, but for those they are known to be connected with.
    at_pivot = roots.select(F.col("_node").alias("_pivot"), F.col("_root").alias("_pivot_root"))
    apart = stars.join(roots, "_node", "left").join(at_pivot, "_pivot", "left").select(
        "_pivot", "_node", F.coalesce("_root", "_node").alias("_comp"),
        F.coalesce("_pivot_root", "_pivot").alias("_pivot_comp"),
    )
    apart = stored(apart.filter("_comp != _pivot_comp"), "apart")
    centres = apart.select("_pivot", F.col("_pivot").alias("_node"), F.col("_pivot_comp").alias("_comp")).distinct()
    second = _blocks(centres, apart.drop("_pivot_comp"), sets, "_pivot", percent, scratch)
    first = first.unionByName(stored(second, "second"))
    roots = stored(components(first, scratch), "second-roots")
    # These say the same as the links so far, and are stars already.
    joined = roots.filter("_node != _root").select(F.col("_node").alias("a"), F.col("_root").alias("b"))

    # The rest: nodes beside the component of their bucket's first node.
    roots = _near(roots)
    at_pivot = roots.select(F.col("_node").alias("_pivot"), F.col("_root").alias("_pivot_root"))
    labelled = members.join(roots, "_node", "left").join(at_pivot, "_pivot", "left").select(
        "_bucket", "_m", "_node", "_n", "_pivot", F.coalesce("_root", "_node").alias("_comp"),
        F.coalesce("_pivot_root", "_pivot").alias("_main"),
    )
    labelled = stored(labelled, "labelled")
    # A bucket of two nodes has been settled by its first.
    lefts = labelled.filter("_m > 2 and _comp != _main and _node != _pivot")
    open_buckets = lefts.groupBy("_bucket").agg(F.min("_n").alias("_least"), F.max("_n").alias("_most"))
    open_buckets = stored(open_buckets, "open")
    if not open_buckets.count():
        return joined
    lefts = lefts.select("_bucket", "_pivot", "_node", "_comp")
    # Nodes that are too small or too large for each left node of their bucket link with none.
    near = (F.col("_n") * 100 >= F.col("_least") * percent) & (F.col("_most") * 100 >= F.col("_n") * percent)
    rights = labelled.join(_near(open_buckets), "_bucket").filter(near).select("_bucket", "_pivot", "_node", "_comp")
    rights = stored(rights, "rights")
    # A node shares many buckets with each of its likes. Its set goes to a group once.
    family = rights.select("_pivot", "_node").distinct().groupBy("_pivot").agg(F.count("*").alias("_nodes"))
    family = family.filter(F.col("_nodes") <= BLOCK).select("_pivot", F.lit(True).alias("_fits"))
    family = _near(stored(family, "families"))

    def grouped(side: DataFrame) -> DataFrame:
        group = F.when(F.col("_fits"), F.xxhash64(F.lit("family"), "_pivot")).otherwise(F.col("_bucket"))
        side = side.join(family, "_pivot", "left")
        return side.select(group.alias("_bucket"), "_node", "_comp").distinct()

    lefts, rights = stored(grouped(lefts), "left-groups"), stored(grouped(rights), "right-groups")
    return joined.unionByName(_blocks(lefts, rights, sets, "_bucket", percent, scratch))
