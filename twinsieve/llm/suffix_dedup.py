"""Passages that an earlier document has already, by sorting suffixes (operator 11).

Texts are their UTF-8 bytes. A byte is removed if a string of LENGTH bytes that covers it
also starts in a document with a smaller key. Strings are looked up in the input, so what is
removed from one document takes no part in what is removed from another.

A suffix takes part by its first LENGTH bytes, its window. There are as many windows as
bytes, and sorting each by itself would move fifty times the input. So suffixes that follow
each other travel together, and only those go that can have an equal:

1. Of documents with equal texts the first goes on; the others are removed whole.
2. The anchor of a window is the GRAM bytes in it with the lowest hash. Equal windows have
   equal anchors. Consecutive windows with the same anchor form a run, of 64 at most.
   Anchors that one text only has are dropped with their runs. They are counted in parts of
   their hashes, which tasks hand on packed.
3. Equal runs fall together, with their smallest key. What is left to compare are different
   runs with the same anchor.
4. Those are range-partitioned by the suffix at their anchor, its leading GRAM bytes, with
   sampled splitters. Each bucket sorts its windows by multikey quicksort, a symbol of eight
   bytes at a time, where only ties go on to the next symbol. Equal windows lie side by side.
5. An anchor with more than HOT_RUNS different runs is not gathered: its windows are
   suffixes of their own, split over buckets by window and key. Buckets then compare the
   windows at their boundaries. Which anchors are is told by a bitmap, so a few others may
   go the same way; both ways give the same.

All comparisons are of the bytes themselves, but for equality of whole runs (128 bits).
Windows never cross documents, long texts are read in slices, and no case is left out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import Scratch, _filtered, bitmap, keyed, likely_rows, same, stored, unlisted_rows
from twinsieve.llm.textbatch import _byte_values, _power_tables, mix
from twinsieve.operators.groups import join_groups

LENGTH = 50
GRAM = 24
GRAMS = LENGTH - GRAM + 1  # in a window
RUN = 64  # windows of a run at most: one bit each
SLICE = 1 << 18
# An anchor with more different runs than this is split.
HOT_RUNS = 4096
# Windows that are sorted at once, but for the rest of an anchor's.
SORTED_AT_ONCE = 1 << 17
# Runs that a task combines before it hands them on.
COMBINED_ROWS = 1 << 17
# Runs whose bytes are hashed or copied at once.
RUNS_AT_ONCE = 1 << 12
# Powers that are kept for hashes: for a slice, or the bytes of so many runs.
POWERS = max(SLICE + LENGTH, RUNS_AT_ONCE * (RUN + LENGTH))
LAST = (1 << 63) - 1  # stands for a null key
_U = np.uint64


class Hashes:
    """Hashes of any spans of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _power_tables(len(raw) + 1, POWERS)
        values = _byte_values()
        zero = np.zeros(1, np.uint64)
        sums = lambda v: np.concatenate((zero, np.cumsum(v[raw] * self.up[:-1], dtype=np.uint64)))
        self.one, self.raw = sums(values), raw
        self.two = None

    def grams(self, size: int) -> np.ndarray:
        n = len(self.raw) - size + 1
        return mix((self.one[size:] - self.one[:-size]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two independent hashes of 62 bits each."""
        if self.two is None:
            values = mix(_byte_values() + _U(0x2545F4914F6CDD1D))
            self.two = np.concatenate(
                (np.zeros(1, np.uint64), np.cumsum(values[self.raw] * self.up[:-1], dtype=np.uint64))
            )
        size = (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        return [
            (mix((total[end] - total[start]) * self.down[start] + size) >> _U(2)).view(np.int64)
            for total in (self.one, self.two)
        ]


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(texts: pa.Array, length: int = LENGTH):
    """Runs of windows, slice by slice: (row, start in its text, windows, anchor, place, part).

    `place` is where the run starts in `part`, the hashed bytes of the slice."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return
    edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)
    for low in range(int(edge[0]), int(edge[-1]), SLICE):
        part = raw[low : min(low + SLICE + length - 1, int(edge[-1]))]
        n = len(part) - length + 1
        if n <= 0:
            continue
        # Windows that would run over the end of a text.
        ends = edge[(edge > low) & (edge < low + len(part))] - low
        over = np.zeros(n + 1, np.int64)
        np.add.at(over, np.clip(ends - length + 1, 0, n), 1)
        np.add.at(over, np.clip(ends, 0, n), -1)
        at = np.flatnonzero(np.cumsum(over[:-1]) == 0)
        if not len(at):
            continue
        hashes = Hashes(part)
        anchors = lowest(hashes.grams(GRAM), length - GRAM + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchors[1:] != anchors[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        if size.max() > RUN:
            first = np.flatnonzero((np.arange(len(at)) - np.repeat(first, size)) % RUN == 0)
            size = np.diff(np.append(first, len(at)))
        place = at[first]
        row = np.searchsorted(edge, low + place, "right") - 1
        anchor = (anchors[first] >> _U(16)).view(np.int64)
        yield row, low + place - edge[row], size, anchor, place, hashes


# Anchors that a task gathers before it deals them over so many parts.
DEALT_ANCHORS = 1 << 19
ANCHOR_PARTS = 4096
# Rows of dealt anchors, some 128 each, that are counted at once.
COUNTED_ROWS = 1 << 12


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of the texts, once per text and slice but at most twice, by part: hash modulo
    ANCHOR_PARTS. As packed integers, since a row for each would cost more than its count."""
    held: list[np.ndarray] = []
    size = 0

    def dealt() -> pa.RecordBatch:
        anchors = np.concatenate(held)
        held.clear()
        part = (anchors % ANCHOR_PARTS).astype(np.uint16)
        counts = np.bincount(part, minlength=ANCHOR_PARTS)
        some = np.flatnonzero(counts)
        edge = np.concatenate(([0], np.cumsum(counts[some]) * 8)).astype(np.int32)
        packed = pa.py_buffer(anchors[np.argsort(part, kind="stable")])
        packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(edge), packed])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed], ["_part", "_packed"])

    for batch in batches:
        for row, _, _, anchor, _, _ in runs(batch["_text"]):
            # 48 bits of hash, and which of the slice's texts: each has LENGTH bytes or more there.
            text = np.cumsum(np.concatenate(([False], row[1:] != row[:-1])), dtype=np.uint64)
            keys = np.sort((anchor.view(np.uint64) << _U(16)) | text)
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] >> _U(16)
            third = np.zeros(len(keys), bool)
            third[2:] = keys[2:] == keys[:-2]
            held.append(keys[~third].view(np.int64))
            size += len(held[-1])
        if size > DEALT_ANCHORS:
            yield dealt()
            size = 0
    if held:
        yield dealt()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors that are there twice or more; parts come whole, one after the other."""
    for table in _whole_groups(batches, "_part", COUNTED_ROWS):
        packed = _bytes_of(table["_packed"].combine_chunks())[0].view(np.int64)
        packed = np.sort(packed)
        again = packed[1:][packed[1:] == packed[:-1]]
        once = again[np.concatenate(([True], again[1:] != again[:-1]))] if len(again) else again
        yield pa.RecordBatch.from_arrays([pa.array(once)], ["_anchor"])


def _slices(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Spans of bytes as a binary column."""
    edge = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    data = np.empty(edge[-1], np.uint8)
    for i in range(0, len(start), RUNS_AT_ONCE):
        some = slice(i, i + RUNS_AT_ONCE)
        low, high = edge[i], edge[min(i + RUNS_AT_ONCE, len(start))]
        data[low:high] = raw[np.repeat(start[some] - edge[:-1][some], size[some]) + np.arange(low, high)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(data)])


RUN_COLUMNS = ["_id", "_fp", "_ord", "_start", "_n", "_anchor", "_h1", "_h2", "_bytes"]


def _runs(listed: Broadcast):
    """The runs, but for those whose anchor the bitmap `listed` doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listing = np.frombuffer(listed.value, np.uint8)
        for batch in batches:
            for row, start, size, anchor, place, hashes in runs(batch["_text"]):
                bit = anchor % (8 * len(listing))
                some = np.flatnonzero((listing[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if not len(some):
                    continue
                row, start, size, anchor, place = (x[some] for x in (row, start, size, anchor, place))
                one, two = hashes.spans(place, place + size + LENGTH - 1)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c].take(take) for c in RUN_COLUMNS[:3]], pa.array(start), pa.array(size.astype(np.int32)),
                     pa.array(anchor), pa.array(one), pa.array(two), _slices(hashes.raw, place, size + LENGTH - 1)],
                    RUN_COLUMNS,
                )

    return run


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each value starts and ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edge[0] : edge[-1]], edge - edge[0]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal runs of a task's batches as one, with the smallest key: map-side combine."""
    held: list[pa.RecordBatch] = []
    size = 0

    def merged() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        held.clear()
        one, two, low = (np.asarray(table[c]) for c in ("_h1", "_h2", "_lo"))
        order = np.lexsort((low, two, one))
        a, b = one[order], two[order]
        first = order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))]
        return table.take(pa.array(first)).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size > COMBINED_ROWS:
            yield merged()
            size = 0
    if held:
        yield merged()


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the leading bytes of the suffix at each run's anchor."""
    for batch in batches:
        for i in range(0, batch.num_rows, RUNS_AT_ONCE):
            part = batch.slice(i, RUNS_AT_ONCE)
            raw, edge = _bytes_of(part["_bytes"])
            if not len(edge) - 1:
                continue
            grams = Hashes(raw).grams(GRAM)
            at = edge[:-1] + grams[edge[:-1, None] + np.arange(GRAMS)].argmin(1)
            lead = _slices(raw, at, np.full(len(at), GRAM))
            yield pa.RecordBatch.from_arrays([*part.columns, lead], [*part.schema.names, "_lead"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both steps in one Python worker, not one each."""
    return _leading(_once(batches))


def multikey(group: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and symbols, and the class of equal rows at each place.

    A symbol is one column. Rows that a symbol tells apart are done with; ties alone are
    sorted by the next one.
    """
    order = np.argsort(group, kind="stable")
    cls = np.cumsum(np.concatenate(([0], group[order][1:] != group[order][:-1])))
    for column in symbols.T:
        many = np.bincount(cls)[cls] > 1
        tied = np.flatnonzero(many)
        if not len(tied):
            break
        rows = order[tied]
        by = np.lexsort((column[rows], cls[tied]))
        order[tied] = rows = rows[by]
        # The class of a place stays; a new symbol inside it starts a new one.
        step = np.zeros(len(order), np.int64)
        step[1:] = cls[1:] != cls[:-1]
        value = column[rows]
        beside = (tied[1:] == tied[:-1] + 1) & (cls[tied][1:] == cls[tied][:-1])
        step[tied[1:]] |= beside & (value[1:] != value[:-1])
        cls = np.cumsum(step)
    return order, cls


def _symbols(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each start as symbols of eight bytes, in byte order."""
    wide = -(-LENGTH // 8) * 8
    out = np.zeros((len(start), wide), np.uint8)
    # A view, since an index of each byte would take eight times the bytes.
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[start]
    return out.view(">u8")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """The batches again, cut where the key changes; a few groups at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key]
        if size >= most:
            lead = held[-1][key][-1].as_py()
            same = 0
            while same < len(values) and values[same].as_py() == lead:
                same += 1
            if same < len(values):
                yield pa.Table.from_batches([*held, batch.slice(0, same)])
                held, size, batch = [], 0, batch.slice(same)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _smallest(table: pa.Table) -> pa.Table:
    """Of equal runs, which different tasks may have handed on, the one with the smallest
    key, in the order of the table."""
    one, two, low = (np.asarray(table[c].chunk(0)) for c in ("_h1", "_h2", "_lo"))
    order = np.lexsort((low, two, one))
    a, b = one[order], two[order]
    first = np.sort(order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))])
    return table.take(pa.array(first)).combine_chunks() if len(first) < len(one) else table


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run, which windows a smaller key has too; runs come sorted by `_lead`."""
    for table in _whole_groups(batches, "_lead", SORTED_AT_ONCE // 16):
        table = table.combine_chunks()
        table = _smallest(table)
        raw, edge = _bytes_of(table["_bytes"].chunk(0))
        lead, ends = _bytes_of(table["_lead"].chunk(0))
        lead = lead.reshape(-1, GRAM).view(">u8")
        new = np.concatenate(([True], (lead[1:] != lead[:-1]).any(1)))
        group, low = np.cumsum(new), np.asarray(table["_lo"])
        windows = np.diff(edge) - LENGTH + 1
        run = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, cls = multikey(group[run], _symbols(raw, edge[:-1][run] + offset))
        lows = low[run[order]]
        least = np.minimum.reduceat(lows, np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))))
        hit = order[least[cls] < lows]
        mask = np.zeros(len(windows), np.uint64)
        np.bitwise_or.at(mask, run[hit], _U(1) << offset[hit].astype(np.uint64))
        some = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays(
            [table["_h1"].chunk(0).take(pa.array(some)), table["_h2"].chunk(0).take(pa.array(some)),
             pa.array(mask[some].view(np.int64))],
            ["_h1", "_h2", "_mask"],
        )


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a run as a suffix of its own."""
    for batch in batches:
        for i in range(0, batch.num_rows, RUNS_AT_ONCE):
            part = batch.slice(i, RUNS_AT_ONCE)
            raw, edge = _bytes_of(part["_bytes"])
            windows = np.diff(edge) - LENGTH + 1
            run = np.repeat(np.arange(len(windows)), windows)
            offset = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
            take = pa.array(run)
            yield pa.RecordBatch.from_arrays(
                [part["_h1"].take(take), part["_h2"].take(take), part["_lo"].take(take),
                 pa.array(offset.astype(np.int32)),
                 _slices(raw, edge[:-1][run] + offset, np.full(len(run), LENGTH))],
                ["_h1", "_h2", "_lo", "_offset", "_window"],
            )


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of (window, key): each with the smallest key the bucket has for it.

    `_edge` is the window itself where it is the bucket's first or last, so that the
    neighbouring buckets may hold it too.
    """
    first = last = None
    least = 0
    held: list[pa.RecordBatch] = []

    def out(table: pa.RecordBatch, low: np.ndarray, edge: bool) -> pa.RecordBatch:
        names = ["_h1", "_h2", "_lo", "_offset"]
        window = table["_window"] if edge else pa.nulls(table.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays(
            [*[table[c] for c in names], pa.array(low), window], [*names, "_least", "_edge"]
        )

    def flush(is_last: bool) -> Iterator[pa.RecordBatch]:
        # Only rows of the last window are held back.
        for table in held:
            yield out(table, np.full(table.num_rows, least), is_last or last == first)
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        raw, edge = _bytes_of(batch["_window"])
        order, cls = multikey(np.zeros(batch.num_rows, np.int64), _symbols(raw, edge[:-1]))
        # They come sorted; the sort by symbols tells where a window ends.
        place = np.empty_like(cls)
        place[order] = cls
        batch, place = batch.take(pa.array(np.argsort(place, kind="stable"))), np.sort(place)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sizes = np.diff(np.append(starts, len(place)))
        lows = np.minimum.reduceat(np.asarray(batch["_lo"]), starts)
        window = batch["_window"][0].as_py()
        if window != last:
            yield from flush(False)
            first = window if first is None else first
            last, least = window, int(lows[0])
        least = min(least, int(lows[0]))
        held.append(batch.slice(0, sizes[0]))
        if len(starts) > 1:
            yield from flush(False)
            # Windows that begin and end in the batch.
            inner = batch.slice(sizes[0], starts[-1] - sizes[0])
            if inner.num_rows:
                yield out(inner, np.repeat(lows[1:-1], sizes[1:-1]), False)
            last, least = batch["_window"][starts[-1]].as_py(), int(lows[-1])
            held.append(batch.slice(starts[-1]))
    if held:
        yield from flush(True)


def _hot_masks(hot: DataFrame) -> DataFrame:
    """As `_compared`, for runs whose anchor many different runs share."""
    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = hot.mapInArrow(_single_windows, "_h1 long, _h2 long, _lo long, _offset int, _window binary")
    dealt = suffixes.repartitionByRange(parts, "_window", "_lo", F.xxhash64("_h1", "_offset"))
    dealt = dealt.sortWithinPartitions("_window", "_lo")
    found = dealt.mapInArrow(_bucket, "_h1 long, _h2 long, _lo long, _offset int, _least long, _edge binary")
    found = stored(found, "suffix-buckets")
    # At most two windows of each bucket.
    edges = found.filter("_edge is not null").groupBy("_edge").agg(F.min("_least").alias("_edge_least"))
    found = found.join(F.broadcast(edges), "_edge", "left")
    hit = found.filter(F.coalesce("_edge_least", "_least") < F.col("_lo"))
    bit = F.expr("shiftleft(1L, _offset)")
    return hit.groupBy("_h1", "_h2").agg(F.bit_or(bit).alias("_mask"))


SPANS = "array<struct<start:long,end:long>>"


# Bytes of texts that are cut at once, but for a longer text.
CUT_BYTES = 1 << 20


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the flagged windows out of each text, or the whole text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.set_column(
            batch.schema.get_field_index("_text"), "_text", batch["_text"].cast(pa.large_binary()).fill_null(b"")
        )
        ends, low = _bytes_of(batch["_text"])[1][1:], 0
        while low < batch.num_rows:
            most = CUT_BYTES + (ends[low - 1] if low else 0)
            part = batch.slice(low, max(1, int(np.searchsorted(ends, most, "right")) - low))
            low += part.num_rows
            yield _cut_texts(part)


def _cut_texts(part: pa.RecordBatch) -> pa.RecordBatch:
    raw, edge = _bytes_of(part["_text"])
    n, rows = len(raw), part.num_rows
    counts = np.asarray(part["_windows"].value_lengths().fill_null(0))
    windows = part["_windows"].flatten()
    size = np.asarray(windows.field("_n")).astype(np.int64)
    bits = np.asarray(windows.field("_bits")).view(np.uint64)
    start = np.asarray(windows.field("_start")) + np.repeat(edge[:-1], counts)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    hit = (np.repeat(bits, size) >> offset.astype(np.uint64)) & _U(1) != 0
    at = (np.repeat(start, size) + offset)[hit]
    whole = np.asarray(part["_later"].cast(pa.uint8())) != 0
    step = np.bincount(np.concatenate((at, edge[:-1][whole])), minlength=n + 1)
    step -= np.bincount(np.concatenate((at + LENGTH, edge[1:][whole])), minlength=n + 1)
    gone = np.zeros(n + 2, bool)  # and one byte that stays on either side
    gone[1:-1] = np.cumsum(step[:-1]) > 0
    bound = np.zeros(n + 1, bool)
    bound[edge] = True
    # A span ends with its text, even if the next one begins with another.
    starts = np.flatnonzero(gone[1:] & (bound | ~gone[:-1]))
    ends = np.flatnonzero(gone[:-1] & (bound | ~gone[1:]))
    row = np.searchsorted(edge, starts, "right") - 1
    stay = ~gone[1:-1]
    kept_edge = np.concatenate(([0], np.cumsum(stay)))[edge].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(kept_edge), pa.py_buffer(raw[stay])])
    span_edge = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    spans = [pa.array(x - edge[row]) for x in (starts, ends)]
    spans = pa.ListArray.from_arrays(pa.array(span_edge), pa.StructArray.from_arrays(spans, ["start", "end"]))
    return pa.RecordBatch.from_arrays(
        [part["_id"], part["_fp"], pa.array(np.diff(edge)), kept, spans],
        ["_id", "_fp", "n_bytes", "kept", "removed"],
    )


def _later_copies(docs: DataFrame) -> DataFrame:
    """(_id, _fp) of rows whose whole text a smaller key has."""
    names = docs.filter(F.octet_length("_text") >= LENGTH)
    names = names.select("_id", "_fp", "_ord", F.md5(F.col("_text").cast("binary")).alias("_name"))
    groups = names.groupBy("_name").agg(F.count("*").alias("n"), F.min("_ord").alias("_first"))
    groups = stored(groups.filter("n > 1"), "suffix-copies")
    found = join_groups(names, groups, ["_name"], how="inner", spread_by="_id")
    return stored(found.filter("_ord > _first").select("_id", "_fp").distinct(), "suffix-later")


def _flagged(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, _fp, _windows): the windows of each text that a smaller key has too."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = docs.mapInArrow(_anchors, "_part int, _packed binary")
    anchors = anchors.repartition(parts, "_part").sortWithinPartitions("_part")
    repeated = scratch.stored(anchors.mapInArrow(_repeated, "_anchor long"), "repeated")
    kind = docs.schema["_id"].dataType.simpleString()
    columns = (
        f"_id {kind}, _fp long, _ord long, _start long, _n int, _anchor long, _h1 long, _h2 long, _bytes binary"
    )
    # Looked up before a run's hashes and bytes are made and handed on: most anchors occur once.
    listed = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, "_anchor"))
    found = scratch.stored(docs.mapInArrow(_runs(listed), columns), "runs")
    listed.destroy()

    # Equal runs as one, with the smallest and the largest key.
    sets = found.groupBy("_anchor", "_h1", "_h2").agg(
        F.count("*").alias("n"), F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi")
    )
    sets = scratch.stored(sets, "sets")
    shared = sets.groupBy("_anchor").agg(
        F.count("*").alias("_runs"), F.min("_lo").alias("_least"), F.max("_hi").alias("_most")
    )
    shared = scratch.stored(shared.filter("_runs > 1 and _least < _most").select("_anchor", "_runs"), "shared")
    differ = found.select("_anchor", "_h1", "_h2", F.col("_ord").alias("_lo"), "_bytes")
    differ = likely_rows(differ, shared, "_anchor")
    rows = "_anchor long, _h1 long, _h2 long, _lo long, _bytes binary"
    hot = scratch.stored(shared.filter(F.col("_runs") > HOT_RUNS).select("_anchor"), "hot")
    differ = differ.mapInArrow(_combined, f"{rows}, _lead binary")
    differ = scratch.stored(_filtered(differ, hot, "_anchor"), "differing")

    cold = differ.filter("not _maybe").select("_h1", "_h2", "_lo", "_bytes", "_lead")
    cold = cold.repartitionByRange(parts, "_lead").sortWithinPartitions("_lead")
    masks = cold.mapInArrow(_compared, "_h1 long, _h2 long, _mask long")
    if not hot.isEmpty():
        split = differ.filter("_maybe").groupBy("_h1", "_h2", "_bytes").agg(F.min("_lo").alias("_lo"))
        masks = masks.unionByName(_hot_masks(split))

    # Where all equal runs have one key, that key isn't needed to tell what is later.
    answers = sets.filter("_hi > _lo").select("_h1", "_h2", "n", "_lo", F.lit(0).cast("long").alias("_mask"))
    alone = masks.select("_h1", "_h2", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("_lo"), "_mask")
    answers = answers.unionByName(alone).groupBy("_h1", "_h2")
    answers = answers.agg(F.sum("n").alias("n"), F.min("_lo").alias("_lo"), F.bit_or("_mask").alias("_mask"))
    answers = scratch.stored(answers, "answers")
    marked = likely_rows(found.drop("_bytes", "_anchor"), answers, "_h1")
    marked = join_groups(marked, answers, ["_h1", "_h2"], how="inner", spread_by="_start")
    bits = F.when(F.col("_ord") > F.col("_lo"), F.lit(-1).cast("long")).otherwise(F.col("_mask"))
    marked = marked.withColumn("_bits", bits).filter("_bits != 0")
    return marked.groupBy("_id", "_fp").agg(
        F.collect_list(F.struct("_start", "_n", "_bits")).alias("_windows")
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _fp, n_bytes, kept, removed) for every row; _fp is the text's hash.

    `kept` are the bytes that stay, `removed` the maximal spans taken out (byte offsets, end
    exclusive). Keys are whole numbers; a null key comes after all others. Rows with equal
    keys don't remove each other's text; a repeated row gets the same answer each time. A null
    text is empty, a text of less than LENGTH bytes stays whole. Other columns take no part.
    """
    rows = keyed(docs, key, text)
    rows = rows.select("_id", "_fp", "_text", F.coalesce(F.col("_id").cast("long"), F.lit(LAST)).alias("_ord"))
    later = _later_copies(rows)
    first = unlisted_rows(rows, later) if later.count() else rows
    with Scratch(docs.sparkSession, "suffixes") as scratch:
        found = stored(_flagged(first, scratch), "suffix-windows")
    none = F.lit(None).cast(found.schema["_windows"].dataType)
    answered = found.withColumn("_later", F.lit(False)).unionByName(
        later.withColumns({"_windows": none, "_later": F.lit(True)})
    )
    answered = stored(answered, "suffix-answered")
    marked = _filtered(rows.select("_id", "_fp", "_text"), answered)
    near = marked.filter("_maybe").drop("_maybe")
    near = near.join(answered, same(near, answered, "_id", "_fp"), "left").select(
        *[near[c] for c in near.columns], "_windows", F.coalesce("_later", F.lit(False)).alias("_later")
    )
    kind = rows.schema["_id"].dataType.simpleString()
    cut = near.mapInArrow(_cut, f"_id {kind}, _fp long, n_bytes long, kept binary, removed {SPANS}")
    rest = marked.filter("not _maybe").select(
        "_id",
        "_fp",
        F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.col("_text").cast("binary"), F.lit(b"")).alias("kept"),
        F.array().cast(SPANS).alias("removed"),
    )
    return rest.unionByName(cut)
