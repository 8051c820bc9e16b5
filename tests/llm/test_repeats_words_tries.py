"""Operators 11 to 13 against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import prefix_trie, queries, spelling_variants, suffix_dedup
from twinsieve.llm.columns import _filtered, bitmap, stored
from twinsieve.llm.prefix_trie import as_paths, conversations, rebuilt
from twinsieve.llm.spelling_variants import document_words
from twinsieve.llm.suffix_dedup import remove_repeats


def bag(df):
    return Counter(map(tuple, df.collect()))


# ---------------------------------------------------------------- 11 repeats

LENGTH = suffix_dedup.LENGTH


def plain_repeats(rows):
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - LENGTH + 1):
            s = raw[i : i + LENGTH]
            if s not in first or order(d) < first[s]:
                first[s] = order(d)
    out = Counter()
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            if first[raw[i : i + LENGTH]] < order(d):
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone)))
        out[d, len(raw), kept, spans] += 1
    return out


def removed(df):
    return Counter(
        (r["_id"], r["n_bytes"], bytes(r["kept"]), tuple((s["start"], s["end"]) for s in r["removed"]))
        for r in df.collect()
    )


@pytest.fixture(params=["cold", "hot"])
def anchors(request, monkeypatch):
    """Anchors with more than one run as hot ones, or none."""
    if request.param == "hot":
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 1)


def test_odd_texts_keep_what_no_earlier_document_has(spark, docs, anchors):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert removed(remove_repeats(docs)) == plain_repeats(rows)


def test_no_documents_no_repeats(none):
    assert remove_repeats(none).count() == 0


def test_repeats_of_overlapping_passages(spark, anchors):
    passage = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    lines = "a line that all documents have, whatever else they say here\n"
    rows = [
        (9, "before " + passage + " after"),
        (3, passage[:80] + "é" * 40 + passage[60:]),
        (4, passage[:49]),
        (5, passage[:50] + "!"),
        (6, "ab" * 500 + "tail"),
        (7, "x" + "ab" * 700),
        (8, "ab" * 500 + "tail"),
        (2, "Z" * 200),
        (1, "Z" * 49 + "y"),
        (1, "Z" * 300),
    ]
    rows += [(20 + i, f"{i} left\n{lines}right {i}" + "word " * i) for i in range(12)]
    got = removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_repeats(rows)


def test_runs_of_unlisted_anchors_are_not_handed_on():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    columns = [[1], [2], [3], ["".join(chr(97 + i * i % 26) + str(i) for i in range(90))]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_id", "_fp", "_ord", "_text"])
    bits = np.full(1 << 10, 255, np.uint8)
    rows = lambda: [r for b in suffix_dedup._runs(SimpleNamespace(value=bits.tobytes()))([batch]) for r in b.to_pylist()]
    every = rows()
    assert sum(r["_n"] for r in every) == len(columns[3][0]) - LENGTH + 1
    one = every[1]["_anchor"]
    bits[:] = 0
    assert rows() == []
    at = one % (8 * len(bits))
    bits[at >> 3] = 1 << (at & 7)
    assert rows() == [r for r in every if r["_anchor"] % (8 * len(bits)) == at] != []


def test_anchors_are_counted_from_packed_parts(monkeypatch):
    texts = [" ".join(f"w{i * j % 1009}" for i in range(80)) for j in range(1, 200)] + ["short", "x" * 300, "x" * 300]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50])], ["_text"]) for i in range(0, len(texts), 50)]
    every = Counter(a for b in batches for r, a in {(r, a) for x in suffix_dedup.runs(b["_text"]) for r, a in zip(x[0], x[3])})  # noqa: E501
    for most in (1 << 19, 1):
        monkeypatch.setattr(suffix_dedup, "DEALT_ANCHORS", most)
        dealt = list(suffix_dedup._anchors(iter(batches)))
        assert len(dealt) == (1 if most > 1 else len(batches))
        # A row for a part, not one for an anchor.
        assert all(len(b["_part"].unique()) == b.num_rows <= suffix_dedup.ANCHOR_PARTS for b in dealt)
        for many in (1 << 12, 1):
            monkeypatch.setattr(suffix_dedup, "COUNTED_ROWS", many)
            rows = pa.Table.from_batches(dealt).sort_by("_part").to_batches(max_chunksize=100)
            found = [a for b in suffix_dedup._repeated(iter(rows)) for a in b["_anchor"].to_pylist()]
            assert sorted(found) == sorted(a for a, n in every.items() if n > 1) != []


def test_windows_of_a_bucket_are_not_handed_on_one_by_one():
    rows = [(bytes([97 + w // 9, 97 + w % 9]) * 25, lo) for w in range(60) for lo in range(w % 4 * 7 % 5 + 1)]
    rows[40:40] = [(rows[40][0], 3)] * 90  # in several batches
    rows.sort()
    least, names = dict(reversed(rows)), ["_h1", "_h2", "_lo", "_offset", "_window"]
    for size in (1, 25, len(rows)):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        count = lambda p: pa.array(range(len(p)))
        batches = [
            pa.RecordBatch.from_arrays(
                [count(p), count(p), pa.array([x[1] for x in p]), count(p).cast("int32"), pa.array([x[0] for x in p])],
                names,
            )
            for p in parts
        ]
        out = list(suffix_dedup._bucket(iter(batches)))
        assert len(out) <= 3 * len(batches)
        got = [(r["_lo"], r["_least"], r["_edge"]) for b in out for r in b.to_pylist()]
        ends = (rows[0][0], rows[-1][0])
        assert got == [(lo, least[w], w if w in ends else None) for w, lo in rows]


def test_texts_cut_together_keep_their_own_spans(monkeypatch):
    row = lambda text, windows=None, later=False: (0, 0, text, windows, later)
    run = lambda start, n, bits: {"_start": start, "_n": n, "_bits": bits}
    a, b = "a" * 60, "é" * 40 + "b" * 20
    rows = [row(None), row(a, None, True), row(a, [run(0, 11, 1)]), row(""), row(b, [run(30, 21, -1), run(0, 2, 2)]),
            row(b, None, True), row("tail"), row(b, [run(0, 51, -1)])]
    kind = pa.list_(pa.struct([("_start", pa.int64()), ("_n", pa.int32()), ("_bits", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), kind, pa.bool_()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    batch = pa.RecordBatch.from_arrays(columns, ["_id", "_fp", "_text", "_windows", "_later"])
    spans = [[], [(0, 60)], [(0, 50)], [], [(1, 100)], [(0, 100)], [], [(0, 100)]]
    for most in (1 << 20, 150, 1):
        monkeypatch.setattr(suffix_dedup, "CUT_BYTES", most)
        for part in (batch, batch.slice(2)):
            got = [r for x in suffix_dedup._cut(iter([part])) for r in x.to_pylist()]
            raws = [(t or "").encode() for t in part["_text"].to_pylist()]
            want = spans[len(rows) - part.num_rows :]
            assert [[(s["start"], s["end"]) for s in r["removed"]] for r in got] == want
            stays = lambda raw, gone: bytes(x for i, x in enumerate(raw) if not any(p <= i < q for p, q in gone))
            assert [r["kept"] for r in got] == [stays(*x) for x in zip(raws, want)]
            assert [r["n_bytes"] for r in got] == [len(x) for x in raws]


def test_bitmap_has_what_the_filter_has(spark):
    rows = spark.range(2000).select(F.abs(F.xxhash64("id")).alias("_fp"))
    listed = stored(rows.limit(100), "listed")
    raw = np.frombuffer(bitmap(listed, "_fp"), np.uint8)
    for r in _filtered(rows, listed).collect():
        at = r._fp % (8 * len(raw))
        assert bool(raw[at >> 3] >> (at & 7) & 1) == r._maybe


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 256)
    words = " ".join(f"w{i * 7919 % 1009}" for i in range(600))
    rows = [(1, words), (2, "shifted " + words), (3, words[:1000] + "#" + words[1000:])]
    got = removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_repeats(rows)


def test_repeats_of_the_small_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.documents(spark, sf_dir).collect()]
    want = Counter()
    for (d, size, kept, spans), n in plain_repeats(rows).items():
        want[d, size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest()] += n
    assert bag(queries.repeats(spark, sf_dir)) == want


def test_multikey_order_is_that_of_the_bytes():
    import numpy as np

    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    group = rng.integers(0, 4, 500)
    order, cls = suffix_dedup.multikey(group, symbols)
    keys = [(group[i], *symbols[i]) for i in order]
    assert keys == sorted(keys)
    assert [len(set(keys[: i + 1])) - 1 for i in range(500)] == list(cls)


# ---------------------------------------------------------- 12 spelling variants


def plain_words(rows):
    seen = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = Counter()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None] += 1
    return out


def test_variants_of_words_with_runs_ties_and_chains(spark):
    counts = {
        "aabbccdd": 2, "abbccdd": 30, "aabbccd": 30, "aaabbccdd": 400, "aabbcxdd": 2, "aabbcydd": 2,
        "bookkeeper": 3, "bokkeeper": 2, "bookeeper": 50, "bookkeepers": 700, "bookkeepexs": 70,
        "éàüöäßñ": 5, "éàüöäßn": 60, "alone lit": 9, "zzzzzzz": 2, "zzzzzzzz": 20, "zzzzzzzzz": 200, "zzzzzzzzzz": 2000,
    }
    got = spelling_variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert bag(got) == plain_variants(counts)


def test_no_words_no_variants(spark, none):
    assert spelling_variants.spelling_variants(document_words(none)).count() == 0


def test_words_of_odd_documents(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows += [(i, "Rückwärts FOOTBALL football× Ünterricht einundzwanzigste") for i in range(100, 180)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(document_words(frame).collect()) == plain_words(rows)


def test_variants_of_the_small_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.documents(spark, sf_dir).collect()]
    assert bag(queries.variants(spark, sf_dir)) == plain_variants(plain_words(rows))


# -------------------------------------------------------- 13 conversation prefixes


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    saved, leaves, children = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        tokens = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += tokens
            leaves[node[:d]] += not children[node]
    out = Counter()
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out[min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


TURNS = "conv_id long, turn long, role string, text string"


def trie_of(spark, rows, shards):
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(c) for c in ("_turn", "_path", "node")})
    return bag(prefix_trie.prefix_trie(as_paths(rebuilt(conversations(turns))), shards))


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_tries_of_shared_and_odd_conversations(spark, shards):
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} of kind {c % 3 if t > 2 else 0}") for c in range(90) for t in range(c % 6)]
    rows += [(200 + c, t, "user", f"the same words {t}") for c in range(60) for t in range(3)]
    rows += [(400, None, None, "first of all"), (400, 1, "a", None), (400, 2, None, None), (None, 1, "a", "lost")]
    rows += [(421, t, "u", "only one") for t in range(2)] + [(440, 0, "ab", "c"), (460, 0, "a", "bc")]
    rows += [(500, t, "deep", f"down {t // 2}") for t in range(300)] + [(480, t, "deep", f"down {t // 2}") for t in range(290)]
    assert trie_of(spark, rows, shards) == plain_trie(rows)


def test_no_conversations_no_trie(spark):
    assert trie_of(spark, [], 4) == Counter()


def test_pieces_of_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = [(20 * c, 0, "user", "hello there") for c in range(120)]
    assert trie_of(spark, rows, 5) == plain_trie(rows)


def test_trie_of_the_small_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert bag(queries.trie(spark, sf_dir)) == plain_trie(rows)


def test_steps_on_runs_take_memory_by_their_bytes():
    import tracemalloc

    import numpy as np

    def peak(work):
        tracemalloc.start()
        done = work()
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, done

    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 200_000).astype(np.uint8)
    start = rng.integers(0, len(raw) - 200, 100_000)
    size = rng.integers(0, 114, len(start))
    top, symbols = peak(lambda: suffix_dedup._symbols(raw, start))
    assert top < 3 * symbols.nbytes
    want = [raw[a : a + LENGTH].tobytes() for a in start[:500]]
    assert [x.tobytes()[:LENGTH] for x in symbols[:500]] == want
    top, spans = peak(lambda: suffix_dedup._slices(raw, start, size))
    assert top < 3 * size.sum()
    assert spans.to_pylist() == [raw[a : a + n].tobytes() for a, n in zip(start, size)]
    none = np.zeros(0, np.int64)
    assert len(suffix_dedup._slices(raw, none, none)) == 0


def test_the_filter_keeps_listed_rows_and_few_others(spark):
    from twinsieve.llm.columns import _filtered, stored

    hashes = spark.range(40_000).select(F.xxhash64("id").alias("_fp"), "id")
    edges = spark.createDataFrame([(v, -1) for v in (0, 1, 7, 8, 31, 32, 63, 32767, 32768, -1, -(2**63))], "_fp long, id long")
    rows = hashes.unionByName(edges)
    listed = stored(rows.filter("id % 4 = 0 or id = -1").select("_fp"), "listed")
    marked = _filtered(rows.unionByName(spark.createDataFrame([(None, -2)], "_fp long, id long")), listed)
    found = {(r._maybe, r.kind): r["count"] for r in marked.withColumn("kind", F.expr("case when id = -2 then 'null' when id % 4 = 0 or id = -1 then 'listed' else 'other' end")).groupBy("_maybe", "kind").count().collect()}
    assert found[True, "listed"] == 10_011 and (False, "listed") not in found
    assert found[True, "other"] < 1_000 and found[False, "null"] == 1
    # A row is looked up without making text of the bitmap.
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "hex(" not in plan
