"""Spelling variants by permuterm rotations (operator 12).

Words that differ by one inserted, deleted or replaced character are near each other. A
near word of at least RATIO times the occurrences is a word's form, its likely spelling.

All rotations of `word$` are sorted. In a rotation that ends in the character at one place,
the rest of it is a prefix that all words share which differ at that place only: words of
the same length with another character there, and the word without that character, whose
own whole rotation is that prefix. So each rotation stands in the list twice, under its
prefix (`skips` a character) and under itself (whole), and a group of equal keys holds all
neighbours by that one edit. It has one word per character at most, and one whole word.

* Two words of one length meet in one group, that of the place where they differ.
* Of a run of equal characters only the first counts as left out, so that a word and the
  one without that character meet once, too.

A group is read once. Each of its words gets how many others are there and the best of
them; pairs are never made. All lists are partitioned by range, so a common beginning of
keys is split like any other.
A word of n characters has n + 1 rotations of n + 1 characters, so a run of letters as long
as a page costs the square of its length, handed on in bounded batches.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import Scratch, stored

END = "$"  # no letter
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
# Fixed by the contract of the query: letters, and which runs lose one.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
ONE_IN = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _run): maximal runs of LEAST_LENGTH letters or more, in lower case.

    Shorter ones can't become words, as no step makes a run longer."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.col(key).alias("_id"), F.explode(found).alias("_run"))
    return runs.withColumn("_run", lower(F.col("_run")))


def deletion(runs: DataFrame) -> Column:
    """The run, less one character where 31 divides crc32('<_id>:<run>')."""
    h = F.crc32(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_run")))
    at = (h % F.length("_run")).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return F.when(h % ONE_IN == 0, less).otherwise(F.col("_run"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) of the column `word`: long enough and frequent enough."""
    counted = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


# Characters of keys that are held before they are handed on.
HELD = 1 << 21


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both keys of every rotation of each word."""
    rows: list[tuple] = []
    held = 0

    def taken() -> pa.RecordBatch:
        nonlocal held
        columns = list(zip(*rows)) or [()] * 5
        rows.clear()
        held = 0
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["_key", "word", "n", "_skips", "_first"]
        )

    for batch in batches:
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
            for i in range(len(word) + 1):
                rows.append((f"{word[i:]}{END}{word[:i]}", word, n, False, True))
                if i < len(word):
                    first = i == 0 or word[i] != word[i - 1]
                    rows.append((f"{word[i + 1:]}{END}{word[:i]}", word, n, True, first))
                held += 4 * len(word)
                if held > HELD:
                    yield taken()
    yield taken()


def _best(members: list[tuple]) -> list[tuple]:
    """The two members of most occurrences, ties by word, as (-n, word)."""
    return sorted((-m[1], m[0]) for m in members)[:2]


def group_neighbours(members: list[tuple[str, int, bool, bool]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, neighbours, occurrences of the best, the best) of each word of a group.

    A member is (word, n, skips, first)."""
    skipping = [m for m in members if m[2]]
    whole = [m for m in members if not m[2]]
    if not skipping or len(members) < 2:
        return
    top = _best(skipping)
    for word, n, _, first in skipping:
        near = [t for t in top if t[1] != word][:1]
        count = len(skipping) - 1
        if whole and first:
            near, count = sorted([*near, (-whole[0][1], whole[0][0])])[:1], count + 1
        if count:
            yield word, count, -near[0][0], near[0][1]
    firsts = [m for m in skipping if m[3]]
    if whole and firsts:
        (n, word), *_ = _best(firsts)
        yield whole[0][0], len(firsts), -n, word


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within each group of equal keys; rows come sorted by key."""
    key, members, out = None, [], []

    def taken() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["word", "_near", "_best_n", "_best"]
        )

    for batch in batches:
        names = ("_key", "word", "n", "_skips", "_first")
        for row_key, *row in zip(*(batch[c].to_pylist() for c in names)):
            if row_key != key:
                if len(members) > 1:
                    out.extend(group_neighbours(members))
                key, members = row_key, []
            members.append(tuple(row))
        if len(out) >= 4096:
            yield taken()
    if len(members) > 1:
        out.extend(group_neighbours(members))
    yield taken()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) for each row of (word, n); words have to be distinct."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rotated = words.mapInArrow(_rotated, "_key string, word string, n long, _skips boolean, _first boolean")
    rotated = rotated.repartitionByRange(parts, "_key").sortWithinPartitions("_key")
    found = rotated.mapInArrow(_scanned, "word string, _near long, _best_n long, _best string")
    best = F.struct((-F.col("_best_n")).alias("_order"), F.col("_best").alias("_word"))
    per_word = found.groupBy("word").agg(F.sum("_near").alias("n_near"), F.min(best).alias("_best"))
    joined = words.join(per_word, "word", "left")
    is_form = -F.col("_best._order") >= F.col("n") * RATIO
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("_best._word")).alias("form"),
        F.when(is_form, -F.col("_best._order")).alias("form_n"),
    )


def with_roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Add `root`, the last word on the way along the forms.

    Occurrences grow tenfold at each step, so no way is longer than 18 steps; each
    round doubles the steps that are taken at once.
    """
    steps = found.filter("form is not null").select("word", F.col("form").alias("root"))
    steps = scratch.stored(steps, "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = steps.join(ahead, "root", "left")
        further = scratch.stored(further.select("word", F.coalesce("_next", "root").alias("root"), "_next"), "roots")
        steps = further.select("word", "root")
        if further.filter("_next is not null").isEmpty():
            break
    joined = found.join(steps, "word", "left")
    return joined.withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `words` (word, n).

    Words are distinct, not null and without the terminator `$`. A word without near
    words has n_near 0; without a frequent one its form is null and it is its own root.
    Ties go to the smallest word by code point. An empty table gives an empty one.
    """
    with Scratch(words.sparkSession, "spelling") as scratch:
        words = scratch.stored(words, "words")
        found = scratch.stored(neighbours(words), "neighbours")
        return stored(
            with_roots(found, scratch).select("word", "form", "root", "n", "n_near", "form_n"), "spelling"
        )


def document_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) over all texts. A null text has no words, a null key counts as ''.

    Rows are counted as often as they occur; other columns take no part.
    """
    runs = letter_runs(docs, key, text)
    return vocabulary(runs.select(deletion(runs).alias("word")))
