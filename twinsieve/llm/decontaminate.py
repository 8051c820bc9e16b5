"""Benchmark contamination, by winnowed fingerprints (operator 6).

Documents and items are sequences of words. A document is fingerprinted by the least hash
of every WINDOW neighbouring K-word grams: any SPAN = K + WINDOW - 1 words that a document
shares with an item give both the same fingerprint, so that none is missed. Documents
that share a fingerprint are candidates. For these, every K-gram shared with an item gives an
alignment (document, item, offset), which is extended: the words of item and document
are compared along the whole alignment, and each run of SPAN equal words is a hit.

An item of fewer than SPAN words counts as a whole, and winnowing does not vouch for
spans so short: for each length that occurs (12 at most) all grams of that length are
fingerprints too.

Built-in functions only. Fingerprints are narrow and distinct per document; texts of
documents are shuffled for candidates only. Every step's partner is a stored table, so that
Catalyst knows its size: it broadcasts a small benchmark and shuffles a large one.

Null and empty texts have no words and no hits. Items without words are ignored, as are
null item ids. Rows of equal key and text are looked at once and answered each.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import keyed, listed_rows, same, stored

SPAN, K = 13, 8
WINDOW = SPAN - K + 1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters beyond A-Z that a general lower() could change; they have to stay.
OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"


def words(text: Column) -> Column:
    """Lower-cases A-Z only, and takes the words. No words for null."""
    lowered = F.when(F.regexp_like(text, F.lit(OTHER_CASE)), F.translate(text, UPPER, LOWER))
    lowered = lowered.otherwise(F.lower(text))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def _from(array: str | Column, start: int) -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.slice(array, start + 1, F.size(array))


def _joined(a: str, b: str, apart: int) -> Column:
    """Hash of each element of `a` with the one of `b` so many places on."""
    return F.zip_with(a, _from(b, apart), lambda x, y: F.xxhash64(x, y))


def _lower(a: str, b: str, apart: int) -> Column:
    return F.zip_with(a, _from(b, apart), lambda x, y: F.least(x, y))


def with_grams(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Add _g<n>: the hash of the n words from each word on, as far as they reach.

    Hashes of 1, 2, 4 and 8 words are put together from halves, others from these.
    """
    rows = rows.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    size = 1
    while 2 * size <= max(lengths):
        rows = rows.withColumn(f"_h{2 * size}", _joined(f"_h{size}", f"_h{size}", size))
        size *= 2
    for n in lengths:
        powers = [p for p in (8, 4, 2, 1) if n & p]
        name = f"_h{powers[0]}"
        for i, p in enumerate(powers[1:], 1):
            rows = rows.withColumn(f"_p{n}_{i}", _joined(name, f"_h{p}", sum(powers[:i])))
            name = f"_p{n}_{i}"
        reach = F.greatest(F.size("_words") - (n - 1), F.lit(0))
        rows = rows.withColumn(f"_g{n}", F.slice(name, 1, reach))
    return rows


def _marks(grams: str, n: int) -> Column:
    """Grams of different lengths must not be taken for each other."""
    return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))


def fingerprints(rows: DataFrame, short: list[int]) -> Column:
    """Adds to (…, _words) the array _marks of distinct (n, hash)."""
    rows = with_grams(rows, [K, *[n for n in short if n != K]])
    # The least of 2, 4 and then 6 neighbours; at the end of a text, of those there are.
    rows = rows.withColumn("_m2", _lower(f"_g{K}", f"_g{K}", 1))
    rows = rows.withColumn("_m4", _lower("_m2", "_m2", 2))
    rows = rows.withColumn("_m6", _lower("_m4", "_m2", 4))
    rows = rows.withColumn("_w", F.array_distinct("_m6"))
    marks = [_marks("_w", 0), *[_marks(f"_g{n}", n) for n in short]]
    return rows.withColumn("_marks", F.concat(*marks) if len(marks) > 1 else marks[0])


def _places(rows: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """(keys, _n, _g, _at) of all grams of the given lengths."""
    rows = with_grams(rows, lengths)
    parts = [
        rows.select(*keys, F.lit(n).alias("_n"), F.posexplode(f"_g{n}").alias("_at", "_g"))
        for n in lengths
    ]
    return reduce(DataFrame.unionByName, parts)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(_id, _fp, n_words, n_hit, items) of every row; items: ids of items with a hit,
    as sorted strings."""
    items = benchmark.filter(F.col(item).isNotNull()).select(
        F.col(item).alias("_item"), words(F.col(item_text)).alias("_words")
    )
    items = stored(items.filter(F.size("_words") > 0), "bench-items")
    size = F.size("_words")
    found = items.filter(size < SPAN).select(size.alias("n")).distinct().collect()
    short = sorted(r.n for r in found)  # 12 values at most

    rows = keyed(docs, key, text).select("_id", "_fp", words(F.col("_text")).alias("_words"))
    marked = fingerprints(rows, short).select("_id", "_fp", size.cast("long").alias("n_words"), "_marks")
    marked = stored(marked, "bench-marks")

    long_marks = fingerprints(items.filter(size >= SPAN), []).select(F.explode("_marks").alias("_mark"))
    whole = _places(items.filter(size < SPAN), short, "_item", "_words") if short else None
    marks = long_marks
    if whole is not None:
        whole = whole.filter(size == F.col("_n"))
        marks = marks.unionByName(whole.select(F.struct(F.col("_n").alias("n"), F.col("_g").alias("g")).alias("_mark")))
    marks = stored(marks.select("_mark.n", "_mark.g").distinct(), "bench-known")

    mine = marked.select("_id", "_fp", F.explode("_marks").alias("_mark"))
    mine = mine.select("_id", "_fp", F.col("_mark.n").alias("n"), F.col("_mark.g").alias("g"))
    near = mine.join(marks, ["n", "g"], "left_semi").select("_id", "_fp").distinct()
    near = stored(near, "bench-candidates")

    # Candidates once more, now with their words; one row for equal ones.
    again = listed_rows(keyed(docs, key, text), near)
    again = again.select("_id", "_fp", words(F.col("_text")).alias("_words"))
    again = stored(again.dropDuplicates(["_id", "_fp"]), "bench-texts")

    lengths = sorted({K, *short})
    ours = _places(again, lengths, "_id", "_fp")
    theirs = _places(items.filter(size >= SPAN), [K], "_item")
    if whole is not None:
        theirs = theirs.unionByName(whole.select("_item", "_n", "_g", "_at"))
    theirs = stored(theirs.withColumnRenamed("_at", "_of"), "bench-places")
    aligned = ours.join(theirs, ["_n", "_g"]).select(
        "_id", "_fp", "_item", (F.col("_at") - F.col("_of")).alias("_by")
    )
    aligned = stored(aligned.distinct(), "bench-alignments")
    hits = stored(_extended(aligned, again, items), "bench-hits")

    per_word = hits.select("_id", "_fp", F.explode("_hits").alias("_at")).distinct()
    counted = per_word.groupBy("_id", "_fp").agg(F.count("*").alias("_n_hit"))
    listed = hits.groupBy("_id", "_fp").agg(F.collect_set(F.col("_item").cast("string")).alias("_items"))
    both = counted.join(listed, same(counted, listed, "_id", "_fp")).select(
        counted["_id"], counted["_fp"], "_n_hit", F.array_sort("_items").alias("_items")
    )
    both = stored(both, "bench-found")
    base = marked.select("_id", "_fp", "n_words")
    return base.join(both, same(base, both, "_id", "_fp"), "left").select(
        base["_id"], base["_fp"], "n_words",
        F.coalesce("_n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    )


def _extended(aligned: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, _fp, _item, _hits): places of document words in runs of equal words."""
    joined = aligned.join(items.select("_item", F.col("_words").alias("_theirs")), "_item")
    joined = joined.join(texts, same(joined, texts, "_id", "_fp")).select(
        joined["_id"], joined["_fp"], "_item", "_by", "_theirs", "_words"
    )
    start, other = F.greatest(F.col("_by"), F.lit(0)), F.greatest(-F.col("_by"), F.lit(0))
    reach = F.least(F.size("_words") - start, F.size("_theirs") - other)
    need = F.least(F.size("_theirs"), F.lit(SPAN))
    equal = F.zip_with(
        F.slice("_words", start + 1, reach), F.slice("_theirs", other + 1, reach), lambda a, b: a == b
    )
    long = joined.filter(reach >= need).select(
        "_id", "_fp", "_item", start.alias("_start"), need.alias("_need"), equal.alias("_equal")
    )
    runs = F.filter(
        F.sequence(F.lit(0), F.size("_equal") - F.col("_need")),
        lambda i: F.forall(F.slice("_equal", i + 1, F.col("_need")), lambda e: e),
    )
    covered = F.flatten(
        F.transform(runs, lambda i: F.sequence(F.col("_start") + i, F.col("_start") + i + F.col("_need") - 1))
    )
    hits = long.select("_id", "_fp", "_item", F.array_distinct(covered).alias("_hits"))
    return hits.filter(F.size("_hits") > 0)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
