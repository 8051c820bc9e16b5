"""Secrets in texts, by a trigram inverted index (operator 1).

Each rule is a regular expression. From it follow the trigrams that any match must
contain, as alternatives of sets (`trigrams`). The index has one posting (trigram, row) for
every such trigram in a lower-cased text. Where the postings of a row cover an alternative
of a rule, the row is a candidate of that rule, and only then the expression runs on
the whole text. A rule without such trigrams runs on all texts.

Everything is built-in functions. Postings are narrow, combined per row before the
shuffle, and of a number per row that the rules bound. Texts of candidates meet their rules
by a join on the row, behind a filter that keeps the other texts where they are.

Null texts count as empty. Rows of equal key and text are scanned once and answered each.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import keyed, listed_rows, same, stored
from twinsieve.llm.trigrams import clauses


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 0  # matches with a shorter part are dropped


# Fixed values. The first three are the base; their order decides ties.
RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
SPAN = "struct<start:int,rank:int,end:int>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule, in order, in code points; none for a null text.

    What stands between the matches and the matches themselves give the positions.
    """
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.arrays_zip(between.alias("b"), matches.alias("m"), parts.alias("p"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["b"])
        end = start + F.coalesce(F.length(row["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        long = row["m"].isNotNull() & (F.length(row["p"]) >= rule.least)
        spans = F.when(long, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    found = F.aggregate(rows, zero, add, lambda state: state["spans"])
    return F.when(F.regexp_like(text, pattern), found).otherwise(none)


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (_gram, _id, _fp) of the given trigrams in (_id, _fp, _text)."""
    lowered = rows.select("_id", "_fp", F.lower("_text").alias("_low"))
    held = [F.when(F.col("_low").contains(g), F.lit(g)) for g in trigrams]
    grams = F.array_compact(F.array(*held))
    return lowered.select("_id", "_fp", F.explode(grams).alias("_gram"))


def candidates(postings: DataFrame, demands: dict[int, list[list[str]]]) -> DataFrame:
    """(_id, _fp, _rules): the rules, by number, that a row may match."""
    held = postings.groupBy("_id", "_fp").agg(F.collect_set("_gram").alias("_grams"))

    def covered(alternative: list[str]) -> Column:
        wanted = F.array(*map(F.lit, alternative))
        return F.size(F.array_intersect("_grams", wanted)) == len(alternative)

    hits = [
        F.when(reduce(lambda a, b: a | b, map(covered, alternatives)), F.lit(rank))
        for rank, alternatives in demands.items()
    ]
    found = held.select("_id", "_fp", F.array_compact(F.array(*hits)).alias("_rules"))
    return found.filter(F.size("_rules") > 0)


def secret_spans(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(_id, spans) of every row; spans are structs of start, rank of the rule, and end,
    in code points, by start and rank."""
    rows = keyed(docs, key, text)
    demands = {rank: found for rank, rule in enumerate(rules) if (found := clauses(rule.pattern))}
    none = F.array().cast(f"array<{SPAN}>")
    full = [_spans(F.col("_text"), r, rank) for rank, r in enumerate(rules) if rank not in demands]
    scanned = rows.select("_id", "_fp", (F.concat(*full) if full else none).alias("_full"))
    if not demands:
        return scanned.select("_id", F.array_sort(F.coalesce("_full", none)).alias("spans"))

    trigrams = sorted({g for found in demands.values() for c in found for g in c})
    postings = stored(build_index(rows, trigrams), "secret-postings")
    hits = stored(candidates(postings, demands), "secret-candidates")
    verified = listed_rows(rows, hits).select(
        "_id", "_fp",
        F.concat(*[
            F.when(F.array_contains("_rules", rank), _spans(F.col("_text"), rules[rank], rank)).otherwise(none)
            for rank in demands
        ]).alias("_found"),
    )
    verified = verified.filter(F.size("_found") > 0).dropDuplicates(["_id", "_fp"])
    verified = stored(verified, "secret-verified")
    spans = F.concat(F.coalesce("_full", none), F.coalesce("_found", none))
    joined = scanned.join(verified, same(scanned, verified, "_id", "_fp"), "left")
    return joined.select(scanned["_id"], F.array_sort(spans).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")
