"""Mixing sources to target weights (operator 5).

Documents are leaves of a tree: domain, language, source. A budget of tokens goes down the
tree by integer weights. A child can take no more than its subtree holds - `epochs` times the
tokens there - and what it cannot take is shared by its siblings, by weight; only
what no child can take is left to the parent's own siblings. Each leaf then fills its budget
with whole epochs of all its documents, and with a prefix of one more: documents in the
order of a hash of seed, epoch and document, as long as their tokens fit.

Built-in functions only. Counts per leaf combine before the shuffle, the tree is one
row per leaf. A leaf of any size is never sorted: its documents are counted by the first
bytes of their hash, twice, and only those that share the four hex digits at the cut are
put in order. The cut is one text per leaf, and documents are selected where they are read.

Null names are the empty name. Null texts count as empty. Names without a weight get none.
Documents equal in key and text are taken or left together, as one step of the prefix. Leaves
without tokens or budget give nothing. Rounding loses less than a token per child.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.columns import packed, stored, unpacked

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ["_domain", "_lang", "_source"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str], budget: str, weight: str, room: str, out: str) -> DataFrame:
    """Split each parent's budget over its children by weight, none over its room.

    Children are filled in the order of room per weight: a child is full if its share of
    what is left, among those not filled before it, is more than its room.
    """
    open_nodes = nodes.filter(F.col(weight) > 0)
    order = [F.col(room) / F.col(weight), *[F.col(c) for c in LEAF if c in nodes.columns and c not in parent]]
    ordered = Window.partitionBy(*parent).orderBy(*order)
    before = F.coalesce(F.sum(room).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    full = (F.col(budget) - before) * F.col(weight) >= F.col(room) * rest
    marked = open_nodes.withColumn("_full", full)
    all_of = Window.partitionBy(*parent)
    taken = F.sum(F.when(F.col("_full"), F.col(room)).otherwise(0)).over(all_of)
    weights = F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(all_of)
    marked = marked.withColumns({"_taken": taken, "_weights": weights})
    part = F.expr(f"({weight} * ({budget} - _taken)) div greatest(_weights, 1)")
    given = F.when(F.col("_full"), F.col(room)).otherwise(part)
    return marked.withColumn(out, given).drop("_full", "_taken", "_weights")


def leaf_budgets(
    leaves: DataFrame, budget: Column, epochs: int, weights: dict[str, Column]
) -> DataFrame:
    """(leaf, _have, _budget) from (leaf, _have): budgets after hierarchical sharing.

    `weights`: integer weights of domain, lang and source by their names, as columns of
    _domain, _lang and _source. `budget` is an aggregate over _have.
    """
    total = leaves.agg(budget.cast("long").alias("_b0"))
    nodes = leaves.withColumn("_room", F.col("_have") * epochs).crossJoin(total)  # one row
    for depth, name in enumerate(("domain", "lang", "source"), 1):
        own = LEAF[:depth]
        level = nodes.groupBy(*own).agg(F.sum("_room").alias("_cap"), F.max(f"_b{depth - 1}").alias("_got"))
        level = level.withColumn("_weight", weights[name].cast("long")).withColumn("_tree", F.lit(1))
        split = share(level, own[:-1] or ["_tree"], "_got", "_weight", "_cap", f"_b{depth}")
        nodes = nodes.join(split.select(*own, f"_b{depth}"), own)
    return nodes.select(*LEAF, "_have", F.col("_b3").alias("_budget"))


def _cut(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, _whole, _until): whole epochs, and the last hash of the epoch after them.

    `rows` has (leaf, _unit, _tokens), `leaves` (leaf, _have, _budget).
    """
    plan = leaves.filter("_have > 0 and _budget > 0").withColumn("_whole", F.expr("_budget div _have"))
    plan = stored(plan.withColumn("_rest", F.expr("_budget % _have")), "mix-plan")
    hashed = rows.join(plan.select(*LEAF, "_whole", "_rest"), LEAF)
    hashed = hashed.select(*LEAF, "_rest", "_tokens", _hash(F.col("_whole"), F.col("_unit")).alias("_k"))
    hashed = stored(hashed, "mix-hashed")

    at = plan.select(*LEAF, "_rest", F.lit(0).cast("long").alias("_before"), F.lit("").alias("_prefix"))
    for digits in (2, 4):
        here = hashed.drop("_rest").join(at, LEAF)
        here = here.filter(F.substring("_k", 1, digits - 2) == F.col("_prefix"))
        parts = here.groupBy(*LEAF, "_rest", "_before", F.substring("_k", 1, digits).alias("_part"))
        parts = parts.agg(F.sum("_tokens").alias("_n"))
        running = F.sum("_n").over(Window.partitionBy(*LEAF).orderBy("_part")) + F.col("_before")
        over = parts.withColumn("_upto", running).filter("_upto > _rest").groupBy(*LEAF, "_rest")
        over = over.agg(F.min(F.struct("_part", "_upto", "_n")).alias("_at"))
        at = stored(
            over.select(*LEAF, "_rest", (F.col("_at._upto") - F.col("_at._n")).alias("_before"), F.col("_at._part").alias("_prefix")),
            f"mix-cut{digits}",
        )
    here = hashed.drop("_rest").join(at, LEAF).filter(F.substring("_k", 1, 4) == F.col("_prefix"))
    units = here.groupBy(*LEAF, "_rest", "_before", "_k").agg(F.sum("_tokens").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*LEAF).orderBy("_k")) + F.col("_before")
    last = units.withColumn("_upto", running).filter("_upto <= _rest").groupBy(*LEAF).agg(F.max("_k").alias("_last"))
    found = plan.select(*LEAF, "_budget", "_whole", "_rest").join(at.select(*LEAF, "_prefix"), LEAF, "left")
    found = found.join(last, LEAF, "left")
    # Without a rest there is no further epoch, not even for documents of no tokens.
    until = F.when(F.col("_rest") > 0, F.coalesce("_last", "_prefix")).otherwise("")
    return found.select(*LEAF, "_budget", "_whole", until.alias("_until"))


def _hash(epoch: Column, unit: Column, seed: int = 29) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, unit))


def mix_sources(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, Column],
    percent: int = 60,
    epochs: int = 2,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """The selected rows, once per epoch they are in, with `mix_epoch` and `mix_budget`.

    The budget is `percent` of all tokens. `domain` is computed from columns of `docs`.
    Input columns with the names of the two new ones are replaced.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = {"_domain": name(domain), "_lang": name(F.col(lang)), "_source": name(F.col(source))}
    unit = F.concat_ws(":", name(F.col(key)), F.md5(F.coalesce(text, F.lit(""))))
    rows = docs.select(
        *[c.alias(n) for n, c in leaf.items()], unit.alias("_unit"), word_count(F.col(text)).alias("_tokens")
    )
    rows = stored(rows, "mix-rows")
    leaves = stored(rows.groupBy(*LEAF).agg(F.sum("_tokens").alias("_have")), "mix-leaves")
    budget = F.expr(f"(coalesce(sum(_have), 0) * {percent}) div 100")
    budgets = stored(leaf_budgets(leaves, budget, epochs, weights), "mix-budgets")
    cuts = stored(_cut(rows, budgets), "mix-cuts")

    marked = docs.select(packed(docs), *[c.alias(n) for n, c in leaf.items()], unit.alias("_unit"))
    marked = marked.join(cuts, LEAF)
    in_next = (_hash(F.col("_whole"), F.col("_unit")) <= F.col("_until")).cast("long")
    times = F.col("_whole") + in_next
    marked = marked.withColumn("_times", times).filter("_times > 0")
    taken = marked.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    return unpacked(
        taken, docs, {"mix_epoch": F.col("_epoch").cast("int"), "mix_budget": F.col("_budget")}
    )
