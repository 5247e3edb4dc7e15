"""Mixing sources to target weights under a token budget.

Method: documents form a tree, domain over language over source. The budget goes down the tree in
proportion to the weights of siblings. No node takes more than its capacity, the tokens below it times
``max_epochs``; what it leaves is shared among its siblings by their weights, and passes on to the siblings of
the parent only if all of its own are full. Each leaf then reads its documents in a seeded order, whole
epochs first, then the prefix of one more epoch that fits the rest of its budget.

At scale: the tree is a small aggregate and its shares are windows over siblings. A leaf's prefix is found by
sums over as many hash buckets as the square root of its documents, so that only the one bucket in which the
budget ends is ever ordered row by row, however large the leaf.

Defined results: words parted by ASCII blanks are the tokens. Null lang or source are nodes of their own
(shown as null), null text has no tokens; documents without tokens are in every started epoch of a leaf with
a budget. Rows without a doc_id are ordered last. Equal rows share an order and are taken by their text's
hash. Weights not given are 1; a weight of 0 or less takes nothing, nor does anything below it, and its share goes to
its siblings. Siblings of equal size and weight get equal shares. The leaves' budgets sum to the whole budget, or to all
capacity if that is less, but for the part of a token that each leaf's is rounded down by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexure.llm.common import Scratch

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The stand-in for a domain: the first digit of the number in a source's name, by halves; ``other`` without a number."""
    digit = F.regexp_extract(source, "([0-9])[^0-9]*$", 1)
    return F.when(source.isNull() | (digit == ""), "other").when(digit < "5", "low").otherwise("high")


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def _weight(name: Column, given: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in sorted(given.items()):
        out = F.when(name == k, float(v)).otherwise(out)
    return out


def share(nodes: DataFrame, parent: list[str], node: str, budget: str, out: str) -> DataFrame:
    """Split ``budget`` (of the parent, on each row) among siblings by ``weight`` up to ``capacity``.

    Siblings are taken by rising capacity / weight. A node is full if the ratio at which it fills does not exceed
    what the budget that those before it leave gives to a weight of one among those from it on. The others share
    what all full ones leave. Siblings of one ratio are all full or none is, so their order does not matter.
    """
    siblings = Window.partitionBy(*parent)
    order = siblings.orderBy("_ratio", F.col(node).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    takes, none = F.col("weight") > 0, F.lit(0.0)
    nodes = nodes.select(
        "*",
        F.when(takes, F.col("weight")).otherwise(none).alias("_weight"),
        F.when(takes, F.col("capacity")).otherwise(none).alias("_capacity"),
        F.when(takes, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))).alias("_ratio"),
    )
    level = (F.col(budget) - F.coalesce(F.sum("_capacity").over(before), none)) / F.sum("_weight").over(onward)
    nodes = nodes.withColumn("_full", F.when(takes, F.col("_ratio") <= level * (1 + 1e-12)).otherwise(F.lit(False)))
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_capacity"))).over(siblings), none)
    rest = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(siblings)
    part = F.when(takes, F.greatest(none, F.col(budget) - used) / rest * F.col("_weight")).otherwise(none)
    shared = nodes.withColumn(out, F.when(F.col("_full"), F.col("_capacity")).otherwise(part))
    return shared.drop("_weight", "_capacity", "_ratio", "_full", "weight", "capacity")


def _same(names: list[str], prefix: str) -> Column:
    """Whether columns equal those of the same names with ``prefix``, nulls included."""
    match = F.lit(True)
    for name in names:
        match = match & F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return match


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, docs and budget (whole tokens) of each leaf; ``total`` is the budget of the whole tree.

    ``leaves``: domain, lang, source, tokens, docs. What lies under a weight of 0 or less is no capacity of any node above.
    """
    weight = {level: _weight(F.col(level), weights.get(level, {})) for level in LEVELS}
    usable = (weight["domain"] > 0) & (weight["lang"] > 0) & (weight["source"] > 0)
    now = leaves.withColumn("usable", F.when(usable, F.col("tokens")).otherwise(0)).withColumn("whole", F.lit(total))
    for depth, level in enumerate(LEVELS):
        keys, above = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        budget = "whole" if depth == 0 else f"b_{LEVELS[depth - 1]}"
        nodes = now.groupBy(*keys, budget).agg((F.sum("usable") * max_epochs).cast("double").alias("capacity"))
        shares = share(nodes.withColumn("weight", weight[level]), above or [budget], level, budget, f"b_{level}")
        shares = shares.select(*[F.col(k).alias(f"_{k}") for k in keys], f"b_{level}")
        now = now.join(shares, _same(keys, "_")).drop(*[f"_{k}" for k in keys])
    return now.select(*LEVELS, "tokens", "docs", F.floor(F.col("b_source") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 0.6, max_epochs: int = 2, seed: int = 17,
    domain: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source and others) that the mix takes, with domain, n_tokens and copies.

    weights: {"domain": {name: weight}, "lang": ..., "source": ...}. fraction: the budget as a part of all
    tokens. copies: in how many epochs a row is taken, at least once.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit("other")).alias("_domain"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        token_count(F.col("text")).alias("_n"),
        F.col("doc_id").cast("string").alias("_id"),
        F.xxhash64("text").alias("_tie"),
    )
    slim = named.select(*[F.col(f"_{k}").alias(k) for k in LEVELS], F.col("_n").alias("n_tokens"), F.col("_id").alias("id"), F.col("_tie").alias("tie"))
    # Equal rows (one id, one text) are one entry of the order, with their number.
    entries = scratch.keep(slim.groupBy(*LEVELS, "id", "tie", "n_tokens").agg(F.count("*").alias("rows")), "entries")
    leaves = entries.groupBy(*LEVELS).agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"), F.sum("rows").alias("docs"))
    leaves = scratch.keep(leaves, "leaves")
    total = float(leaves.agg(F.sum("tokens")).first()[0] or 0) * fraction
    budgets = leaf_budgets(leaves, weights, total, max_epochs)
    some = F.col("tokens") > 0
    plan = budgets.filter("budget > 0 or tokens = 0").select(
        *[F.col(k).alias(f"p_{k}") for k in LEVELS],
        F.when(some, F.expr("budget div tokens")).otherwise(0).alias("full"),
        F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
        F.ceil(F.sqrt(F.col("docs"))).cast("long").alias("buckets"),
        "tokens",
    )
    plan = scratch.keep(plan, "plan")

    # Each entry's place in the next epoch: a hash, and the bucket of its leaf in which that falls.
    said = F.concat(F.lit(f"{seed}:"), (F.col("full") + 1).cast("string"), F.lit(":"), F.coalesce("id", F.lit("~")))
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0
    ordered = entries.join(plan, _same(list(LEVELS), "p_")).withColumn("key", F.md5(said.cast("binary")))
    ordered = ordered.withColumn("bucket", F.floor(part * F.col("buckets")).cast("long")).withColumn("weight", F.col("n_tokens") * F.col("rows"))
    ordered = scratch.keep(ordered.select(*LEVELS, "id", "tie", "n_tokens", "rows", "full", "rest", "key", "bucket", "weight"), "ordered")
    sums = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("weight").alias("s"))
    upto = F.sum("s").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    before = sums.select(*[F.col(k).alias(f"s_{k}") for k in [*LEVELS, "bucket"]], (upto - F.col("s")).alias("b"), "s")
    before = scratch.keep(before, "before")

    # Buckets before the one in which the budget ends are taken whole, those after it not; the rows of that one are ordered.
    placed = ordered.join(before, _same([*LEVELS, "bucket"], "s_")).drop(*[f"s_{k}" for k in [*LEVELS, "bucket"]])
    whole = placed.filter("b + s <= rest").select("id", "tie", *LEVELS, (F.col("full") + 1).alias("copies"))
    edge = placed.filter("b + s > rest")
    in_order = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)
    cut = edge.filter("b <= rest").withColumn("upto", F.col("b") + F.sum("weight").over(in_order))
    part = cut.select("id", "tie", *LEVELS, (F.col("full") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    past = edge.filter("b > rest").select("id", "tie", *LEVELS, F.col("full").alias("copies"))
    taken = whole.unionByName(part).unionByName(past).filter("copies > 0")
    taken = scratch.keep(taken.select(*[F.col(k).alias(f"t_{k}") for k in ["id", "tie", *LEVELS]], "copies"), "taken")
    scratch.drop(entries, ordered, before)
    match = F.lit(True)
    for k in ["id", "tie", *LEVELS]:
        match = match & F.col(f"_{k}").eqNullSafe(F.col(f"t_{k}"))
    chosen = named.hint("merge").join(taken, match)
    return chosen.select("_row", F.col("_domain").alias("domain"), F.col("_n").alias("n_tokens"), F.col("copies").cast("long").alias("copies"))
