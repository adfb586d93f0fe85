"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

The tree is domain, language, source. A leaf may give ``max_epochs`` times its tokens.
Budgets go from the root down: a node's budget is shared among its children by weight,
and a child that cannot use its share leaves the shortage to its siblings (the level of
the water). A node's capacity is the sum of its children's, so a shortage reaches an
ancestor's siblings only once the siblings are full. A leaf's budget is that many whole
epochs and a prefix, by tokens, of one more epoch in an order seeded by its number.

The prefix needs no sorted leaf: tokens are summed by the first digits of the order's
hash, the one bucket where the budget ends is cut up by the next digits, and so on until
no such bucket holds more than ``SORTED`` documents. Those are put in order, and the
place found there is a hash below which all documents are taken. So a leaf with a third
of all rows is filtered like any other, whatever its size: a leaf never has more than
16^``DIGITS`` sums, and at last ``SORTED`` documents, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_free, stored

LEVELS = ("domain", "lang", "source")
DIGITS, SORTED = 2, 1000  # hexadecimal digits of the hash that cut a bucket up; documents that one task may sort
WORD = r"[^\x20\x09-\x0D]+"
MANY_LEAVES = 200_000


def count_tokens(text: Column) -> Column:
    """Words and an end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long") + 1


def _path(domain: Column) -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(n) for c, n in zip((domain, F.col("lang"), F.col("source")), LEVELS, strict=True)]


def _weight(level: int, weights: dict[tuple[str, ...], int]) -> Column:
    """The whole-number weight of a node; 1 where none is given. ``*`` stands for any value above the last level."""
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == level:
            match = F.lit(True)
            for name, value in zip(LEVELS, path, strict=False):
                if value != "*":
                    match = match & (F.col(name) == value)
            out = F.when(match, w).otherwise(out)
    return out.cast("decimal(12,0)")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (cap, weight, budget_up: the parent's) with ``budget``: whole numbers, no more than cap.

    In the order of cap over weight, a child is full if its cap is no more than its share
    of what the fuller ones before it have left.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), name)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = "decimal(38,0)"
    out = children.withColumns(
        {"left_": F.col("budget_up") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "heavy_": F.sum("weight").over(rest)},
    )
    out = out.withColumn("full_", F.col("cap").cast("decimal(25,0)") * F.col("heavy_").cast("decimal(13,0)") <= F.col("weight").cast("decimal(13,0)") * F.col("left_").cast("decimal(25,0)"))
    all_ = Window.partitionBy(*parent)
    out = out.withColumns({
        "kept_": F.col("budget_up") - F.coalesce(F.sum(F.when(F.col("full_"), F.col("cap"))).over(all_), F.lit(0)),
        "open_": F.sum(F.when(~F.col("full_"), F.col("weight"))).over(all_),
    })
    part = (F.col("weight").cast("decimal(13,0)") * F.col("kept_").cast("decimal(25,0)")).cast(n)
    budget = F.when(F.col("full_"), F.col("cap")).otherwise(F.floor((part - F.expr("cast(pmod(cast(weight as decimal(13,0)) * cast(kept_ as decimal(25,0)), cast(open_ as decimal(38,0))) as decimal(38,0))")) / F.col("open_")).cast("long"))
    return out.withColumn("budget", budget).drop("left_", "heavy_", "full_", "kept_", "open_")


def leaf_budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], budget_share: float, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with cap and budget."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    level = {3: leaves}
    for k in (2, 1):
        level[k] = level[k + 1].groupBy(*LEVELS[:k]).agg(F.sum("cap").alias("cap"))
    got = leaves.agg(F.least(F.floor(F.sum("tokens") * budget_share).cast("long"), F.sum("cap")).alias("b")).first()  # one number
    root = F.lit(got.b or 0).cast("long")
    up = None
    for k in (1, 2, 3):
        nodes = level[k].withColumn("weight", _weight(k, weights))
        nodes = nodes.withColumn("budget_up", root) if up is None else nodes.join(up, list(LEVELS[: k - 1]))
        up = share_out(nodes, list(LEVELS[: k - 1]), LEVELS[k - 1])
        keep = [*LEVELS[:k], F.col("budget").alias("budget_up")] if k < 3 else [*LEVELS, "tokens", "cap", "budget"]
        up = up.select(*keep)
    return up


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cutoffs(docs: DataFrame, weights, budget_share: float, max_epochs: int, seed: int, domain: Column, text: str, doc_id: str) -> DataFrame:
    """A row a leaf: domain, lang, source, tokens, cap, budget, epochs (whole ones), cutoff (of the next epoch's order)."""
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), *_path(domain), count_tokens(F.col(text)).alias("n")), "sizes")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    leaves = leaf_budgets(leaves, weights, budget_share, max_epochs)
    leaves = stored(leaves.withColumns({"epochs": F.floor(F.col("budget") / F.col("tokens")).cast("long"), "rest": F.col("budget") % F.col("tokens")}), "leaves")
    few = leaves.count() <= MANY_LEAVES
    small = lambda df: F.broadcast(df) if few else df
    ordered = rows.join(small(leaves), list(LEVELS)).select(*LEVELS, "n", "rest", _order(seed, F.col("epochs"), F.col("doc_id")).alias("key"))
    edge, inside = leaves.select(*LEVELS, F.lit("").alias("edge"), F.lit(0).cast("decimal(38,0)").alias("before")), ordered
    for depth in range(DIGITS, 32, DIGITS):  # the edge buckets, by ever more digits, but never the whole hash
        cut_up = inside.withColumn("bucket", F.substring("key", 1, depth))
        sums = cut_up.groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("in_bucket"), F.count(F.lit(1)).alias("docs"), F.first("rest").alias("rest"))
        running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = sums.join(small(edge.select(*LEVELS, "before")), list(LEVELS)).withColumn("end", F.col("before") + F.sum("in_bucket").over(running)).where("end > rest")
        first = ends.groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", "end", "in_bucket", "docs"), "bucket").alias("e"))
        edge = first.select(*LEVELS, F.col("e.bucket").alias("edge"), (F.col("e.end") - F.col("e.in_bucket")).cast("decimal(38,0)").alias("before"), F.col("e.docs").alias("docs"))
        edge = stored(edge, "edges")
        inside = cut_up.join(small(edge.select(*LEVELS, "edge")), list(LEVELS)).where("bucket = edge").drop("bucket", "edge")
        if (edge.agg(F.max("docs")).first()[0] or 0) <= SORTED:
            break
        inside = stored(inside, "inside")
    upto = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.join(small(edge.select(*LEVELS, "before")), list(LEVELS)).withColumn("upto", F.col("before") + F.sum("n").over(upto))
    last = reached.where("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("key"))
    cut = edge.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("key", "edge").alias("cutoff"))
    return stored(leaves.join(cut, list(LEVELS), "left").drop("rest"), "cutoffs")


def mix(docs: DataFrame, weights: dict[tuple[str, ...], int], domain: Column, budget_share: float = 0.75, max_epochs: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each once for every epoch that takes it, with ``epoch`` (from 0), ``domain`` and ``tokens``.

    ``docs`` needs lang and source; ``weights`` maps paths of the tree to whole numbers;
    the budget is ``budget_share`` of all tokens. A null text has one token, null paths
    are the empty name, rows that share a doc_id stand or fall together in a leaf's order,
    rows that repeat are taken or left each with its copies, an empty table gives no rows.
    A new column that clashes with one of ``docs`` gets an underscore at its end.
    """
    leaves = cutoffs(docs, weights, budget_share, max_epochs, seed, domain, text, doc_id)
    few = leaves.count() <= MANY_LEAVES
    path, epochs, cutoff, times = [column_free(docs, f"{c}__leaf") for c in LEVELS], *(column_free(docs, c) for c in ("epochs__leaf", "cutoff__leaf", "times__"))
    cuts = leaves.select(*(F.col(c).alias(a) for c, a in zip(LEVELS, path, strict=True)), F.col("epochs").alias(epochs), F.col("cutoff").alias(cutoff))
    on = [F.coalesce(c, F.lit("")) == F.col(a) for c, a in zip((domain, F.col("lang"), F.col("source")), path, strict=True)]
    met = docs.join(F.broadcast(cuts) if few else cuts, on[0] & on[1] & on[2])
    more = F.when(_order(seed, F.col(epochs), F.col(doc_id)) <= F.coalesce(cutoff, F.lit("")), 1).otherwise(0)
    names = [column_free(docs, c) for c in ("epoch", "domain", "tokens")]
    taken = met.withColumn(times, F.col(epochs).cast("int") + more).where(F.col(times) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias(names[0]), F.col(path[0]).alias(names[1]), count_tokens(F.col(text)).alias(names[2]))
