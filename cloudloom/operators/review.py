"""Signatures of instances: models, decisions of a user, and what changed between runs.

Signatures are compared in bands: centres fall into cells of the pin distance and sides
into bands of the tolerance, so a comparison of two large tables is an equi-join, and
neither table is broadcast.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import orientation
from ..plans.model import CODE, SIMILAR

SLACK = 1e-9  # so that rounding never parts what a tolerance joins
PAIRS = 20_000_000  # of two runs, that one task goes through in order


def signature(instances: DataFrame) -> DataFrame:
    """(instance_id, label, d1, d2, d3, z_extent, to_ceiling, to_floor, verticality, cx, cy, cz): lengths to 4 decimals, the centre to 3."""
    r4, r3 = (lambda c: F.bround(c, 4)), (lambda c: F.bround(c, 3))
    return instances.select(
        "instance_id", "label", *(r4(F.element_at("dims", k)).alias(f"d{k}") for k in (1, 2, 3)), r4(F.col("robust_z")).alias("z_extent"),
        r4(F.col("to_ceiling")).alias("to_ceiling"), r4(F.col("to_floor")).alias("to_floor"), r4(F.col("verticality")).alias("verticality"),
        *(r3(F.element_at("centre", k)).alias(f"c{c}") for k, c in zip((1, 2, 3), "xyz", strict=True)),
    )


def _within(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(b * relative, F.lit(absolute))


def matches(i: str, m: str, t: dict = SIMILAR) -> Column:
    """Whether the instance of prefix ``i`` fits the model of prefix ``m``; tolerances come from the model."""
    a, b = (lambda c: F.col(f"{i}{c}")), (lambda c: F.col(f"{m}{c}"))
    sides = _within(a("d1"), b("d1"), t["relative"], t["absolute"]) & _within(a("d2"), b("d2"), t["relative"], t["absolute"]) & _within(a("d3"), b("d3"), t["relative"], t["absolute"])
    low = a("z_extent") <= b("z_extent") + F.greatest(b("z_extent") * t["relative"], F.lit(t["absolute"]))
    way = orientation(a("verticality")) == orientation(b("verticality"))
    place = (
        F.when(b("to_ceiling") <= t["near_ceiling"], F.abs(a("to_ceiling") - b("to_ceiling")) <= t["height"])
        .when(b("to_floor") <= t["near_floor"], F.abs(a("to_floor") - b("to_floor")) <= t["height"]).otherwise(True)
    )
    return sides & low & way & place


def same_place(a: str, b: str, t: dict = SIMILAR) -> Column:
    """Centres within the pin distance and sides within the tolerance of ``b``."""
    d2 = sum(((F.col(f"{a}c{c}") - F.col(f"{b}c{c}")) * (F.col(f"{a}c{c}") - F.col(f"{b}c{c}")) for c in "xyz"), F.lit(0.0))
    out = d2 <= t["pin_centre"] ** 2
    for k in (1, 2, 3):
        out = out & _within(F.col(f"{a}d{k}"), F.col(f"{b}d{k}"), t["pin_relative"], t["pin_absolute"])
    return out


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(p + c) for c in df.columns))


def _banded(value: Column, relative: float, absolute: float) -> Column:
    """A number that grows with ``value`` and by about 1 over a tolerance's width: evenly up to where the relative one begins, then by the logarithm."""
    turn, width = absolute / relative, float(np.log((1 + relative) / (1 - relative)))
    return F.when(value <= turn, value / (2 * absolute)).otherwise(turn / (2 * absolute) + F.log(F.greatest(value, F.lit(turn)) / turn) / width)


def _by_sides(a: DataFrame, b: DataFrame, relative: float, absolute: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with bands of their sides, and the bands' names: ``b`` is repeated for all bands that its tolerance touches (two a side as a rule)."""
    for k in (1, 2, 3):
        v, wide = F.col(f"b_d{k}"), F.greatest(F.col(f"b_d{k}") * relative, F.lit(absolute))
        band = lambda x: _banded(x, relative, absolute)
        a = a.withColumn(f"s{k}", F.floor(band(F.col(f"a_d{k}"))))
        b = b.withColumn(f"s{k}", F.explode(F.sequence(F.floor(band(v - wide) - SLACK), F.floor(band(v + wide) + SLACK))))
    return a, b, ["s1", "s2", "s3"]


def place_join(left: DataFrame, right: DataFrame, t: dict = SIMILAR) -> DataFrame:
    """Pairs (a_*, b_*) in the same place, with d2; ``right`` sets the tolerance."""
    size = F.lit(t["pin_centre"] * (1 + SLACK))
    b = _prefixed(right, "b_").withColumns({f"k{c}": F.floor(F.col(f"b_c{c}") / size) for c in "xyz"})
    around = F.explode(F.array(*(F.struct(*(F.lit(o).alias(c) for o, c in zip(off, "xyz", strict=True))) for off in product((-1, 0, 1), repeat=3))))
    a, b, sides = _by_sides(_prefixed(left, "a_"), b, t["pin_relative"], t["pin_absolute"])
    a = a.withColumn("o_", around)
    a = a.withColumns({f"k{c}": F.floor(F.col(f"a_c{c}") / size) + F.col(f"o_.{c}") for c in "xyz"}).drop("o_")
    d2 = sum(((F.col(f"a_c{c}") - F.col(f"b_c{c}")) * (F.col(f"a_c{c}") - F.col(f"b_c{c}")) for c in "xyz"), F.lit(0.0))
    keys = ["kx", "ky", "kz", *sides]
    return a.hint("merge").join(b, keys).drop(*keys).where(same_place("a_", "b_", t)).withColumn("d2", d2)


def _nearest_in_place(rows: DataFrame, others: DataFrame, key: str, other: str, t: dict, tolerance: str) -> DataFrame:
    """(key, near_, d2): for each of ``rows`` the nearest of ``others`` in its place, ties to the least ``other``; ``tolerance`` is "rows" or "others".

    Rows that are alike in place and sides are compared once, so copies cost no pairs.
    """
    place = F.struct("cx", "cy", "cz", "d1", "d2", "d3").alias("place_")
    alike = lambda df, k: df.groupBy(place).agg(F.min(k).alias("first_")).select("place_.*", "first_")
    mine, theirs = alike(rows, key), alike(others, other)
    met, p, q = (place_join(theirs, mine, t), "b_", "a_") if tolerance == "rows" else (place_join(mine, theirs, t), "a_", "b_")
    best = met.groupBy(F.col(f"{p}first_").alias("first_")).agg(F.min(F.struct("d2", F.col(f"{q}first_").alias("near_"))).alias("best_"))
    first = mine.select(F.struct("cx", "cy", "cz", "d1", "d2", "d3").alias("place_"), "first_").join(best, "first_")
    return rows.select(key, place).hint("merge").join(first, "place_").select(key, "best_.near_", "best_.d2")


def _fitting(left: DataFrame, right: DataFrame, t: dict, how: str) -> DataFrame:
    """A join of instances (a_*) and models (b_*) that they fit, by the sides' bands and the way."""
    a, b = (df.withColumn("way_", orientation(F.col(f"{p}verticality"))) for p, df in (("a_", left), ("b_", right)))
    a, b, keys = _by_sides(a, b, t["relative"], t["absolute"])
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("way_", *keys)]
    out = a.alias("l").hint("merge").join(b.alias("r"), [*same, matches("a_", "b_", t)], how)
    return out.select("l.*", *(F.col(f"r.{c}").alias(c) for c in right.columns if how == "inner")).drop("way_", *keys)


def model_matches(signatures: DataFrame, models: DataFrame, t: dict = SIMILAR) -> DataFrame:
    """(instance_id, ord, name, target): every model that an instance fits. ``models`` has ord, name, target and a signature's columns."""
    pairs = _fitting(_prefixed(signatures, "a_"), _prefixed(models, "b_"), t, "inner")
    return pairs.select(F.col("a_instance_id").alias("instance_id"), F.col("b_ord").alias("ord"), F.col("b_name").alias("name"), F.col("b_target").alias("target"))


def rejected(signatures: DataFrame, rejections: DataFrame, t: dict = SIMILAR) -> DataFrame:
    """The instances that fit any rejection."""
    return _fitting(_prefixed(signatures, "a_"), _prefixed(rejections, "b_"), t, "left_semi").select(*(F.col(f"a_{c}").alias(c) for c in signatures.columns))


def apply_models(signatures: DataFrame, models: DataFrame, rejections: DataFrame | None = None, targets=("MEP_GENERICO",), t: dict = SIMILAR) -> DataFrame:
    """``signatures`` with the label after all models in their order; what fits a rejection never changes.

    A model applies where the label so far is one of its ``sources`` (or of ``targets``,
    without any) and is not its own. An instance's fitting models are folded in order.
    """
    default = F.array(*(F.lit(CODE[k]) for k in targets)).cast("array<int>")
    have = "sources" in models.columns
    m = models if have else models.withColumn("sources", F.lit(None).cast("array<int>"))
    pairs = _fitting(_prefixed(signatures, "a_"), _prefixed(m, "b_"), t, "inner")
    steps = pairs.groupBy(F.col("a_instance_id").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("b_ord").alias("ord"), F.col("b_target").cast("int").alias("target"), F.col("b_sources").alias("sources")))).alias("steps"))
    fold = F.aggregate("steps", F.col("label").cast("int"), lambda now, s: F.when(F.array_contains(F.coalesce(s["sources"], default), now) & (now != s["target"]), s["target"]).otherwise(now))
    out = signatures.join(steps, "instance_id", "left").withColumn("new_", F.when(F.col("steps").isNull(), F.col("label").cast("int")).otherwise(fold))
    if rejections is not None:
        no = rejected(signatures, rejections, t).select("instance_id", F.lit(True).alias("no_"))
        out = out.join(no, "instance_id", "left").withColumn("new_", F.when(F.col("no_"), F.col("label")).otherwise(F.col("new_")))
    return out.withColumn("label", F.col("new_").cast("smallint")).select(*signatures.columns)


def pin_targets(decisions: DataFrame, signatures: DataFrame, t: dict = SIMILAR) -> DataFrame:
    """(decision, instance_id, d2): the nearest instance in the place of each decision."""
    return _nearest_in_place(decisions, signatures, "decision", "instance_id", t, "rows").withColumnRenamed("near_", "instance_id")


def apply_pins(signatures: DataFrame, confirmations: DataFrame, rejections: DataFrame, t: dict = SIMILAR) -> DataFrame:
    """Rejected instances become WASTE, then confirmed ones take their class; of several confirmations the last decides."""
    no = pin_targets(rejections, signatures, t).select("instance_id", F.lit(CODE["WASTE"]).alias("no_")).distinct()
    yes = pin_targets(confirmations, signatures, t).join(confirmations.select("decision", F.col("label").alias("yes_")), "decision")
    yes = yes.groupBy("instance_id").agg(F.max_by("yes_", "decision").alias("yes_"))
    out = signatures.join(no, "instance_id", "left").join(yes, "instance_id", "left")
    return out.withColumn("label", F.coalesce("yes_", "no_", "label").cast("smallint")).select(*signatures.columns)


def diff_nearest(before: DataFrame, after: DataFrame, t: dict = SIMILAR) -> DataFrame:
    """(instance_id, label_before, label_after): instances whose nearest match in the run before had another class; one row before may serve several."""
    near = _nearest_in_place(after, before, "instance_id", "instance_id", t, "others")
    met = near.join(after.select("instance_id", F.col("label").alias("label_after")), "instance_id").join(before.select(F.col("instance_id").alias("near_"), F.col("label").alias("label_before")), "near_")
    return met.where(F.col("label_after") != F.col("label_before")).select("instance_id", "label_before", "label_after")


def _first_free(batches):
    """(b, a): of rows in the order of (b, a), for each b the first a that none before took."""
    used, done = set(), None
    for batch in batches:
        out_b, out_a = [], []
        for b, a in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), strict=True):
            if b != done and a not in used:
                done = b
                used.add(a)
                out_b.append(b)
                out_a.append(a)
        yield pa.record_batch([pa.array(out_b, batch.schema.field("b").type), pa.array(out_a, batch.schema.field("a").type)], names=["b", "a"])


def diff_greedy(before: DataFrame, after: DataFrame, t: dict = SIMILAR, pairs_at_once: int = PAIRS) -> DataFrame:
    """(id_before, id_after, outcome): stable, changed, lost or new, one to one, the first of ``after`` that is still free for each of ``before`` in order.

    Rounds in parallel: a row of ``before`` is settled once no earlier one wants the same
    partner, so the result is that of going one by one. Where a round settles under half
    of the rows, the rest do go one by one: stretches of ``before`` with some
    ``pairs_at_once`` pairs, each read in order by a task that holds the partners taken.
    """
    from .tables import free as drop
    from .tables import stored

    left = stored(place_join(after, before, t).select(F.col("b_instance_id").alias("b"), F.col("a_instance_id").alias("a")), "pairs")
    taken, rest = left.limit(0), left.count()

    def without(pairs: DataFrame, gone: DataFrame) -> DataFrame:
        return pairs.join(gone.select("b").hint("merge"), "b", "left_anti").join(gone.select("a").hint("merge"), "a", "left_anti").select("b", "a")

    while rest:
        wanted = left.groupBy("b").agg(F.min("a").alias("a"))
        # an earlier row with any claim on the partner could still take it
        claim = left.groupBy("a").agg(F.min("b").alias("first_b"))
        sure = stored(wanted.join(claim, "a").where("b = first_b").select("b", "a"), "sure")
        asked, settled = left.select("b").distinct().count(), sure.count()
        taken = taken.unionByName(sure)
        new = stored(without(left, sure), "free")
        drop(left)
        left, rest = new, new.count()
        if 2 * settled < asked:
            break
    if rest:
        parts = -(-rest // pairs_at_once)
        cuts = sorted(set(left.stat.approxQuantile("b", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            some = left if low is None else left.where(F.col("b") > F.lit(low))
            some = some if high is None else some.where(F.col("b") <= F.lit(high))
            got = stored(without(some, taken).repartition(1).sortWithinPartitions("b", "a").mapInArrow(_first_free, some.schema), "taken")
            taken = taken.unionByName(got)
    old = before.select(F.col("instance_id").alias("b"), F.col("label").alias("lb"))
    new = after.select(F.col("instance_id").alias("a"), F.col("label").alias("la"))
    out = old.join(taken, "b", "left").join(new, "a", "full")
    outcome = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull() | F.col("la").isNull(), "lost").when(F.col("la") == F.col("lb"), "stable").otherwise("changed")
    return out.select(F.col("b").alias("id_before"), F.col("a").alias("id_after"), F.col("lb").alias("label_before"), F.col("la").alias("label_after"), outcome.alias("outcome"))


def stability(diff: DataFrame) -> DataFrame:
    """(label, stable, changed, lost, new): counts of outcomes a class."""
    label = F.coalesce("label_before", "label_after")
    return diff.groupBy(label.alias("label")).pivot("outcome", ["stable", "changed", "lost", "new"]).agg(F.count(F.lit(1))).na.fill(0)


def top_transitions(diff: DataFrame, n: int = 3) -> DataFrame:
    """(label_before, label_after, n, rank): the most frequent changes of each class."""
    counted = diff.where("outcome = 'changed'").groupBy("label_before", "label_after").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label_before").orderBy(F.desc("n"), "label_after")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_places(old: DataFrame, new: DataFrame, t: dict = SIMILAR) -> DataFrame:
    """``old`` without what lies in the place of one of ``new``, and ``new``. Both have ``decision``."""
    gone = place_join(old, new, t).select(F.col("a_decision").alias("decision")).distinct()
    return old.join(gone, "decision", "left_anti").unionByName(new, allowMissingColumns=True)


def decisions(confirmations: DataFrame, rejections: DataFrame) -> DataFrame:
    """Both kinds in one table, with ``kind``."""
    return confirmations.withColumn("kind", F.lit("conferma")).unionByName(rejections.withColumn("kind", F.lit("rifiuto")), allowMissingColumns=True)


def instance_at(points: DataFrame, at: tuple[float, float, float], radius: float = 0.25) -> DataFrame:
    """One row: the instance of the nearest labelled point within ``radius`` of a click, or 0."""
    box = points.where(F.col("instance_id") > 0)
    for c, v in zip("xyz", at, strict=True):
        box = box.where(F.col(c).between(v - radius, v + radius))
    d2 = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("xyz", at, strict=True)), F.lit(0.0))
    near = box.withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return near.agg(F.coalesce(F.min(F.struct("d2", "instance_id")).getField("instance_id"), F.lit(0)).alias("instance_id"))
