"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free, stored

SMALL = 200_000  # edges that one task may hold


def components_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of the nodes 0 to n - 1 reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def _at_once(every: DataFrame) -> DataFrame:
    """(node, component) of the edges ``every`` (a, b) by a single task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, nodes = pd.factorize(pd.concat([pdf["a"], pdf["b"]], ignore_index=True), sort=True)
        root = components_of(codes[: len(pdf)], codes[len(pdf) :], len(nodes))
        return pd.DataFrame({"node": nodes, "component": nodes[root]})

    kind = every.schema["a"].dataType.simpleString()
    return stored(every.groupBy().applyInPandas(run, f"node {kind}, component {kind}"), "labels")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Each round points every node at its least neighbour (or itself), follows the pointers
    twice more, and contracts the edges to what is pointed at; the least node of a
    component only ever points at itself, so it is what remains. Edges shrink round by
    round and each round is written to the shared folder. Edges with a null end are
    ignored; a self loop makes a node its own component. A graph of at most ``small``
    edges, after any round, is finished by one task, with the same result.
    """
    clean = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b"))
    once = stored(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    left = once.where("a <> b")
    if left.count() <= small:
        labels, alone = _at_once(left), once.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
        return labels.unionByName(alone.join(labels.select("node"), "node", "left_anti"))
    nodes = once.select("a").union(once.select("b")).distinct().select(F.col("a").alias("node"))
    labels, old = None, []
    for _ in range(max_rounds):
        both = left.union(left.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        for _ in range(2):
            point = stored(point, "pointers")
            old.append(point)
            ahead = point.select(F.col("node").alias("to"), F.col("to").alias("ahead"))
            point = point.join(ahead, "to").select("node", F.col("ahead").alias("to"))
        point = stored(point, "pointers")
        at = point.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        to = point.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved_edges = left.join(at, "a").join(to, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        old.append(left)
        left = stored(moved_edges.distinct(), "contracted")
        many = left.count()
        steps = [point]
        if 0 < many <= small:
            steps.append(_at_once(left).select("node", F.col("component").alias("to")))
        for step in steps:
            old += [] if labels is None else [labels]
            moved = step.select(F.col("node").alias("component"), "to")
            known = nodes.select("node", F.col("node").alias("component")) if labels is None else labels
            labels = stored(known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        old.append(point)
        free(*(x for x in old if hasattr(x, "stored_at_")))
        old = []
        if many == 0 or len(steps) > 1:
            free(left, once)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dbscan(points: DataFrame, eps: float, min_points: int, pid: str = "pid", within: str | None = None) -> DataFrame:
    """(pid, cluster_id): density clusters, null for noise; ``within`` names a column whose values keep to themselves.

    A core point has at least ``min_points`` within ``eps``, itself with them. Clusters
    are components of core points; a border point joins the least component in reach. A
    cluster is named by its least core point. Tables with fewer rows than ``min_points``
    are all noise.
    """
    from .spatial import pairs_within

    pairs = pairs_within(points, eps, pid)
    if within is not None:
        side = lambda p: points.select(F.col(pid).alias(p), F.col(within).alias(f"{p}_of"))
        pairs = pairs.join(side("src"), "src").join(side("dst"), "dst").where("src_of = dst_of")
    pairs = stored(pairs.select("src", "dst"), "pairs")
    both = pairs.select("src", "dst").unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg((F.count(F.lit(1)) + 1).alias("n"))
    core = points.select(F.col(pid).alias("src")).join(degree, "src", "left").where(F.coalesce("n", F.lit(1)) >= min_points).select("src")
    core = stored(core, "core")
    linked = both.join(core, "src").join(core.select(F.col("src").alias("dst")), "dst")
    alone = core.select("src", F.col("src").alias("dst"))
    labels = connected_components(linked.select("src", "dst").unionByName(alone))
    border = both.join(core, "src", "left_anti").join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("component"))
    found = labels.select(F.col("node").alias(pid), "component").unionByName(border.select(F.col("src").alias(pid), "component"))
    return points.select(pid).join(found, pid, "left").select(pid, F.col("component").alias("cluster_id"))
