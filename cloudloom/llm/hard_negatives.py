"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector gets one component more, the root of what its squared norm lacks to the largest
of all; anchors get a zero there. Inner products then are distances: the higher the score,
the nearer, and a window of scores is an annulus around the anchor. A tree halves its
vectors by their distance to a vantage point, down to leaves, and keeps the least and
greatest distance of each half, so the triangle inequality bounds an anchor's scores with all that
a node holds. A search goes to the leaves of the highest possible scores first, leaves out
those outside the annulus, and stops when none left can hold a better row than the k found.
What a leaf holds is scored exactly, in integers, for all anchors that come to it together.

Rows of all labels are dealt to shards by a hash, each shard is a tree in one task, and
anchors meet every shard twice: for their positives, then for the negatives of all their
positives in one walk. Trees are built where they are used: that costs less than reading
them. The best of all shards stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .shards import lists, meet, shards_of

LEAF = 512  # rows that are scored together
EXACT = float(1 << 53)
FAR = 1 << 62  # beyond all scores


class Tree:
    """A vantage-point tree over integer vectors with labels and ids; ``most`` is the largest squared norm of all shards."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: int, leaf: int = LEAF) -> None:
        self.most = float(most)
        wide = (v.astype(float) ** 2).sum(axis=1)
        self.exact = self.most < EXACT  # no sum of products of two vectors is larger
        points = np.column_stack([v.astype(float), np.sqrt(np.maximum(self.most - wide, 0))])
        order = np.lexsort((labels, ids))
        draw = np.random.default_rng(42)
        self.vantage: list[int] = []
        self.near: list[tuple[float, float, float, float]] = []  # least and greatest distance of the inner and outer half
        self.child: list[tuple[int, int]] = []  # of a leaf (-1, -1)
        self.span: list[tuple[int, int]] = []
        self.kinds: list[frozenset[int] | None] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.span)
            self.span.append((a, b))
            self.child.append((-1, -1))
            self.vantage.append(-1)
            self.near.append((0.0, 0.0, 0.0, 0.0))
            some = np.unique(labels[order[a:b]])
            self.kinds.append(frozenset(some.tolist()) if len(some) <= 16 else None)
            if parent >= 0:
                pair = list(self.child[parent])
                pair[side] = me
                self.child[parent] = tuple(pair)
            if b - a <= leaf:
                continue
            own = order[a:b]
            centre = own[draw.integers(len(own))]
            d = np.sqrt(np.maximum(((points[own] - points[centre]) ** 2).sum(axis=1), 0))
            by, half = np.argsort(d, kind="stable"), (b - a) // 2
            order[a:b], d = own[by], d[by]
            self.vantage[me], self.near[me] = int(centre), (d[0], d[half - 1], d[half], d[-1])
            todo += [(a + half, b, me, 1), (a, a + half, me, 0)]
        kind = float if self.exact else np.int64
        self.centres = v[[max(x, 0) for x in self.vantage]].astype(float)
        self.leaves = np.array([n for n, (x, _) in enumerate(self.child) if x < 0])
        for node in self.leaves.tolist():  # by id, so that the first of equal scores is the one that wins
            a, b = self.span[node]
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        self.ids, self.labels, self.v = ids[order], labels[order], v[order].astype(kind)

    def bounds(self, q: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distance of each query to what each leaf holds, by the triangle inequality from the root down."""
        to = np.sqrt(np.maximum(size[:, None] - 2 * (q.astype(float) @ self.centres.T), 0))
        near, far = np.zeros((len(q), len(self.span))), np.full((len(q), len(self.span)), np.inf)
        for node, (inner, outer) in enumerate(self.child):
            if inner >= 0:
                d, (a, b, c, e) = to[:, node], self.near[node]
                near[:, inner], far[:, inner] = np.maximum(near[:, node], np.maximum(a - d, d - b)), np.minimum(far[:, node], d + b)
                near[:, outer], far[:, outer] = np.maximum(near[:, node], np.maximum(c - d, d - e)), np.minimum(far[:, node], d + e)
        return near[:, self.leaves], far[:, self.leaves]

    def search(self, queries: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each (queries, windows, k): for each window (``low`` to ``high``, both in; low above high is none) the rows of the highest scores, ties by smaller id; -FAR fills.

        Rows are of the query's label, without its own id, or of others. All queries walk
        together, each to its next nearest leaf; a leaf scores those that have come to it.
        """
        m, windows = low.shape
        q = queries.astype(self.v.dtype)
        size = (queries.astype(float) ** 2).sum(axis=1) + self.most
        slack = 1 + 1e-7 * size  # above what roots and differences round
        near, far = self.bounds(queries, size)
        top, bottom = (size[:, None] - near**2) / 2 + slack[:, None], (size[:, None] - far**2) / 2 - slack[:, None]
        order = np.argsort(near, axis=1, kind="stable")
        least = np.where(low <= high, low, FAR)  # what a row must score to be of use to a window
        score, ids = np.full((m, windows, k), -FAR, np.int64), np.full((m, windows, k), FAR, np.int64)
        walking = np.arange(m)
        for step in range(len(self.leaves)):
            walking = walking[top[walking, order[walking, step]] >= least[walking].min(axis=1)]  # else all that is left is farther
            if not len(walking):
                break
            at = order[walking, step]
            of_use = ((least[walking] <= top[walking, at][:, None]) & (high[walking] >= bottom[walking, at][:, None])).any(axis=1)
            come, at = walking[of_use], at[of_use]
            by = np.argsort(at, kind="stable")
            leaf, first = np.unique(at[by], return_index=True)
            for node, who in zip(self.leaves[leaf].tolist(), np.split(come[by], first[1:]), strict=True):
                kinds = self.kinds[node]
                if kinds is not None:
                    has = np.isin(own_labels[who], list(kinds))
                    who = who[has] if same else who[~has] if len(kinds) == 1 else who
                if len(who):
                    self._score(node, who, q, own_ids, own_labels, same, least, high, score, ids)
        return score, ids

    def _score(self, node, who, q, own_ids, own_labels, same, least, high, score, ids) -> None:
        """The rows of a leaf for the queries ``who``: ``score``, ``ids`` and ``least`` take what is better."""
        a, b = self.span[node]
        k = score.shape[2]
        s = (q[who] @ self.v[a:b].T).astype(np.int64)
        equal = self.labels[a:b] == own_labels[who][:, None]
        s[~(equal & (self.ids[a:b] != own_ids[who][:, None])) if same else equal] = -FAR
        for w in range(score.shape[1]):
            fits = np.where((s >= least[who, w][:, None]) & (s <= high[who, w][:, None]), s, -FAR)
            hit = np.flatnonzero(fits.max(axis=1) > -FAR)
            if not len(hit):
                continue
            fits, mine = fits[hit], who[hit]
            row, new = np.arange(len(hit)), [[], []]
            for _ in range(min(k, b - a)):
                best = fits.argmax(axis=1)
                new[0].append(fits[row, best])
                new[1].append(np.where(fits[row, best] > -FAR, self.ids[a + best], FAR))
                fits[row, best] = -FAR
            both, of = (np.concatenate([old[mine, w], np.stack(x, axis=1)], axis=1) for old, x in zip((score, ids), new, strict=True))
            best = np.lexsort((of, -both), axis=1)[:, :k]
            score[mine, w], ids[mine, w] = np.take_along_axis(both, best, axis=1), np.take_along_axis(of, best, axis=1)
            least[mine, w] = np.maximum(least[mine, w], score[mine, w, -1])


def scored_rows(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, dim, v) of the rows that take part, equal ones once. Components saturate where a hundred times a score would not fit a long."""
    x = F.col("x")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    bound = F.floor(F.sqrt(F.lit(float(1 << 56)) / F.size(x)))
    v = F.transform(x, lambda e: F.floor(F.least(F.greatest(scale * e, -bound.cast("double")), bound.cast("double"))).cast("int"))
    return rows.where(good).select("vec_id", "label", F.size(x).alias("dim"), v.alias("v")).distinct()


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", label: Column | None = None, shard_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1 for each anchor and positive.

    ``anchors`` is a condition on ``vec_id``. Components become floor(scale * x), a score
    is the inner product of those. An anchor's positives are the ``positives`` rows of its
    label and another id with the highest scores; for each, the ``negatives`` rows of other
    labels with the highest scores in ``window`` per cent of the positive's stay. Ties go to
    the smaller id; fewer rows give all of them. All rows are searched and the result is exact.

    Rows without an id or label, and vectors that are null, empty or hold a null or a
    component that is not finite take no part; vectors of other lengths are never compared.
    Rows equal in id, label and vector count once; other rows that share an id count each, as
    an anchor too. An empty table gives no rows. ``shard_rows`` sets the size of a shard; by
    default it follows from a task's memory.
    """
    spark = vectors.sparkSession
    rows = stored(scored_rows(vectors, vec_id, embedding, F.col("label") if label is None else label, scale), "rows")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, e: s + e.cast("long") * e.cast("long"))
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).orderBy("dim").collect()  # a row a vector length
    shards, first, count, most = 0, F.lit(0), F.lit(1), F.lit(0).cast("long")
    for r in dims:
        here, mine_ = shards_of(spark, r.n, 24 * r.dim + 64, shard_rows), F.col("dim") == r.dim
        first, count, most = F.when(mine_, shards).otherwise(first), F.when(mine_, here).otherwise(count), F.when(mine_, r.most).otherwise(most)
        shards += here
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not shards:
        return spark.createDataFrame([], empty)
    points = rows.select((first + F.pmod(F.xxhash64("vec_id", "v"), count.cast("long"))).cast("int").alias("shard"), "vec_id", "label", "v", most.alias("most"))
    asked = stored(rows.where(anchors).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    everywhere = F.explode(F.sequence(first, first + count - 1)).alias("shard")

    def prepare(t: pa.Table) -> Tree:
        return Tree(t["vec_id"].to_numpy(), t["label"].to_numpy(), lists(t["v"], "int64"), t["most"][0].as_py())

    def ask_same(tree: Tree, q: pa.Table) -> pa.RecordBatch:
        m = len(q)
        whole = np.full((m, 1), FAR)
        s, ids = tree.search(lists(q["v"], "int64"), q["vec_id"].to_numpy(), q["label"].to_numpy(), True, -whole + 1, whole, positives)
        which, _, nth = np.nonzero(s > -FAR)
        return pa.record_batch([pa.array(q["anchor"].to_numpy()[which]), pa.array(ids[which, 0, nth]), pa.array(s[which, 0, nth])], names=["anchor", "positive_id", "score"])

    same = meet(points, asked.select(everywhere, "anchor", "vec_id", "label", "v"), shards, prepare, ask_same, "anchor long, positive_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    best = same.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    best = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "score"))).alias("best"))  # a few an anchor
    with_best = stored(asked.join(best, "anchor").select("anchor", "dim", "vec_id", "label", "v", F.col("best.positive_id").alias("ids"), F.col("best.score").alias("scores")), "positives")
    a, b = window

    def ask_others(tree: Tree, q: pa.Table) -> pa.RecordBatch:
        held = q["scores"].to_pylist()
        scores = np.array([x + [0] * (positives - len(x)) for x in held], np.int64).reshape(-1, positives)
        real = np.arange(positives) < np.array([len(x) for x in held])[:, None]
        low, high = np.where(real, -(-a * scores // 100), FAR), np.where(real, b * scores // 100, -FAR)
        s, ids = tree.search(lists(q["v"], "int64"), q["vec_id"].to_numpy(), q["label"].to_numpy(), False, low, high, negatives)
        which, w, nth = np.nonzero(s > -FAR)
        of = np.array([x + [0] * (positives - len(x)) for x in q["ids"].to_pylist()], np.int64).reshape(-1, positives)
        columns = (q["anchor"].to_numpy()[which], q["vec_id"].to_numpy()[which], w, of[which, w], scores[which, w], ids[which, w, nth], s[which, w, nth])
        return pa.record_batch([pa.array(c) for c in columns], names=["anchor", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"])

    kinds = "anchor long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long"
    others = meet(points, with_best.select(everywhere, "anchor", "vec_id", "label", "v", "ids", "scores"), shards, prepare, ask_others, kinds)
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

