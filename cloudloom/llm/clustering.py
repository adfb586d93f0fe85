"""Centroid clustering in integers, by transfers: a round does only what the last one changed.

Vectors are kept as integers with their owner and their distance to it, in a table of the
shared folder. A round knows the centroids before and after the last update. A vector
whose owner did not move keeps its distance and meets only the centroids that moved; one
whose owner moved meets all. Vectors that change owner are taken from the sums of the old
one and added to those of the new: signed integers, added up within each batch, then by
Spark into the table of all clusters' sums, which so stays exact while only vectors that
moved are added. The table of a round is written where its rows are: nothing is shuffled
but a row a batch and cluster. When no centroid moved, the rounds that are left change
nothing. The driver holds the centroids alone, a few integers a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import free
from .common import stored

LARGEST = 1 << 27  # integers saturate here, so that a distance of up to 64 components is an exact long
EXACT = 1 << 22  # up to here products add up exactly in doubles
NONE = -1  # owner of a vector that has none yet


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and v.shape[1] <= 64:
        a, b = v.astype(float), centroids.astype(float)  # sums below 2^53
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) now. ``moved`` tells which centroids are not where the old distances were taken."""
    owner, distance, which = owner.copy(), distance.copy(), np.flatnonzero(moved)
    lost = (owner == NONE) | moved[owner]
    if lost.any():
        d = distances(v[lost], centroids)
        owner[lost], distance[lost] = d.argmin(axis=1), d.min(axis=1)
    stay = np.flatnonzero(~lost)
    if len(stay) and len(which):
        d = distances(v[stay], centroids[which])
        best, least = which[d.argmin(axis=1)], d.min(axis=1)
        nearer = (least < distance[stay]) | ((least == distance[stay]) & (best < owner[stay]))
        owner[stay[nearer]], distance[stay[nearer]] = best[nearer], least[nearer]
    return owner, distance


def integers(vectors: DataFrame, embedding: str, width: int, scale: int) -> DataFrame:
    """Rows of ``vectors`` with exactly ``width`` finite components, those as ``v``: floor(scale * x), saturated at ``LARGEST``."""
    x = F.col(embedding).cast("array<double>")
    good = (F.size(x) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    floor = F.transform(x, lambda e: F.floor(F.least(F.greatest(scale * e, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return vectors.where(good).withColumn("v", floor)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _round(table: DataFrame, before: np.ndarray | None, centroids: np.ndarray, width: int, name: str) -> DataFrame:
    """``table`` with owners by ``centroids`` (those of its distances are ``before``) and ``was``, the owner it had; written."""
    moved = np.ones(len(centroids), bool) if before is None else (before != centroids).any(axis=1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            was = batch.column("owner").to_numpy()
            owner, distance = assign(_rows(batch, width), was.astype(np.int64), batch.column("distance").to_numpy(), centroids, moved)
            cols = {"owner": pa.array(owner.astype(np.int32)), "distance": pa.array(distance), "was": pa.array(was)}
            yield pa.record_batch([cols.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return stored(table.mapInArrow(run, table.schema), name)


def _new_sums(table: DataFrame, old: DataFrame | None, k: int, width: int, name: str) -> DataFrame:
    """(cluster, n, s0, s1, ...): the sums of ``old`` and what vectors that changed owner take from and bring to each cluster; written."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            v, n = _rows(batch, width), np.zeros(k, np.int64)
            sums = np.zeros((k, width), np.int64)
            for column, sign in (("was", -1), ("owner", 1)):
                of = batch.column(column).to_numpy()
                order = np.argsort(of, kind="stable")[(of < 0).sum() :]
                if len(order):
                    who, at = np.unique(of[order], return_index=True)
                    sums[who] += sign * np.add.reduceat(v[order], at, axis=0)
                    n += sign * np.bincount(of[order], minlength=k)
            there = np.flatnonzero((sums != 0).any(axis=1) | (n != 0))
            yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(sums[there].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    each = table.where("was <> owner").select("was", "owner", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    each = each.select("cluster", "n", *(F.get("sums", F.lit(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(width)))
    both = each if old is None else each.unionByName(old)
    return stored(both.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))), name)


def _means(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """``centroids`` where non-empty clusters took the floor of their mean."""
    out = centroids.copy()
    for r in sums.where("n > 0").collect():  # a row a cluster
        out[r.cluster] = [int(s) // r.n for s in r[2:]]
    return out


def _freed(new: DataFrame, old: DataFrame | None) -> DataFrame:
    if old is not None:
        free(old)
    return new


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1:", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part, after ``rounds`` updates and one more assignment.

    Vectors that are null, of another width, or hold a null or a component that is not
    finite take no part; components become floor(scale * x), saturated at 2^27 either way.
    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed`` and vec_id
    (null: of ``seed`` alone), rows that repeat an id in the order of their vectors; fewer
    vectors make fewer clusters. Of equal distances the smaller cluster wins. Rows that
    repeat count each; sums beyond a long saturate. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = integers(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")), "embedding", width, scale)
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    table = stored(own.select("vec_id", "v", F.lit(NONE).alias("owner"), F.lit(0).cast("long").alias("distance"), F.lit(NONE).alias("was")), "vectors")
    first = table.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    before, now, sums = None, np.array([r.v for r in first], np.int64), None
    for turn in range(rounds + 1):
        table = _freed(_round(table, before, now, width, f"owners{turn}"), table)
        if turn == rounds:
            break
        sums = _freed(_new_sums(table, sums, len(first), width, f"sums{turn}"), sums)
        before, now = now, _means(now, sums)
        if (before == now).all():
            break
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.owner: r.s for r in table.groupBy("owner").agg(total.alias("s")).collect()}  # a row a cluster
    most = (1 << 63) - 1
    whole = min(most, sum(int(s) for s in inertia.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    about = spark.createDataFrame([(c, min(most, int(s)), whole, sha[c]) for c, s in sorted(inertia.items())], "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(about), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
