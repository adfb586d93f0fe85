"""Approximate nearest neighbours by cosine, over robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt to shards by a hash; a shard is as large as
a task's memory allows (:mod:`shards`), so there are as few as may be, and each shard's
graph is built by one task and written to the shared folder. Building inserts nodes in batches: a greedy
search from the shard's middle node proposes neighbours, and pruning keeps the nearest
one and drops what lies closer to it (by the factor ``alpha``, above 1 so that some
longer edges stay) than to the node, again and again. Reverse edges are pruned likewise.
Queries search every shard by beam search, and the best of all shards stay. A shard moves
once and the queries stream past it in batches; what moves is the queries times shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .shards import lists, meet, shards_of

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, INSERTED = 32, 64, 96, 1.2, 256


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the ``beam`` best met by each query, nearest first; -1 and infinity fill.

    All queries take a step together: each expands its nearest node that is not expanded yet.
    """
    m, n = len(queries), len(points)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.zeros((m, beam), bool)
    met = np.zeros((m, n), bool)
    ids[:, 0] = start
    dist[:, 0] = 2 - 2 * queries @ points[start]
    met[:, start] = True
    active = np.arange(m)
    while len(active):
        open_ = np.where((ids[active] >= 0) & ~done[active], dist[active], np.inf)
        col = open_.argmin(axis=1)
        going = np.isfinite(open_[np.arange(len(active)), col])
        active, col = active[going], col[going]
        if not len(active):
            break
        done[active, col] = True
        near = edges[ids[active, col]]
        fresh = (near >= 0) & ~met[active[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        met[active[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = 2 - 2 * np.einsum("id,id->i", queries[active[r]], points[near[r, c]])
        all_d = np.concatenate([dist[active], d], axis=1)
        all_i = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_x = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(active))[:, None]
        dist[active], ids[active], done[active] = all_d[row, best], all_i[row, best], all_x[row, best]
    order = np.argsort(dist, axis=1, kind="stable")
    row = np.arange(m)[:, None]
    return ids[row, order], dist[row, order]


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(n, degree) edges of the nodes ``own`` out of ``candidates`` (n, c; -1 fills), nearest first. Points are unit vectors."""
    at_ = points[candidates]
    dist = 2 - 2 * np.matmul(at_, points[own][:, :, None])[:, :, 0]
    between = 2 - 2 * np.matmul(at_, at_.transpose(0, 2, 1))
    order = np.argsort(candidates, axis=1, kind="stable")
    ranked = np.take_along_axis(candidates, order, axis=1)
    again = np.zeros(ranked.shape, bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    repeated = np.zeros(ranked.shape, bool)
    np.put_along_axis(repeated, order, again, axis=1)
    dist[(candidates < 0) | (candidates == own[:, None]) | repeated] = np.inf
    out = np.full((len(own), degree), -1, np.int64)
    row = np.arange(len(own))
    for k in range(degree):
        at = dist.argmin(axis=1)
        live = np.isfinite(dist[row, at])
        if not live.any():
            break
        out[live, k] = candidates[row, at][live]
        dist[(alpha**2 * between[row, at] <= dist) & live[:, None]] = np.inf
        dist[row, at] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges, start) of a shard's graph; ``points`` are unit vectors in float32. A node has up to half as many edges again as ``degree``."""
    n, width = len(points), degree + degree // 2
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, width), -1, np.int64)
    order = np.random.default_rng(42).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    first = min(n, degree + 1)
    for i in order[:first]:  # the first few know each other
        edges[i, : first - 1] = order[:first][order[:first] != i]
    for turn, alpha_now in enumerate((1.0, alpha)):
        for at in range(first if turn == 0 else 0, n, INSERTED):
            batch = order[at : at + INSERTED]
            found, _ = beam_search(points, edges, start, points[batch], min(beam, n))
            new = robust_prune(points, batch, np.concatenate([found, edges[batch]], axis=1), degree, alpha_now)
            edges[batch] = -1
            edges[batch, :degree] = new
            src, dst = np.repeat(batch, degree), new.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            there = (edges[dst] == src[:, None]).any(axis=1)
            src, dst = src[~there], dst[~there]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            nodes, begin, count = np.unique(dst, return_index=True, return_counts=True)
            if not len(nodes):
                continue
            more = np.full((len(nodes), count.max()), -1, np.int64)
            more[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(begin, count)] = src
            fits = (edges[nodes] >= 0).sum(axis=1) + count <= width
            for own, extra, easy in ((nodes[fits], more[fits], True), (nodes[~fits], more[~fits], False)):
                for block in range(0, len(own), INSERTED):
                    some = own[block : block + INSERTED]
                    both = np.concatenate([edges[some], extra[block : block + INSERTED]], axis=1)
                    if easy:  # all fit: those that are there come first
                        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
                        edges[some] = both[:, :width]
                    else:
                        edges[some] = -1
                        edges[some, :degree] = robust_prune(points, some, both, degree, alpha_now)
    return edges, start


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite).where(F.exists("v", lambda x: x != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1, so that squares neither overflow nor vanish; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def row_bytes(dim: int) -> int:
    """Of a node while its shard is built: the vector three times in doubles, edges, and who has met it."""
    return 24 * dim + 8 * (DEGREE + DEGREE // 2) + INSERTED + 128


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``, but not its own vec_id.

    Score is the cosine of the original vectors in double precision, ties go to the
    smaller vec_id. Vectors that are null, empty, zero or hold a null or a component that
    is not finite take no part, nor do null ids; vectors of other lengths are never
    compared; a vec_id that repeats is a candidate once for each different vector, and a
    query once for each, with ranks of its own. Fewer candidates than ``k`` give all of
    them. ``shard_rows`` sets the size of a shard; by default it follows from a task's memory.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, vec_id, embedding).distinct()
    # of equal vectors, the k + 1 smallest ids are all that an answer can need
    first = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    nodes = members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(nodes.withColumns({"node": F.element_at("ids", 1), "dim": F.size("v")}), "nodes")
    first, count, shards = F.lit(0), F.lit(1), 0
    for r in nodes.groupBy("dim").count().orderBy("dim").collect():  # a row a vector length
        here, mine = shards_of(spark, r["count"], row_bytes(r.dim), shard_rows), F.col("dim") == r.dim
        first, count, shards = F.when(mine, shards).otherwise(first), F.when(mine, here).otherwise(count), shards + here
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dealt = nodes.withColumn("shard", (first + F.pmod(F.xxhash64("v"), count.cast("long"))).cast("int"))

    def build(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("node", ignore_index=True)
        edges, start = build_graph(_unit(np.stack(table["v"].to_numpy())))
        return table.assign(row=np.arange(len(table), dtype=np.int32), start=np.int32(start), edges=list(edges.astype(np.int32)))

    graph = dealt.groupBy("shard").applyInPandas(build, "v array<double>, ids array<long>, node long, dim int, shard int, row int, start int, edges array<int>")
    graph = stored(graph, "graph")
    asked = clean(queries, vec_id, embedding).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"))
    asked = asked.withColumn("turn", F.xxhash64("q")).select(F.explode(F.sequence(first, first + count - 1)).alias("shard"), "query_id", "turn", "q")

    def prepare(g: pa.Table) -> tuple:
        g = g.sort_by("row")
        v = lists(g["v"], "float64")
        points, edges, exact = _unit(v), lists(g["edges"], "int64"), scaled(v)
        return points, edges, g["start"][0].as_py(), g["ids"].to_pylist(), g["node"].to_numpy(), exact, np.sqrt((exact * exact).sum(axis=1))

    def ask(shard: tuple, q: pa.Table) -> pa.RecordBatch:
        points, edges, start, ids, least, v, norms = shard
        w, out = lists(q["q"], "float64"), []
        asked_at, w = _unit(w), scaled(w)
        asked_ids, turns = q["query_id"].to_pylist(), q["turn"].to_pylist()
        for at in range(0, len(w), 256):
            found, _ = beam_search(points, edges, start, asked_at[at : at + 256], min(beam, len(v)))
            for i, near in enumerate(found, at):
                near = near[near >= 0]
                own = np.sqrt((w[i] * w[i]).sum())
                score = (v[near] * w[i]).sum(axis=1) / (norms[near] * own)
                best = np.lexsort((least[near], -score))[: k + 2]
                out += [(asked_ids[i], turns[i], x, s) for j, s in zip(near[best].tolist(), score[best].tolist(), strict=True) for x in ids[j] if x != asked_ids[i]]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "turn", "vec_id", "score"])

    held = graph.select("shard", "v", "ids", "node", "row", "start", "edges")
    found = meet(held, asked, shards, prepare, ask, "query_id long, turn long, vec_id long, score double")
    best = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
