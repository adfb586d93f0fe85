"""Queries meet every shard of an index: each shard moves once, whatever the number of queries.

Rows of shards and copies of the queries are dealt to tasks by shard and sorted so that a
shard's rows come first. A task builds or loads one shard at a time and lets the queries
stream past it in batches: it holds a shard and a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_ROWS = 2048  # of a shard, before a small table is cut for the sake of more tasks
_UNIT = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def task_bytes(spark: SparkSession, share: int = 4) -> int:
    """``1 / share`` of the memory of an executor over its cores, 512 MB at most: what a shard may take."""
    conf = spark.sparkContext.getConf()
    text = conf.get("spark.executor.memory", "1g").lower().rstrip("b")
    memory = int(text[:-1]) * _UNIT[text[-1]] if text[-1] in _UNIT else int(text)
    master = spark.sparkContext.master
    cores = int(conf.get("spark.executor.cores", "0")) or (int(master.split(",")[1]) if master.startswith("local-cluster") else 1)
    return min(512 << 20, memory // cores // share)


def shards_of(spark: SparkSession, rows: int, row_bytes: int, shard_rows: int | None = None) -> int:
    """As few shards as memory allows; a table that is small for that still gives each core one, of ``LEAST_ROWS`` at least."""
    if shard_rows:
        return max(1, -(-rows // shard_rows))
    by_memory = -(-rows // max(LEAST_ROWS, task_bytes(spark) // row_bytes))
    return max(1, by_memory, min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


def _dealt(rows: DataFrame, shards: int, most: int = 2000) -> DataFrame:
    """``rows`` with each shard in a partition of its own; beyond ``most`` shards, in one of four times as many partitions by hash."""
    if shards > most:
        return rows.repartition(4 * shards, "shard")
    slot = F.pmod(F.hash("id"), F.lit(shards))  # numbers that Spark deals to each partition
    found = {r.slot: r.id for r in rows.sparkSession.range(32 * shards).groupBy(slot.alias("slot")).agg(F.min("id").alias("id")).collect()}
    keys = [found.get(s, s) for s in range(shards)]
    return rows.withColumn("key", F.element_at(F.array(*(F.lit(k).cast("long") for k in keys)), F.col("shard") + 1)).repartition(shards, "key").drop("key")


def meet(points: DataFrame, queries: DataFrame, shards: int, prepare: Callable[[pa.Table], Any], ask: Callable[[Any, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``ask(prepare(rows of a shard), some queries)`` gives for each row of ``queries`` and its shard; both tables have ``shard``, 0 to ``shards`` - 1. Queries of a shard without rows give nothing."""
    p, q = (F.struct(*(c for c in df.columns if c != "shard")) for df in (points, queries))
    kind = lambda df, own: df.schema[own].dataType
    left, right = points.select("shard", p.alias("p")), queries.select("shard", q.alias("q"))
    both = left.select("shard", F.lit(0).alias("kind"), "p", F.lit(None).cast(kind(right, "q")).alias("q")).unionByName(
        right.select("shard", F.lit(1).alias("kind"), F.lit(None).cast(kind(left, "p")).alias("p"), "q")
    )
    dealt = _dealt(both, shards).sortWithinPartitions("shard", "kind")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, at = None, None
        for batch in parts:
            key = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                shard, is_query = divmod(int(key[a]), 2)
                if shard != at:
                    held, index, at = [], None, shard
                some = batch.slice(a, b - a).column(2 + is_query)
                fields = pa.Table.from_arrays(some.flatten(), names=[f.name for f in some.type])
                if not is_query:
                    held.append(fields)
                    continue
                if held:
                    index, held = prepare(pa.concat_tables(held)), []
                if index is not None:
                    yield ask(index, fields)

    return dealt.mapInArrow(run, schema)


def lists(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().astype(kind).reshape(len(flat), -1)
