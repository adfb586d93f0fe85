"""Exact dedup over an extendible-hash index kept on shared files. DataFrame functions only.

A text's key is its 64-bit hash after white space is deleted; texts are normalised and
hashed once, in a table that all later steps read. The directory starts as one bucket;
a bucket that holds more than ``bucket_bytes`` is split on its next hash bit, and the
directory doubles when that bit is past its depth. It has at most 2^``MOST_BITS`` slots
(buckets grow where more would be needed), so it may be broadcast.

The directory deals the texts to owner tasks, one a bucket. An owner sorts its texts by
hash and bytes: equal hashes chain, the bytes decide what is one text, and the chain
entry takes the number of copies and the row that stays. A bucket that is still overfull
at the last bit (copies of one text, whose hashes no bit tells apart) has overflow pages,
each with its own owner; what the pages found, one row for each different text, meets
once more in the bucket's owner. The entries are the index, written in the buckets'
order to the shared folder, and every row's answer is looked up in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_free, stored, without_white

BUCKET_BYTES = 32 << 20
MOST_BITS = 17  # of the directory; past 2^17 buckets, buckets grow instead


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory_of(loads: DataFrame, bits: int, bucket_bytes: int) -> DataFrame:
    """The directory for ``loads`` (p: the first ``bits`` bits of a hash, b: bytes): slot, bucket, depth, pages.

    A row for each slot of the doubled directory that holds anything; ``slot`` is a prefix
    of as many bits as the deepest bucket has, ``depth`` the bucket's own. A bucket bears
    the first of its prefixes of ``bits`` bits. ``pages`` is above 1 where the last bit
    has not split a bucket enough.
    """
    depths = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    levels = loads.select("p", "b", depths).groupBy("depth", F.expr(f"shiftright(p, {bits} - depth)").alias("prefix")).agg(F.sum("b").alias("b"))
    levels = stored(levels, "levels")
    full = levels.where((F.col("b") > bucket_bytes) & (F.col("depth") < bits))
    split = full.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    leaves = levels.join(full.select("depth", "prefix"), ["depth", "prefix"], "left_anti")
    leaves = leaves.where("depth = 0").unionByName(leaves.join(split, ["depth", "prefix"], "left_semi"))
    deepest = F.max("depth").over(Window.partitionBy(F.lit(0)))  # a row a bucket
    pages = F.ceil(F.col("b") / bucket_bytes).cast("int")
    leaves = leaves.select("depth", "prefix", F.greatest(pages, F.lit(1)).alias("pages"), (deepest - F.col("depth")).alias("below"))
    slots = F.sequence(F.expr("shiftleft(prefix, below)"), F.expr("shiftleft(prefix + 1, below) - 1"))
    return leaves.select(F.explode(slots).alias("slot"), F.expr(f"shiftleft(prefix, {bits} - depth)").alias("bucket"), "depth", "pages")


def keyed_rows(docs: DataFrame, text: str, doc_id: str, key: Callable[[Column], Column]) -> DataFrame:
    """The stored table of all steps: row, doc_id, cp (code points), raw (hash of the text as it is), norm, h, text_sha256."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), without_white(F.col(text)).alias("norm"))
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("cp"), F.xxhash64("text").alias("raw"),
            "norm", key(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("b"),
        ),
        "keys",
    )


def build_index(keyed: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(index, directory) of :func:`keyed_rows`.

    index: bucket, h, chain, text_sha256, group_size, stays (cp and doc_id of the row that
    stays, and its ``row``) for each different text; ``chain`` numbers the texts of one
    hash. directory: see :func:`directory_of`.
    """
    total = keyed.agg(F.sum("b")).first()[0] or 0
    bucket_bytes = max(bucket_bytes, total >> most_bits)
    bits = min(most_bits, max(0, math.ceil(math.log2(max(1, total / bucket_bytes)))) + 3)
    loads = keyed.groupBy(_prefix(F.col("h"), bits).alias("p")).agg(F.sum("b").alias("b"))
    directory = stored(directory_of(loads, bits, bucket_bytes), "directory")
    depth = directory.agg(F.max("depth")).first()[0] or 0
    placed = keyed.withColumn("slot", _prefix(F.col("h"), depth)).join(F.broadcast(directory), "slot")
    placed = placed.withColumn("page", F.pmod(F.xxhash64("row"), F.col("pages")))
    # an owner task for each bucket, or page of an overfull one: the chains of its hashes, by bytes
    best = F.struct((-F.col("cp")).alias("cp"), F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    owned = placed.repartition("bucket", "page").groupBy("bucket", "page", "h", "norm")
    found = owned.agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("stays"), F.first("text_sha256").alias("text_sha256"), F.first("pages").alias("pages"))
    # pages of one bucket meet, again by bytes; the texts of a bucket with a single page are done and need not move
    met = found.select("bucket", "h", "text_sha256", F.when(F.col("pages") > 1, F.col("norm")).alias("norm"), "n", "stays").repartition("bucket")
    met = met.groupBy("bucket", "h", "norm", "text_sha256").agg(F.sum("n").alias("group_size"), F.min("stays").alias("stays"))
    chained = met.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")))
    return stored(chained.select("bucket", "h", "chain", "text_sha256", "group_size", "stays"), "index"), directory


def _looked_up(keyed: DataFrame, index: DataFrame) -> DataFrame:
    entry = index.select("h", "text_sha256", "bucket", "group_size", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row"))
    return keyed.drop("norm", "b").join(entry, ["h", "text_sha256"]).withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Of rows whose texts are equal without white space, the one with the most code
    points in its own text stays, then the smallest doc_id. A null text is empty; a
    null doc_id comes after all others, and of rows repeated with one doc_id a single
    one is kept. A text of any length is compared whole. An empty table gives no rows. ``key`` is the hash of the index: texts
    whose hashes are equal are told apart by their bytes.
    """
    keyed = keyed_rows(docs, text, doc_id, key)
    index, _ = build_index(keyed, bucket_bytes)
    return _looked_up(keyed, index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their own columns."""
    keyed = keyed_rows(docs, text, doc_id, F.xxhash64)
    kept = _looked_up(keyed, build_index(keyed)[0]).where("kept").select(F.col("raw").alias("raw_kept"), F.col("cp").alias("cp_kept"), F.col("doc_id").alias("id_kept"))
    raw, cp, own, nth = (column_free(docs, c) for c in ("raw", "cp", "own", "nth"))
    rows = docs.withColumns({raw: F.xxhash64(text), cp: F.coalesce(F.length(text), F.lit(0)), own: F.col(doc_id).cast("long")})
    rows = rows.join(kept, rows[own].eqNullSafe(kept["id_kept"]) & (rows[raw] == kept["raw_kept"]) & (rows[cp] == kept["cp_kept"]), "left_semi")
    first = Window.partitionBy(own, raw, cp).orderBy(F.lit(0))  # rows that repeat an id and its text
    return rows.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)
