"""Line dedup: lines that many documents share stay in one of them. DataFrame functions only.

Lines are exploded and hashed (two 64-bit hashes), the documents of each hash are
counted, and the lines over the threshold are dropped where each document is put
together again, by position. Only hashes and positions move by line; a text moves
once, to meet its own dropped positions.

Counting combines on the map side, so a line that all documents share is as cheap as any.
To find a shared line's places again, the most frequent hashes go to all tasks: those
with more than 1 / ``MANY`` of all lines, of which there are fewer than ``MANY``. Lines of
other hashes meet theirs by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, stored

NO_ID = -(1 << 63)
MANY = 20_000


def line_key(line):
    """What makes two lines the same: no white space at the ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """Each row of ``docs`` as doc_id, text, n_lines, n_dropped, with ``text`` after the drops.

    Keys of at least ``min_length`` code points in at least ``min_docs`` documents lose
    their lines except in the largest doc_id that holds them. A null text is one empty
    line. Rows that share a doc_id count as one document; a null doc_id is one document
    below all others. A text of any length is read whole, in time linear in its lines. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("of", F.coalesce("doc_id", F.lit(NO_ID)))
    long_enough = rows.where(F.length("text") >= min_length).select("of", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = long_enough.where(F.length("line") >= min_length).select("of", "body", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    lines = stored(keyed.select("of", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("of").alias("n"), F.count(F.lit(1)).alias("lines"), F.max("of").alias("stays"))
    shared = stored(counted.where(F.col("n") >= min_docs).select("h1", "h2", "stays", "lines"), "shared")
    often = F.col("lines") > max(1000, lines.count() // MANY)
    heavy, usual = shared.where(often).drop("lines"), shared.where(~often).drop("lines")
    of_heavy = F.broadcast(heavy.select("h1", "h2", "stays"))
    rest = lines.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti")
    places = lines.join(of_heavy, ["h1", "h2"]).unionByName(rest.join(usual, ["h1", "h2"]))
    gone = places.where("of <> stays").groupBy("of", "body").agg(F.collect_set("pos").alias("gone"))
    cut = rows.select("doc_id", "of", F.xxhash64("text").alias("body"), F.split("text", "\n", -1).alias("lines"))  # below the join, so that it is split once
    met = cut.join(stored(gone, "gone"), ["of", "body"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by a hash set: a text's work is linear in its lines
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return met.select("doc_id", F.array_join(left, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
