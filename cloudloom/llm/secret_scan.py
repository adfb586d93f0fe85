"""Secret scans over an incremental ledger of content-addressed blobs. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds
which (blob, rule version) pairs have been scanned and what was found. A run scans one
representative text of each pair that the ledger lacks, appends to the ledger and joins
the findings back to all paths that hold the blob. Copies are therefore scanned once,
and a second run over the same history scans nothing. Pairs that two runs at a time have
both appended count once.

A hit's place is the sum of what lies before it, taken as a running sum over the hits
of a text as rows, so a text with a million hits costs a sort and no more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans left to right; one stays if group ``group`` has ``least`` code points."""

    kind: str
    pattern: str
    group: int
    least: int


# The rules' names, patterns and least lengths.
RULES = (
    Rule("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),  # runs are whole, so the least length may stand in the pattern
)


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _hits(text, rank: int, rule: Rule):
    """An array of a rule's hits in order: rank, nth, gap (code points since the hit before), size, tested (size of what the least length is for)."""
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tested = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), tested.alias("tested"))
    hits = F.transform(zipped, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["tested"].alias("tested")))
    none = F.array().cast("array<struct<rank:int,nth:int,gap:int,size:int,tested:int>>")
    return F.when(text.rlike(rule.pattern), hits).otherwise(none)


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) of ``blobs`` (blob, text) that have any: spans by start, then rule."""
    hits = blobs.select("blob", F.inline(F.concat(*(_hits(F.col("text"), i, r) for i, r in enumerate(rules))))).repartition("blob")
    order = Window.partitionBy("blob", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order).cast("int"))
    pick = lambda value: F.element_at(F.array(*map(F.lit, value)), F.col("rank") + 1)
    kept = placed.where(F.col("tested") >= pick([r.least for r in rules]))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", pick([r.kind for r in rules]).alias("kind"), "end")
    return kept.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))


def as_text(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(versions: DataFrame, text: str = "text", path: str = "doc_id", ledger: str | None = None, rules=RULES) -> DataFrame:
    """A row for each row of ``versions``: path, blob and ``spans`` (start, rank, kind, end), ordered.

    ``ledger`` is a folder that earlier runs have written; this run appends to it. Without
    one, an empty ledger in the shared folder is begun. A null text is an empty blob; null
    and repeated paths are ordinary rows. An empty table gives no rows.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    schema = f"blob string, rule_version string, spans {SPANS}"
    none = F.array().cast(SPANS)
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    first = rows.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        ledger = scratch_path(spark, "ledger")
    elif _exists(spark, ledger):
        seen = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == version)
        first = first.join(seen.select("blob"), "blob", "left_anti")
    chosen = first.select(F.col("blob").alias("first_blob"), F.col("path").alias("first_path"))
    unseen = rows.join(chosen, (rows["blob"] == F.col("first_blob")) & rows["path"].eqNullSafe(F.col("first_path")), "left_semi")
    hit = unseen.where(F.col("text").rlike("|".join(f"(?:{r.pattern})" for r in rules)))
    scanned = first.select("blob").join(find_spans(hit.dropDuplicates(["blob"]).select("blob", "text"), rules), "blob", "left")
    scanned.select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", none).alias("spans")).write.mode("append").parquet(ledger)
    known = spark.read.schema(schema).parquet(ledger).where((F.col("rule_version") == version) & (F.size("spans") > 0))
    known = known.groupBy("blob").agg(F.first("spans").alias("spans"))  # a pair that was appended twice has the same spans
    return rows.select("path", "blob").join(known, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("spans", none).alias("spans"))


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
