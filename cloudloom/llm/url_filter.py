"""URL filter: rules first, then the ratio of two character models.

Rules name a host and the start of a path; the longest that fits decides. What no rule
decides is judged by variable-order Markov models of bytes, one learnt from URLs that
rules allow and one from URLs that rules block. A model gives a byte after its last
``ORDER`` bytes the Witten-Bell mixture of all shorter contexts: the seen share of a
context, and for the rest, as likely as new bytes were after it, the next shorter one, down
to all bytes alike. A URL's score is the difference of its log likelihoods over its length
(with an end mark), and the cut between both verdicts is the one that errs least, each class
weighing the same, on the fifth of the URLs that the models have not seen.

All URLs that rules decide are learnt or, that fifth, tell the cut; copies of a URL count
once. The models stay tables of counts and no task holds them whole: all orders from
``LOW`` on of a key are in the group of the two bytes before it, and the lower orders are
at most 65,792 pairs. URLs are scored in blocks: the different keys of a block are joined
with their ratios, and those that come back are summed along its URLs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import free
from .common import LOWER, UPPER, column_free, stored
from .tokens import batches

ORDER = 5  # bytes of context at most; a context and its byte fit one 64-bit key
LOW = 2  # so many orders are whole in every task
GROUPS, GROUP_KEYS = 256, 200_000  # groups of contexts at least, and keys of a group, about
BLOCK_BYTES = 1 << 20  # of URLs that are scored together
FEW = 1 << 18  # counts that the driver may hold to score some URLs itself
START, END = 0xFF, 0xFE  # bytes that UTF-8 does not have
WINDOW = 1 << 19  # positions that are looked up together
ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str, str]  # verdict, host, start of the path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of name and verdict of the longest rule that fits; null if none does. A rule fits its host and all subdomains. Of rules as long the one with the longer host wins."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(own + start).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def keys_of(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the byte and the ``ORDER`` before it as one number, the URL's place) for each byte and the end mark of each URL."""
    size = np.fromiter(map(len, urls), np.int64, len(urls))
    flat = np.frombuffer(b"".join(bytes([START]) * ORDER + u + bytes([END]) for u in urls), np.uint8)
    own = np.ones(len(flat), bool)
    first = np.cumsum(size + ORDER + 1) - (size + ORDER + 1)
    own[(first[:, None] + np.arange(ORDER)).ravel()] = False
    at = np.flatnonzero(own)
    key = np.zeros(len(at), np.uint64)
    for back in range(ORDER, -1, -1):
        key = key << np.uint64(8) | flat[at - back].astype(np.uint64)
    return key, np.repeat(np.arange(len(urls)), size + 1)


@dataclass
class Markov:
    """For each order n: contexts with their bytes (sorted) and the mixture's likelihoods, and contexts (sorted) with the weight of the next shorter ones."""

    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, low: Markov | None = None, orders: int = ORDER + 1) -> Markov:
        """From counts of the longest keys, in which all shorter ones are. What ``low`` has of the lower orders is taken from there."""
        out = cls(list(low.pairs), list(low.contexts)) if low else cls()
        for n in range(len(out.pairs), orders):
            pair, at = np.unique(keys & np.uint64((1 << 8 * (n + 1)) - 1), return_inverse=True)
            seen = np.bincount(at, counts, len(pair))
            context, of, kinds = np.unique(pair >> np.uint64(8), return_inverse=True, return_counts=True)
            every = np.bincount(of, seen, len(context))
            out.contexts.append((context, kinds / (every + kinds) if len(context) else np.zeros(0)))
            out.pairs.append((pair, (seen + kinds[of] * out.likelihood(pair, n)) / (every + kinds)[of]))
        return out

    def likelihood(self, keys: np.ndarray, orders: int = ORDER + 1) -> np.ndarray:
        """Of each key's byte after its context, by contexts shorter than ``orders``."""
        p = np.full(len(keys), 1 / 256)
        for n in range(orders):
            p *= _found(self.contexts[n], keys >> np.uint64(8) & np.uint64((1 << 8 * n) - 1), 1.0)
            p = np.where((q := _found(self.pairs[n], keys & np.uint64((1 << 8 * (n + 1)) - 1), -1.0)) >= 0, q, p)
        return p


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, other: float) -> np.ndarray:
    own, value = table
    if not len(own):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, value[at], other)


@dataclass
class Model:
    allowed: Markov
    blocked: Markov
    cut: float = 0.0

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Log likelihood ratio a byte of each URL, above 0 if it is likelier among allowed ones."""
        keys, of = keys_of(urls)
        total = np.zeros(len(urls))
        for at in range(0, len(keys), WINDOW):
            each, back = np.unique(keys[at : at + WINDOW], return_inverse=True)  # hosts and paths repeat: each context once
            ratio = _ratios(self.allowed, self.blocked, each)
            total += np.bincount(of[at : at + WINDOW], ratio[back], len(urls))
        return total / (np.fromiter(map(len, urls), np.int64, len(urls)) + 1)


def _least_errors(s: np.ndarray, a: np.ndarray, b: np.ndarray, all_a: int, all_b: int, low_a: int = 0, low_b: int = 0, before: float | None = None, last: bool = True) -> tuple[int, float]:
    """(errors times both classes' sizes, the cut) where that is least, of equal ones nearest to 0: ``a`` allowed and ``b`` blocked have each of the scores ``s`` (ascending), ``low_a`` and ``low_b`` a lower one, of which ``before`` is the highest."""
    below_a, below_b = (low + np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for low, x in ((low_a, a), (low_b, b)))
    errors = below_a * all_b - below_b * all_a
    edge = np.concatenate([[s[0] - 1e-9 if before is None else (before + s[0]) / 2], (s[1:] + s[:-1]) / 2, [s[-1] + 1e-9]])
    if not last:
        errors, edge = errors[:-1], edge[:-1]
    good = edge[errors == errors.min()]
    return int(errors.min()), float(good[np.argmin(np.abs(good))])


def best_cut(scores: np.ndarray, allowed: np.ndarray) -> float:
    """The cut with the fewest errors, both classes weighing the same: allowed are scores from it on. Of equal ones the nearest to 0; 0 if a class is missing."""
    if not len(scores) or allowed.all() or not allowed.any():
        return 0.0
    s, at = np.unique(scores, return_inverse=True)
    a, b = (np.bincount(at, x, len(s)).astype(np.int64) for x in (allowed, ~allowed))
    return _least_errors(s, a, b, int(a.sum()), int(b.sum()))[1]


def cut_of(scored: DataFrame) -> float:
    """:func:`best_cut` of all rows of ``scored`` (allowed, score), by ranges of scores: the driver gets a row for each range."""
    counts = scored.groupBy("score").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b"))
    ranged = stored(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = ranged.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("score").alias("least"), F.max("score").alias("most")).collect()
    all_a, all_b = sum(r.a for r in parts), sum(r.b for r in parts)
    if not all_a or not all_b:
        return 0.0
    given, low_a, low_b, before = {}, 0, 0, None
    for k, r in enumerate(sorted(parts, key=lambda r: r.least)):
        given[r.part] = (low_a, low_b, before, k + 1 == len(parts))
        low_a, low_b, before = low_a + r.a, low_b + r.b, r.most

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        return pd.DataFrame([_least_errors(*(rows[c].to_numpy() for c in ("score", "a", "b")), all_a, all_b, *given[rows["part"].iloc[0]])], columns=["errors", "cut"])

    found = ranged.groupBy("part").applyInPandas(least, "errors long, cut double").collect()
    free(ranged)
    return min(found, key=lambda r: (r.errors, abs(r.cut), r.cut)).cut


def _bytes_of(urls: pd.Series) -> list[bytes]:
    return [u.encode("utf-8", "surrogatepass") for u in urls]


def _numbers(table: pa.Table, name: str = "key") -> np.ndarray:
    return table[name].to_numpy().astype(np.int64).view(np.uint64)


def _ratios(allowed: Markov, blocked: Markov, keys: np.ndarray) -> np.ndarray:
    return np.log(allowed.likelihood(keys)) - np.log(blocked.likelihood(keys))


@dataclass
class Counted:
    """Both models as a table of counts (verdict, key, n) of the longest keys, ``size`` rows; ``low`` has their orders below ``LOW``."""

    counts: DataFrame
    size: int
    low: Model
    cut: float = 0.0
    whole: Model | None = None

    @classmethod
    def of(cls, urls: DataFrame) -> Counted:
        """From different ``urls`` (url, verdict)."""

        def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(parts, "url"):
                for verdict, rows in batch.to_pandas().groupby("verdict"):
                    key, times = np.unique(keys_of(_bytes_of(rows["url"]))[0], return_counts=True)
                    yield pa.record_batch([pa.array([verdict] * len(key)), pa.array(key.view(np.int64)), pa.array(times)], names=["verdict", "key", "n"])

        counts = urls.select("url", "verdict").mapInArrow(count, "verdict string, key long, n long").groupBy("verdict", "key").agg(F.sum("n").alias("n"))
        counts = stored(counts, "counts")
        low = counts.groupBy("verdict", F.col("key").bitwiseAND((1 << 8 * LOW) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows a verdict at most
        return cls(counts, counts.count(), Model(*(Markov.of(*_own(low, v), orders=LOW) for v in (ALLOW, BLOCK))))

    def ratios(self, keys: DataFrame) -> DataFrame:
        """(key, ratio): the log of how much likelier each of the different ``keys`` (key) is among allowed URLs."""
        groups = max(GROUPS, (self.size + keys.count()) // GROUP_KEYS)
        group = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(groups)).alias("group")  # a key's two bytes before its last
        low = keys.sparkSession.sparkContext.broadcast(self.low)

        def run(own: pa.Table, asked: pa.Table) -> pa.Table:
            key = _numbers(asked)
            allowed, blocked = (Markov.of(*_own(own, v), low=x) for v, x in ((ALLOW, low.value.allowed), (BLOCK, low.value.blocked)))
            return pa.table({"key": asked["key"], "ratio": pa.array(_ratios(allowed, blocked, key) if len(key) else np.zeros(0))})

        side = lambda df: df.select("*", group).groupBy("group")
        return side(self.counts).cogroup(side(keys.select("key"))).applyInArrow(run, "key long, ratio double")

    def scored(self, urls: DataFrame) -> DataFrame:
        """(url, score) of the different ``urls`` (url), none null."""

        def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = TaskContext.get().partitionId() << 33
            for k, batch in enumerate(batches(parts, "url", BLOCK_BYTES)):
                yield pa.record_batch([pa.array(np.full(batch.num_rows, first + k)), batch.column(0)], names=["block", "url"])

        def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(parts, "url"):
                for block, rows in batch.to_pandas().groupby("block"):
                    key = np.unique(keys_of(_bytes_of(rows["url"]))[0])
                    yield pa.record_batch([pa.array(np.full(len(key), block)), pa.array(key.view(np.int64))], names=["block", "key"])

        def total(rows: pa.Table, known: pa.Table) -> pa.Table:
            texts, key, ratio = _bytes_of(rows["url"].to_pylist()), _numbers(known), known["ratio"].to_numpy()
            order = np.argsort(key)
            each, of = keys_of(texts)
            got = np.bincount(of, ratio[order][np.searchsorted(key, each, sorter=order)], len(texts))
            return pa.table({"url": rows["url"], "score": pa.array(got / (np.fromiter(map(len, texts), np.int64, len(texts)) + 1))})

        blocks = stored(urls.select("url").mapInArrow(cut, "block long, url string"), "blocks")
        keyed = stored(blocks.mapInArrow(keys, "block long, key long"), "keys")
        asked = stored(keyed.select("key").distinct(), "asked")
        ratio = stored(self.ratios(asked), "ratios")
        out = stored(blocks.groupBy("block").cogroup(keyed.join(ratio, "key").groupBy("block")).applyInArrow(total, "url string, score double"), "scored")
        free(blocks, keyed, asked, ratio)
        return out

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Of some URLs, for the driver."""
        if self.size > FEW:
            texts = [u.decode("utf-8", "replace") for u in urls]
            rows = self.counts.sparkSession.createDataFrame([(u,) for u in set(texts)], "url string")
            known = {r.url: r.score for r in self.scored(rows).collect()}
            return np.array([known[u] for u in texts])
        if self.whole is None:
            counts = self.counts.toArrow()
            self.whole = Model(*(Markov.of(*_own(counts, v)) for v in (ALLOW, BLOCK)))
        return self.whole.scores(urls)


def _own(counts: pa.Table, verdict: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a verdict and how often each is there."""
    mine = counts.filter(pc.equal(counts["verdict"], verdict))
    return _numbers(mine), mine["n"].to_numpy().astype(float)


def learn(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> Counted:
    """Models of allowed and blocked URLs and the cut, from all different URLs that rules decide.

    A fifth of them, by a hash of the URL, tells the cut, the others are counted. Null URLs
    teach nothing; a verdict without URLs gives a model that holds all bytes alike.
    """
    decided = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), rule_of(*host_and_path(F.col(url)), rules)["verdict"].alias("verdict")).where("verdict is not null")
    unseen = F.pmod(F.xxhash64(F.lit(2), "url"), F.lit(5)) == 0
    decided = stored(decided.distinct().withColumn("unseen", unseen), "decided")
    model = Counted.of(decided.where("not unseen"))
    held = decided.where("unseen")
    scored = model.scored(held)
    model.cut = cut_of(scored.join(held, "url").select((F.col("verdict") == ALLOW).alias("allowed"), "score"))
    free(decided, scored)
    return model


def judge(pages: DataFrame, rules: Sequence[Rule], model: Counted, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), verdict and score (null where a rule decides).

    Rules are a few hundred at most: they are one expression. A null URL counts as empty,
    and an empty one, of which a model knows nothing, is allowed. URLs of any length are
    read whole; rows that repeat get the same answer each; an empty table gives no rows.
    New columns that clash with one of ``pages`` get underscores at the end.
    """
    host, path, rule, verdict, score = (column_free(pages, c) for c in ("host", "path", "rule", "verdict", "score"))
    taken = column_free(pages, "rule__")
    h, p = host_and_path(F.col(url))
    out = pages.withColumns({host: h, path: p}).withColumn(taken, rule_of(F.col(host), F.col(path), rules))
    unruled = F.col(taken).isNull() & (F.length(F.coalesce(F.col(url), F.lit(""))) > 0)
    known = model.scored(out.where(unruled).select(F.col(url).alias("url")).distinct())
    known = known.select(F.col("url").alias(column_free(out, "scored_url__")), F.col("score").alias(score))
    judged = out.where(unruled).join(known, F.col(url) == F.col(known.columns[0]), "left").drop(known.columns[0])
    out = judged.unionByName(out.where(~unruled).withColumn(score, F.lit(None).cast("double")))
    own = F.when(F.col(score) < F.lit(model.cut), BLOCK).otherwise(ALLOW)
    out = out.withColumns({rule: F.col(taken)["name"], verdict: F.coalesce(F.col(taken)["verdict"], own)})
    return out.select(*pages.columns, host, path, rule, verdict, score)
