"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts come from byte counts and words. Boosted shallow trees are
grown on a bounded sample of labelled rows; every path from a root to a node is a rule, a
conjunction of thresholds. Logistic regression with an L1 penalty weighs the rules and
drops most. The rest is compiled into one Spark column expression over the statistics,
so scoring runs in generated code.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_free
from .tokens import batches

SAMPLE_ROWS = 20_000  # about so many labelled rows are learnt from, at most
STATISTICS = (
    "size", "words", "word_length", "longest_word", "distinct_words", "common_word", "upper", "digit", "blank", "beyond_ascii",
    "stop", "comma", "exclaim", "bar", "symbol", "bracket", "lines", "distinct_lines", "line_words", "shouted", "marked",
)
_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other
for _i, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b".", b",;:", b"!?", b"|", b"#$%&*@^~+=<>_\\", b"()[]{}", b"abcdefghijklmnopqrstuvwxyz"), 1):
    _CLASS[list(_bytes)] = _i
_PER = np.eye(12)[_CLASS]


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for a text; all 0 without bytes."""
    if not text:
        return (0.0,) * len(STATISTICS)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _PER / len(text)
    words = text.split()
    times = Counter(words)
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shouted = sum(map(bytes.isupper, words)) / n
    marked = sum(1 for w in words if w[-1:] in b"#$%&*|!@") / n
    common = max(times.values(), default=0) / n
    return (
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0)), len(times) / n, common,
        *share[1:5].tolist(), *share[5:11].tolist(), math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), shouted, marked,
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with the statistics (a null text counts as empty)."""
    rows = docs.withColumn(text, F.col(text).cast("binary"))
    at = rows.columns.index(text)
    names = [column_free(docs, s) for s in STATISTICS]
    left = [c for c in rows.columns if c != text]

    def run(parts):
        for batch in batches(parts, text):
            got = np.array([statistics_of(t or b"") for t in batch.column(at).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.record_batch([*(c for i, c in enumerate(batch.columns) if i != at), *(pa.array(got[:, k]) for k in range(len(STATISTICS)))], names=[*left, *names])

    return rows.mapInArrow(run, rows.drop(text).select("*", *(F.lit(0.0).alias(s) for s in names)).schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), sorted


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, names=STATISTICS) -> Column:
        """The score as a column expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for k, above, at in rule:
                held = held & (F.col(names[k]) > at if above else F.col(names[k]) <= at)
            z = z + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, at in rule:
        out &= x[:, k] > at if above else x[:, k] <= at
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.3, seed: int = 42) -> list[Rule]:
    """The paths of boosted trees; each tree sees half of the rows."""
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)  # bin <= b: x <= cuts[b]
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    z = np.full(len(y), math.log(p0 / (1 - p0)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        used = draw.random(len(y)) < 0.5
        nodes: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for level in range(depth + 1):
            below = []
            for rule, rows in nodes:
                own = rows[used[rows]]
                best = None
                if level < depth and len(own) >= 20:
                    total_g, total_h = g[own].sum(), h[own].sum()
                    for k, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gs = np.bincount(binned[own, k], g[own], len(c) + 1).cumsum()[:-1]
                        hs = np.bincount(binned[own, k], h[own], len(c) + 1).cumsum()[:-1]
                        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                        gain[(hs < 0.2) | (total_h - hs < 0.2)] = -1
                        b = int(gain.argmax())
                        if gain[b] > 1e-3 and (best is None or gain[b] > best[0]):
                            best = (gain[b], k, b)
                if best is None:
                    z[rows] += rate * g[own].sum() / (h[own].sum() + 1)
                    continue
                _, k, b = best
                at = float(cuts[k][b])
                for above in (False, True):
                    side = rows[(binned[rows, k] > b) == above]
                    path = tuple(sorted({*rule, (k, above, at)}))
                    rules.setdefault(path)
                    below.append((path, side))
            nodes = below
    return list(rules)


def lasso(holds: np.ndarray, y: np.ndarray, penalty: float = 0.002, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of logistic regression with an L1 penalty, by accelerated proximal steps."""
    n, m = holds.shape
    a = holds.astype(np.float32)
    centre = a.mean(axis=0)
    a = a - centre
    step = 4.0 / max(1e-9, np.linalg.norm(a, 2) ** 2 / n + 1)
    w, b = np.zeros(m, np.float32), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ v + vb))) - y
        w1 = v - step * (a.T @ r / n)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1 = vb - step * r.mean()
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return float(b - centre @ w), w


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model of statistics ``x`` and labels ``y`` (0 or 1); a constant one where a label is missing."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(math.log(p / (1 - p)), ())
    rules = grow_rules(x, y.astype(float))
    if not rules:
        return RuleModel(math.log((y.mean()) / (1 - y.mean())), ())
    intercept, weights = lasso(np.stack([_holds(r, x) for r in rules], axis=1), y.astype(np.float32))
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, weights.tolist(), strict=True) if abs(w) > 1e-4))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model of about ``sample_rows`` labelled rows where ``usable`` (of doc_id), chosen by a hash of doc_id.

    Only the sample's statistics reach the driver. Null labels and ids are left out;
    labels repeated for one id count once, as their largest.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y__"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(2), doc_id), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    sample = docs.select(doc_id, text).join(F.broadcast(known), doc_id).select(text, "y__", F.col(doc_id).alias("id__"))
    got = with_statistics(sample, text).orderBy("id__", *STATISTICS).toPandas()
    return fit(got[list(STATISTICS)].to_numpy(float), (got["y__"].to_numpy() > 0).astype(int))


def score(docs: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without ``text`` and with the score, 0 to 1; empty and null texts too.

    A text of any length is read whole, rows that repeat get the same score each, and an
    empty table gives no rows. A clashing name gets underscores at its end.
    """
    name = column_free(docs, name)
    rows = with_statistics(docs, text)
    names = rows.columns[-len(STATISTICS) :]
    return rows.select(*(c for c in rows.columns if c not in names), model.column(names).alias(name))
