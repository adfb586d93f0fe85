"""Language identification: known words first, then ever shorter character n-grams.

Training counts words and the n-grams of words (with a mark at both ends, but for single
characters) for each language over a sample of labelled rows; nothing that the sample
holds is left out. A known word gives each language the log of its smoothed frequency
there. A word that no language knows is looked up by its n-grams of the longest order,
and if none of those is known either, by the next shorter one; it gives the mean over the
n-grams that are known. A text's language has the highest sum over its words, repeats
included; of equal sums the first by name. A text with letters of which nothing is known
gets the language of the most learnt rows, with the score of a guess.

The model is sparse: 64-bit hashes in ascending order, and for each the languages that
have it with their logs; what a language has not seen has one log a language and order. So
a worker holds a few tens of bytes for each pair of an n-gram and a language that the
sample has, however many languages there are, and the sample is bounded in rows and bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_free, stored
from .tokens import batches, release

SAMPLE_ROWS, LEAST_ROWS = 10_000, 500  # about so many labelled rows are learnt from; of each language so many, if it has them
SAMPLE_BYTES = 64 << 20  # of text, about, in the sample at most: all languages' rows thin out alike beyond
ORDERS = (4, 3, 2, 1)
REMEMBERED = 20_000_000  # numbers, a word's language each, that a worker remembers at most, of 100,000 words at most
HELD = 100_000  # counts that a training task holds before it passes them on
BATCH_BYTES = 1 << 20  # of text that is looked up together
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def _grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Table:
    """One order's n-grams: the entries of ``hashes[i]`` are ``begin[i]`` to ``begin[i + 1]`` of ``langs`` and ``logs``; ``unseen`` is each language's log of what it has not seen."""

    hashes: np.ndarray
    begin: np.ndarray
    langs: np.ndarray
    logs: np.ndarray
    unseen: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> Table:
        """From the entries (n-gram, language, count), in any order."""
        order = np.lexsort((langs, grams))
        grams, langs, counts = grams[order], langs[order], counts[order]
        hashes, begin = np.unique(grams, return_index=True)
        total = np.maximum(np.bincount(langs, counts, n_langs) + 0.5 * len(hashes), 1)
        logs, unseen = np.log((counts + 0.5) / total[langs]), np.log(0.5 / total)
        return cls(hashes, np.append(begin, len(grams)), langs.astype(np.int32), logs.astype(np.float32), unseen.astype(np.float32))

    def sums(self, texts: list[str], owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(how many of each owner's ``texts`` are known, the sums of their logs by language)."""
        width = len(self.unseen)
        h = np.fromiter(map(_hash, texts), np.uint64, len(texts))
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        at, owner = at[known], owner[known]
        times = np.bincount(owner, minlength=n)
        size = self.begin[at + 1] - self.begin[at]
        entry = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        lang = self.langs[entry]
        more = np.bincount(np.repeat(owner, size) * width + lang, self.logs[entry] - self.unseen[lang], n * width)
        return times, times[:, None] * self.unseen + more.reshape(n, width)


@dataclass
class Model:
    """``tables[order]`` has the n-grams of an order (words are order 0); ``common`` is the language of the most rows."""

    langs: list[str]
    tables: dict[int, Table]
    common: int = 0
    seen: dict[str, int] = field(default_factory=dict)
    held: np.ndarray | None = None

    def evidence(self, words: list[str]) -> np.ndarray:
        """(words, languages + 1): the logs of each language and 1, or zeros for a word of which nothing is known."""
        out, open_ = np.zeros((len(words), len(self.langs) + 1), np.float32), np.arange(len(words))
        for n in (0, *ORDERS):
            parts = [_grams(words[i], n) if n else [words[i]] for i in open_.tolist()]
            owner = np.repeat(np.arange(len(open_)), [len(p) for p in parts])
            times, sums = self.tables[n].sums([g for p in parts for g in p], owner, len(open_))
            got = np.flatnonzero(times)
            out[open_[got], :-1] = sums[got] / times[got, None]
            out[open_[got], -1] = 1
            open_ = open_[times == 0]
            if not len(open_):
                break
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its share (0 to 1) of the languages' likelihoods a word; ``und`` without letters. The words of all texts are looked up together."""
        counts = [Counter(_WORD.findall((t or "").lower())) for t in texts]
        words = list(dict.fromkeys(w for c in counts for w in c))
        if self.held is None:
            self.held = np.zeros((min(100_000, REMEMBERED // (len(self.langs) + 1)), len(self.langs) + 1), np.float32)
        rows = np.zeros((len(words), len(self.langs) + 1), np.float32)
        at = np.array([self.seen.get(w, -1) for w in words], np.int64)
        rows[at >= 0] = self.held[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        rows[new] = self.evidence([words[i] for i in new.tolist()])
        keep = new[: len(self.held) - len(self.seen)]
        first = len(self.seen)
        self.held[first : first + len(keep)] = rows[keep]
        self.seen.update({words[i]: first + k for k, i in enumerate(keep.tolist())})
        code, out = {w: i for i, w in enumerate(words)}, []
        for c in counts:
            if not c or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            sums = np.fromiter(c.values(), float, len(c)) @ rows[[code[w] for w in c]].astype(float)
            total, n = sums[:-1], sums[-1]
            if not n:
                out.append((self.langs[self.common], 1.0 / len(self.langs)))
                continue
            share, best = np.exp((total - total.max()) / n), int(total.argmax())
            out.append((self.langs[best], float(share[best] / share.sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def sample(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """About ``sample_rows`` of ``rows`` (lang, text, id), and about ``least_rows`` of each language that has so many, by a hash of the id; if those have more than ``sample_bytes``, that part of them."""
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1 << 30))
    some = stored(_some(rows, sample_rows, least_rows, place(1)), "sample")
    size = some.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return some if size <= sample_bytes else some.where(place(2) < int((1 << 30) * sample_bytes / size))


def _some(rows: DataFrame, sample_rows: int, least_rows: int, place: Column) -> DataFrame:
    each = rows.groupBy("lang").count()
    total, langs = each.agg(F.sum("count"), F.count(F.lit(1))).first()
    if (total or 0) <= sample_rows:
        return rows
    rate = F.greatest(F.lit(sample_rows / total), F.lit(float(least_rows)) / F.col("count"))
    part = each.select("lang", (rate * (1 << 30)).cast("long").alias("part"))
    met = rows.join(F.broadcast(part) if langs <= 100_000 else part, "lang")
    return met.where(place < F.col("part")).drop("part")


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of a bounded :func:`sample` of the rows where ``usable``, lang and text are not null.

    Texts are read whole and all that they hold is learnt, so the model's size has the
    sample's bound whatever the corpus. Rows that repeat count each. An empty sample
    gives a model without languages.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
    rows = sample(rows, sample_rows, least_rows, sample_bytes)

    def count(parts):
        grams: Counter[tuple[str, int, int]] = Counter()

        def out():
            lang, n, gram = zip(*grams, strict=True) if grams else ([], [], [])
            table = pa.record_batch([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(np.array(gram, np.uint64).view(np.int64)), pa.array(list(grams.values()), pa.int64())], names=["lang", "n", "gram", "c"])
            grams.clear()
            return table

        for batch in batches(parts, most=BATCH_BYTES):
            by_lang: dict[str, Counter[str]] = {}
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = by_lang.setdefault(language, Counter())
                words.update(_WORD.findall(t.lower()))
                grams[language, -1, 0] += 1  # rows
            for language, words in by_lang.items():
                each: Counter[tuple[int, str]] = Counter()
                for word, c in words.items():
                    grams[language, 0, _hash(word)] += c
                    for k in ORDERS:
                        for g in _grams(word, k):
                            each[k, g] += c
                for (k, g), c in each.items():
                    grams[language, k, _hash(g)] += c
            if len(grams) > HELD:
                yield out()
        yield out()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, n int, gram long, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    got = counted.toArrow()
    names = got["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    number = {x: i for i, x in enumerate(langs)}
    column = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if langs else np.zeros(0, np.int64)
    order, gram, c = got["n"].to_numpy(), got["gram"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy()
    learnt = np.bincount(column[order == -1], c[order == -1], len(langs))
    tables = {}
    for k in (0, *ORDERS):
        mine = order == k
        tables[k] = Table.of(gram[mine], column[mine], c[mine].astype(float), len(langs))
    return Model(langs, tables, int(learnt.argmax()) if langs else 0)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score. A null text, or one without a letter, is ``und`` with score 0.

    Rows that repeat get the same answer each; a text of any length is read whole. New
    columns that clash with one of ``docs`` get an underscore at the end.
    """
    lang_name, score_name = column_free(docs, lang_name), column_free(docs, score_name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(parts):
        release()
        known = held.value
        for batch in batches(parts, text, BATCH_BYTES):
            got = known.predict_all(batch.column(at).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*batch.schema.names, lang_name, score_name])

    schema = docs.select("*", F.lit("").alias(lang_name), F.lit(0.0).alias(score_name)).schema
    return docs.mapInArrow(run, schema)
