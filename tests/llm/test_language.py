"""Language identification against a plain scorer over the same rows, and held-out accuracy."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import language_id

WORDS = {
    "en": "the cat sat on a mat with that hat while rain fell over old roofs".split(),
    "de": "der hund lief über die straße und bellte während regen auf alte dächer fiel".split(),
    "fr": "le chien court dans la rue et aboie pendant que la pluie tombe où il était".split(),
}


def corpus():
    draw = np.random.default_rng(8)
    rows = []
    for i in range(150):
        lang = list(WORDS)[i % 3]
        words = [w if draw.random() < 0.8 else w + draw.choice(["en", "s", "er", "é"]) for w in draw.choice(WORDS[lang], 25)]
        rows.append((i, " ".join(words) + ".", lang))
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !!", None), (203, "Ωμέγα", None), (204, "日本語", None), (205, rows[0][1], "en"), (205, rows[0][1], "en"), (None, "der hund", None), (206, "straßen " * 50_000, None)]
    return rows


def grams(word, n):
    if n == 0:
        return [word]
    marked = f"_{word}_" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Plain:
    """The same scores from dictionaries of strings."""

    def __init__(self, rows):
        self.langs = sorted({lang for _, t, lang in rows if t is not None and lang is not None})
        self.counts = {lang: {n: Counter() for n in range(5)} for lang in self.langs}
        self.rows = Counter()
        for _, t, lang in rows:
            if t is None or lang is None:
                continue
            self.rows[lang] += 1
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                for n in range(5):
                    self.counts[lang][n].update(grams(w, n))
        self.all = {n: set().union(*(self.counts[x][n] for x in self.langs)) for n in range(5)}
        self.sizes = {(x, n): sum(self.counts[x][n].values()) + 0.5 * len(self.all[n]) for x in self.langs for n in range(5)}

    def logs(self, word):
        for n in (0, 4, 3, 2, 1):
            known = [g for g in grams(word, n) if g in self.all[n]]
            if known:
                return [sum(math.log((self.counts[x][n][g] + 0.5) / self.sizes[x, n]) for g in known) / len(known) for x in self.langs]
        return None

    def predict(self, text):
        words = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        if not words:
            return "und", 0.0
        total, n = [0.0] * len(self.langs), 0
        for w, c in words.items():
            got = self.logs(w)
            if got:
                total = [a + c * b for a, b in zip(total, got, strict=True)]
                n += c
        if not n:
            return max(self.langs, key=self.rows.__getitem__), 1 / len(self.langs)
        e = [math.exp((a - max(total)) / n) for a in total]
        return self.langs[total.index(max(total))], max(e) / sum(e)


@pytest.mark.parametrize("remembered", [20_000_000, 20])
def test_scores_equal_a_plain_scorer(spark, monkeypatch, remembered):
    monkeypatch.setattr(language_id, "REMEMBERED", remembered)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, plain = language_id.learn(docs, F.col("doc_id") < 60), Plain([r for r in rows if r[0] is not None and r[0] < 60])
    assert model.langs == plain.langs
    if remembered < 100:
        got = [(t, *model.predict(t)) for _, t, _ in rows]
    else:
        got = [(r.text, r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()]
    assert len(got) == len(rows)
    for text, lang, score in got:
        want = plain.predict(text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4, (text, lang, score, want)
    held = [(lang, lang_pred) for (i, _, lang), (_, lang_pred, _) in zip(rows, [(t, *model.predict(t)) for _, t, _ in rows], strict=True) if i is not None and 60 <= i < 150]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_rare_languages_are_in_the_sample(spark):
    rows = [(i, "a b", "en") for i in range(6000)] + [(7000 + i, "c d", "xx") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r.lang: r["count"] for r in language_id.sample(docs, 600, 30).groupBy("lang").count().collect()}
    assert 20 <= got["xx"] <= 40 and 400 <= got["en"] <= 800


def test_unknown_letters_get_the_commonest_language(spark):
    docs = spark.createDataFrame([(1, "aa bb", "en"), (2, "aa", "en"), (3, "cc", "de")], "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.lit(True))
    assert model.predict("ζζζ") == ("en", 0.5) and model.predict("--- 12") == ("und", 0.0)


def test_many_languages_stay_sparse(spark):
    """Entries are those of the sample, whatever the number of languages; the sample is bounded in bytes too."""
    word = lambda k: "abcdefghijkl"[k // 10] + "mnopqrstuv"[k % 10]
    rows = [(i, f"{word(i % 120)} x{word(i % 120)}", f"l{i % 120:03d}") for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.lit(True))
    assert len(model.langs) == 120 and len(model.tables[0].logs) == 240 and model.tables[0].unseen.shape == (120,)
    assert [model.predict(t)[0] for _, t, _ in rows[:120]] == [x for _, _, x in rows[:120]]
    every = sum(len(t) for _, t, _ in rows)
    some = language_id.sample(docs.withColumnRenamed("doc_id", "id"), sample_bytes=every // 4)
    got = sum(len(r.text) for r in some.collect())
    assert every // 10 < got < every // 2
