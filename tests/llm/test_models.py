"""Fingerprints, tokens, packing, neighbours and the two models against brute force or held-out rows."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import ann, language_id, packing, quality, simhash, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a\n b", " a", "a  b", "\ta b", "x\x1cy", "it's 'll", "1 2  3", "é́ a", "<|endoftext|> b", "a　 b", "hello\n\n\nworld   x\n ", "Word, word. WORD!! a|b #x", "\x01x"]


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    draw = np.random.default_rng(0)
    texts = ODD + ["".join(draw.choice(list("ab1.' \n\t　\x1cé,"), draw.integers(0, 14))) for _ in range(300)]
    for text, got in zip(texts, tokens.Encoder(PATH).encode(texts), strict=True):
        assert got.tolist() == ids_of(text), repr(text)


def doc_table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, start string")


def test_token_files_round_trip(spark, tmp_path):
    texts = [None, *ODD, "long " * 3000]
    docs = doc_table(spark, texts, [5 * i % 61 for i in range(len(texts))])
    files = tokens.write_files(docs, f"file://{tmp_path}/t", PATH, sequence=16)
    got = {r.doc_id: r for r in tokens.read_documents(files, tokens.crc_of, "doc_id long, start long, n_tokens long, value long").collect()}
    at = 0
    for i, text in sorted(zip([5 * i % 61 for i in range(len(texts))], texts, strict=True)):
        ids = np.array([*ids_of(text), 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].value) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    reader = tokens.Reader(files.first().path)
    ids, mask = reader.sequence(0)
    assert len(ids) == 16 and mask.dtype == bool
    assert tokens.write_files(doc_table(spark, []), f"file://{tmp_path}/none", PATH).count() == 0


def one_by_one(lengths, capacity):
    """Best fit, piece by piece."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def histograms():
    draw = np.random.default_rng(1)
    of = lambda x: dict(Counter(np.clip(x.astype(int), 1, 2048).tolist()))
    normal = lambda *parts: np.concatenate([draw.normal(m, s, 3000) for m, s in parts])
    return {
        "uniform": {k: 3 for k in range(1, 2049)}, "one each": {k: 1 for k in range(1, 2049)}, "over half": {1100: 400_000}, "full": {2048: 9, 1: 4},
        "lognormal": of(draw.lognormal(5.5, 1.0, 4000)), "two": of(normal((700, 60), (450, 50))), "three": of(normal((1100, 60), (600, 50), (400, 30))),
        "third": {1044: 6000, 546: 6000, 532: 6000, 471: 12000}, "few": {1044: 6, 546: 6, 532: 6, 471: 12}, "none": {},
    }


@pytest.mark.parametrize("name", list(histograms()))
def test_plan_is_whole_and_near_the_bound(name):
    histogram = histograms()[name]
    runs, got = packing.plan(histogram), Counter()
    for lens, n in runs:
        assert sum(lens) <= 2048
        for x in lens:
            got[x] += n
    assert got == Counter(histogram)
    counts = np.zeros(2049)
    counts[list(histogram)] = list(histogram.values())
    plain, mine = sum(packing.best_fit(histogram, 2048).values()), sum(n for _, n in runs)
    assert mine <= plain
    if name in ("two", "third", "few"):
        assert mine < plain and mine <= 1.01 * packing.fractional(counts)[1] + 1
    if sum(histogram.values()) <= 5000:
        assert plain == one_by_one([k for k, n in histogram.items() for _ in range(n)], 2048)


def test_program_is_solved_between_its_bounds():
    """Primal and dual come within two hundredths, and what the configurations hold covers the counts."""
    capacity, counts = 12, np.zeros(13)
    for k, n in ((7, 50), (5, 30), (4, 40), (3, 70)):
        counts[k] = n
    uses, bound = packing.fractional(counts)
    covered = Counter()
    for config, x in uses.items():
        assert sum(config) <= capacity
        for k in config:
            covered[k] += x
    assert bound <= sum(uses.values()) + 1e-6 <= 1.02 * bound and all(covered[k] >= 0.97 * counts[k] for k in (3, 4, 5, 7))


def test_packing_is_gapless_and_complete(spark):
    texts = [None, "", *ODD, "word " * 5000, *["abc def"] * 40]
    ids = list(range(len(texts) - 1)) + [None]
    got = packing.pack_documents(doc_table(spark, texts, ids), PATH, capacity=64).toPandas()
    assert sorted(got.groupby("doc_id", dropna=False).length.sum().tolist()) == sorted(len(ids_of(t)) + 1 for t in texts)
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    assert (got[got.piece > 0].length == 64).all()
    assert packing.pack_documents(doc_table(spark, []), PATH).count() == 0


def test_golay_keys_meet_within_two_bits():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 1 << 23, 300)
    assert set((simhash.golay_keys(words) >= 0).sum(axis=1).tolist()) <= {1, 6}
    for a, b in combinations(range(23), 2):
        own, other = simhash.golay_keys(words[:20]), simhash.golay_keys(words[:20] ^ (1 << a) ^ (1 << b))
        for x, y in zip(own, other, strict=True):
            assert set(x[x >= 0].tolist()) & set(y[y >= 0].tolist())


@pytest.mark.parametrize("wide", [2048, 3])
def test_links_are_all_found(spark, wide):
    draw = np.random.default_rng(3)
    fps = set()
    for base in draw.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(12):
            for _ in range(int(draw.integers(0, 4))):
                base ^= 1 << int(draw.integers(0, 64))
            fps.add(base)
    fps = [int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64)]
    want = {tuple(sorted(p)) for p in combinations(fps, 2) if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") <= 2}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), wide).collect()}
    assert got == want


def test_near_dedup_edge_cases(spark):
    texts = ["a b c d e f g", "A B  C d e f g", None, "", " \n", "a b", "one two three four five six"]
    got = {r.doc_id: r for r in simhash.near_dedup(doc_table(spark, texts, [3, 1, 5, 2, 9, 4, None])).collect()}
    assert got[3].component_id == got[1].component_id == 1 and got[5].component_id == got[2].component_id == got[9].component_id == 2
    assert got[5].fp == 0 and got[4].component_id == 4 and got[None].component_id is None
    assert simhash.near_dedup(doc_table(spark, [])).count() == 0


def test_similar_texts_leave_and_others_stay(spark):
    draw = np.random.default_rng(4)
    vocabulary = ["".join(draw.choice(list("abcdefghij"), 6)) for _ in range(800)]
    texts, near = [], set()
    for k in range(30):
        words = draw.choice(vocabulary, 200).tolist()
        texts.append(" ".join(words))
        for _ in range(3):
            edited = list(words)
            for at in draw.choice(200, 3, replace=False):
                edited[at] = "new" + str(at)
            if simhash.shingle_similarity(" ".join(words).encode(), " ".join(edited).encode()) >= 0.8:
                near.add(len(texts))
            texts.append(" ".join(edited))
        words[:60] = draw.choice(vocabulary, 60).tolist()
        texts.append(" ".join(words))
    kept = {r.doc_id for r in simhash.keep_dissimilar(doc_table(spark, texts)).collect()}
    others = set(range(len(texts))) - near
    assert kept == others
    odd = doc_table(spark, texts).withColumns({"row_number__": F.lit(1), "gone_id": F.col("doc_id")})
    repeated = odd.unionAll(odd.where("doc_id = 0"))  # an id that repeats gives rows numbers of their own
    for table in (odd, repeated):
        got = simhash.keep_dissimilar(table)
        assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == others
    assert simhash.keep_dissimilar(doc_table(spark, [])).count() == 0


def test_packing_with_clashing_columns(spark):
    clash = ["bucket_", "rank_", "b_", "b_length", "sequence_id", "offset"]
    rows = spark.createDataFrame([(i, 1 + i % 7, *["x"] * len(clash)) for i in range(50)], "id long, length long, " + ", ".join(f"{c} string" for c in clash))
    got = packing.pack(rows, ["id"], capacity=10)
    assert got.columns == [*rows.columns, "sequence_id_", "offset_"]
    held = Counter()
    for r in got.collect():
        assert {r[c] for c in clash} == {"x"} and r.offset_ + r.length <= 10
        held.update((r.sequence_id_, r.offset_ + k) for k in range(r.length))
    assert max(held.values()) == 1 and sum(held.values()) == sum(1 + i % 7 for i in range(50))


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(5)
    v = draw.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900 + i, v[0].tolist()) for i in range(9)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, 2.0]), (None, v[1].tolist()), (1004, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, table.where("vec_id % 50 = 0"), shard_rows=200).toPandas()
    real = [(i, np.array(x, float)) for i, x in rows if i is not None and x is not None and len(x) == 16 and np.isfinite(x).all() and any(x)]
    ids, m = np.array([i for i, _ in real]), np.stack([x for _, x in real])
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[ids == q][0] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[ids == q][0])
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(mine.vec_id)
        hit += len(set(best) & set(mine.vec_id))
        total += 5
    assert hit / total >= 0.95
    assert got[got.query_id == 0].vec_id.tolist() == [900, 901, 902, 903, 904]
    assert ann.search(table.where("vec_id = 3"), table.where("vec_id = 3")).count() == 0
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_recall_over_many_shards_and_extreme_vectors(spark):
    """Twelve shards, vectors whose squares overflow or vanish, and a query id with two vectors."""
    draw = np.random.default_rng(15)
    v = draw.normal(size=(2400, 12))
    v[::7] *= 1e200
    v[3::7] *= 1e-200
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[1].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 100 = 0"), shard_rows=200).toPandas()
    assert np.isfinite(got.score).all() and (got.groupby("query_id").size() == 5).drop(0).all() and (got.query_id == 0).sum() == 10
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = 0
    for q in range(100, 2400, 100):
        s = unit @ unit[q]
        s[q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        hit += len(set(np.argsort(-s, kind="stable")[:5]) & set(mine.vec_id))
        assert np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
    assert hit / (23 * 5) >= 0.95


def test_language_model(spark):
    from pyspark.sql import functions as F

    a, b = "the cat sat on a mat with that hat", "der hund lief über die straße und bellte"
    draw = np.random.default_rng(6)
    rows = [(i, " ".join(draw.choice((a if i % 2 else b).split(), 20)), "en" if i % 2 else "de", 0.5) for i in range(80)]
    rows += [(100, None, "en", 0.5), (101, "1234 !!", "de", 0.5), (102, "", None, 0.5), (103, "straßen hunde", None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language_id.learn(docs, F.col("doc_id") < 60)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(80)) and got[103].lang_pred == "de"
    assert all(got[i].lang_pred == "und" and got[i].score_ == 0.0 for i in (100, 101, 102))
    none = language_id.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_quality_rules(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(7)
    words = ["".join(draw.choice(list("abcdef"), 5)) for _ in range(300)]
    good = lambda: " ".join(draw.choice(words, 80))
    bad = lambda: "!! ".join(x.upper() for x in draw.choice(words, 80))
    rows = [(i, good() if i % 3 else bad(), "x") for i in range(240)] + [(500, None, "x"), (501, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.col("doc_id") < 160)
    assert 0 < len(model.rules) < 60
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(160, 240)) and 0 <= got[500] == got[501] <= 1
    assert quality.fit(np.zeros((0, 21)), np.zeros(0)).rules == ()
