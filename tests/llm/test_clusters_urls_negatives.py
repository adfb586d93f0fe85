"""Operators 11 to 13 against plain versions over small tables with nulls, repeats, ties and clashes."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cloudloom.llm import clustering, hard_negatives, queries, shards, url_filter

BAD = [(None, 1), ([], 2), ([1.0], 3), ([float("nan")] * 8, 4), ([float("inf")] * 8, 5), ([0.1] * 7 + [None], 6)]


def vectors(draw, n, width=8):
    v = draw.normal(size=(n, width))
    v[n // 2 : n // 2 + 40] = v[0]  # a group of copies
    v[5], v[6], v[7] = 0, 1e30, -1e30
    v[50] *= 1e6
    rows = [(i, x.tolist(), int(draw.integers(0, 4))) for i, x in enumerate(v)]
    return rows + [rows[3], rows[3], (3, rows[9][1], 1), (None, rows[4][1], 2), (n + 1, rows[4][1], None)] + [(1000 + i, x, 1) for x, i in BAD]


def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(min(max(scale * float(np.float32(x)), -(2.0**27)), 2.0**27)) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    for turn in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        owner = [x.index(min(x)) for x in d]
        if turn < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, owner, strict=True) if o == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    least = [min(x) for x in d]
    of = Counter()
    for o, x in zip(owner, least, strict=True):
        of[o] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if i is None else i), o, x, of[o], sum(least), sha[o]) for (i, _), o, x in zip(kept, owner, least, strict=True))


def test_clusters_equal_plain_rounds(spark):
    rows = vectors(np.random.default_rng(21), 300)
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, cluster int")
    for k, rounds in ((6, 3), (6, 9), (1000, 1)):
        got = clustering.cluster(table.repartition(5), k=k, rounds=rounds, width=8)
        mine = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got.collect()))
        assert mine == plain_clusters(rows, k, rounds, 8, 64)
    assert clustering.cluster(table.limit(0)).count() == 0 and clustering.cluster(table.where("embedding is null")).count() == 0


def test_rounds_compare_what_moved(monkeypatch):
    """Vectors whose owner stays meet the moved centroids alone, and ties go to the smaller number."""
    seen = []
    whole = clustering.distances
    monkeypatch.setattr(clustering, "distances", lambda v, c: seen.append((len(v), len(c))) or whole(v, c))
    v, centroids = np.array([[0, 0], [10, 0], [5, 0]]), np.array([[0, 0], [9, 0], [10, 0]])
    owner, d = clustering.assign(v, np.array([0, 2, 1]), np.array([0, 0, 16]), centroids, np.array([False, True, False]))
    assert seen == [(1, 3), (2, 1)] and owner.tolist() == [0, 2, 0 + 1] and d.tolist() == [0, 0, 16]
    owner, d = clustering.assign(v[:1], np.array([1]), np.array([4]), np.array([[2, 0], [-2, 0]]), np.array([True, False]))
    assert owner.tolist() == [0] and d.tolist() == [4]
    big = np.array([[1 << 27, -(1 << 27)]])
    assert whole(big, -big).tolist() == [[2 * (1 << 28) ** 2]]


def plain_negatives(rows, positives=5, negatives=3):
    kept = {(i, l, tuple(math.floor(min(max(256 * float(np.float32(x)), -b), b)) for x in v)) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(np.float32(x)) for x in v) for b in [math.floor(math.sqrt(2**56 / len(v)))]}
    out = []
    for a, label, v in kept:
        if a % 50:
            continue
        score = lambda w, v=v: sum(x * y for x, y in zip(v, w, strict=True))
        near = sorted((-score(w), i) for i, l, w in kept if len(w) == len(v) and l == label and i != a)[:positives]
        others = sorted((-score(w), i) for i, l, w in kept if len(w) == len(v) and l != label)
        for s, p in near:
            good = [(n, i) for n, i in others if -50 * s <= -100 * n <= -95 * s][:negatives]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(good, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors(np.random.default_rng(22), 900)
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rank int")
    expected = plain_negatives(rows)
    for shard_rows in (None, 250):
        got = hard_negatives.mine(table, F.col("vec_id") % 50 == 0, shard_rows=shard_rows)
        assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100
    assert hard_negatives.mine(table.limit(0), F.lit(True)).count() == 0 and hard_negatives.mine(table, F.lit(False)).count() == 0


def test_tree_leaves_out_what_cannot_hold(spark):
    """On clustered vectors a search scores a part of them, and copies beyond a leaf are no trouble."""
    draw = np.random.default_rng(23)
    middles = draw.integers(-3000, 3000, (40, 6))
    v = middles[draw.integers(0, 40, 20_000)] + draw.integers(-20, 20, (20_000, 6))
    v[:3000] = v[0]
    ids, labels = np.arange(20_000), draw.integers(0, 3, 20_000)
    tree = hard_negatives.Tree(ids, labels, v, int((v**2).sum(axis=1).max()), leaf=128)
    scored = []
    whole = tree._score
    tree._score = lambda node, who, *rest: scored.append(len(who) * (tree.span[node][1] - tree.span[node][0])) or whole(node, who, *rest)
    asked = np.array([9000, 100, 100])
    s = v @ v[asked].T
    low, high = s.max(axis=0)[:, None] // 2, s.max(axis=0)[:, None] * 95 // 100
    low[2], high[2] = 5, 4
    got, found = tree.search(v[asked], asked, labels[asked], False, low, high, 3)
    for i, a in enumerate(asked[:2]):
        good = np.flatnonzero((labels != labels[a]) & (s[:, i] >= low[i]) & (s[:, i] <= high[i]))
        best = good[np.lexsort((good, -s[good, i]))[:3]]
        assert got[i, 0].tolist() == s[best, i].tolist() and found[i, 0].tolist() == best.tolist()
    assert (got[2] == -hard_negatives.FAR).all() and sum(scored) < 2 * 10_000


def test_shards_follow_memory(spark):
    assert shards.shards_of(spark, 10, 100) == 1 and shards.shards_of(spark, 10**7, 1000) == -(-(10**7) // (shards.task_bytes(spark) // 1000))
    assert shards.shards_of(spark, 6000, 100) == 3 and shards.shards_of(spark, 10**5, 100) == spark.sparkContext.defaultParallelism


def test_each_shard_has_a_partition(spark):
    rows = spark.range(70).select((F.col("id") % 7).cast("int").alias("shard"))
    parts = shards._dealt(rows, 7).select("shard", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 7 == parts.select("p").distinct().count()


class PlainMarkov:
    def __init__(self, urls):
        self.seen = defaultdict(Counter)
        for u in urls:
            text = b"\xff" * 5 + u + b"\xfe"
            for i in range(5, len(text)):
                for n in range(6):
                    self.seen[text[i - n : i]][text[i]] += 1

    def likelihood(self, context, byte):
        if context is None:
            return 1 / 256
        shorter = self.likelihood(context[1:] if context else None, byte)
        c = self.seen.get(context)
        return shorter if c is None else (c[byte] + len(c) * shorter) / (c.total() + len(c))

    def log(self, u):
        text = b"\xff" * 5 + u + b"\xfe"
        return sum(math.log(self.likelihood(text[i - 5 : i], text[i])) for i in range(5, len(text)))


def test_markov_equals_plain():
    good, bad = [b"http://a.org/fr/1", b"http://a.org/fr/22", "http://ü.org".encode()], [b"https://b.net/x?y", b"http://b.net", b""]
    known = []
    for urls in (good, bad):
        key, n = np.unique(url_filter.keys_of(urls)[0], return_counts=True)
        known.append(url_filter.Markov.of(key, n.astype(float)))
    model, plain = url_filter.Model(*known), (PlainMarkov(good), PlainMarkov(bad))
    asked = [*good, *bad, b"http://c.com/fr/", b"zzz", b"q" * 1_200_000]
    expected = [(plain[0].log(u) - plain[1].log(u)) / (len(u) + 1) for u in asked[:-1]]
    got = model.scores(asked)
    assert np.allclose(got[:-1], expected, atol=1e-9) and np.isfinite(got).all()
    assert all(abs(sum(known[0].likelihood(np.array([(k << 8) | b for b in range(256)], np.uint64))) - 1) < 1e-9 for k in (0, 0xFFFFFFFFFF, int.from_bytes(b"a.org", "big")))
    empty = url_filter.Markov.of(np.zeros(0, np.uint64), np.zeros(0))
    assert np.allclose(empty.likelihood(np.array([5], np.uint64)), 1 / 256)


def test_cut():
    at = url_filter.best_cut(np.array([-2.0, -1.0, 1.0, 3.0]), np.array([False, False, True, True]))
    assert at == 0.0 and url_filter.best_cut(np.array([1.0]), np.array([True])) == 0.0 and url_filter.best_cut(np.zeros(0), np.zeros(0, bool)) == 0.0
    assert 4 < url_filter.best_cut(np.array([4.0, 4.0, 5.0]), np.array([False, False, True])) < 5


def test_urls(spark):
    draw = np.random.default_rng(24)
    urls = [f"http://{h}.{d}/{p}/{n}" for h, d, p, n in zip(draw.choice(["shop", "blog"], 400), draw.choice(["example.net", "example.com", "example.org"], 400), draw.choice(["en", "de", "fr"], 400), draw.integers(0, 9999, 400), strict=True)]
    odd = [None, "", "no host", "HTTP://WWW.Example.NET/EN/x", "http://example.net/en/x", "a://b://c.net/", "http://net", "http://net/", "http://xnet/", "x://example.com?q=/de/", "x://EXAMPLE.com/de/?http://y", "x://a.org/fr/\n#?", "x://İ.net/", "http://z.com/" + "w/" * 300_000, urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls + odd)] + [(None, urls[1], "r")], "page_id long, url string, rule string")
    model = url_filter.learn(pages, queries.URL_RULES)
    out = url_filter.judge(pages, queries.URL_RULES, model)
    assert out.columns == ["page_id", "url", "rule", "host", "path", "rule_", "verdict", "score"]
    rows = out.collect()
    assert len(rows) == len(urls) + len(odd) + 1
    for r in rows:
        rest = r.url.partition("://")[2] if r.url else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])])
        path = rest[len(host) :]
        path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule_) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2] and r.score is None
        elif not r.url:
            assert r.verdict == "allow" and r.score is None
        else:
            s = model.scores([r.url.encode()])[0]
            assert abs(r.score - s) < 1e-9 and r.verdict == ("block" if s < model.cut else "allow")
    judged = {r.page_id: r.verdict for r in rows if r.page_id is not None and r.page_id < 400}
    assert all(judged[i] == "allow" for i, u in enumerate(urls) if "example.org/fr" in u) and all(judged[i] == "block" for i, u in enumerate(urls) if "example.net/de" in u)
    none = url_filter.learn(pages.limit(0), queries.URL_RULES)
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, none).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, (), none).collect()} == {"allow"}


def test_cut_by_ranges(spark):
    draw = np.random.default_rng(25)
    for n in (1, 40, 3000):
        scores, allowed = draw.integers(-60, 60, n) / 8, draw.random(n) < 0.4
        scores[allowed] += 2
        rows = spark.createDataFrame([(bool(a), float(s)) for a, s in zip(allowed, scores, strict=True)], "allowed boolean, score double")
        assert url_filter.cut_of(rows) == url_filter.best_cut(scores, allowed)
        if allowed.any() and not allowed.all():
            errors = [(scores[allowed] < c).mean() + (scores[~allowed] >= c).mean() for c in [url_filter.best_cut(scores, allowed), *(scores + 1 / 16), scores.min()]]
            assert errors[0] <= min(errors) + 1e-12
    assert url_filter.cut_of(rows.where("allowed")) == 0.0 == url_filter.cut_of(rows.limit(0))


def test_all_urls_are_learnt(spark, monkeypatch):
    """More than 2 MB of allowed URLs: scores and cut are those of models of all of them."""
    draw = np.random.default_rng(26)
    monkeypatch.setattr(url_filter, "GROUP_KEYS", 1000)
    allowed = [f"https://example.org/fr/{'/'.join(f'{x:x}' for x in row)}" for row in draw.integers(0, 1 << 30, (36_000, 6)).tolist()]
    blocked = [f"http://shop.net/{x}/{x * 7 % 1000}" for x in range(900)]
    asked = [f"http://{h}.com/{x}/{x:x}" for h, x in zip(draw.choice(["shop", "org", "example"], 300).tolist(), draw.integers(0, 1 << 30, 300).tolist(), strict=True)]
    assert sum(map(len, allowed)) > 2 << 20
    pages = spark.createDataFrame(list(enumerate(allowed + blocked + blocked[:9] + asked)), "page_id long, url string")
    unseen = {r.url: r.unseen for r in pages.select("url", (F.pmod(F.xxhash64(F.lit(2), "url"), F.lit(5)) == 0).alias("unseen")).collect()}
    known = []
    for urls in (allowed, blocked):
        key, n = np.unique(url_filter.keys_of([u.encode() for u in set(urls) if not unseen[u]])[0], return_counts=True)
        known.append(url_filter.Markov.of(key, n.astype(float)))
    plain = url_filter.Model(*known)
    model = url_filter.learn(pages, queries.URL_RULES)
    got = {r.url: (r.score, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES, model).where("rule is null").collect()}
    expected = plain.scores([u.encode() for u in asked])
    assert set(got) == set(asked) and np.allclose([got[u][0] for u in asked], expected, atol=1e-12)
    held = [u for u in {*allowed, *blocked} if unseen[u]]
    assert abs(model.cut - url_filter.best_cut(plain.scores([u.encode() for u in held]), np.array(["/fr/" in u for u in held]))) < 1e-9
    monkeypatch.setattr(url_filter, "FEW", 0)
    assert np.allclose(model.scores([u.encode() for u in asked[:5]]), expected[:5], atol=1e-12)
