"""Near dedup of the pipeline against all pairs."""

from itertools import combinations

import numpy as np

from cloudloom.llm import simhash


def left_by_brute_force(texts):
    """What reaches no smaller place over pairs that are 0.8 alike."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if simhash.shingle_similarity(texts[a].encode(), texts[b].encode()) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in root if root[i] == i}


def kept(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_dissimilar(rows).collect()}


def test_reordered_texts_of_one_vocabulary(spark):
    """All have one set of words; each text's copy stands far from it and neither is the least or greatest document."""
    draw = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [draw.permutation(vocabulary * 2).tolist() for _ in range(12)]
    copies = [[*b[2:], *b[:2]] for b in base[1:11]]
    texts = [" ".join(x) for x in [*base, *copies, draw.permutation(vocabulary * 2).tolist()]]
    want = left_by_brute_force(texts)
    assert len(want) == 13 and kept(spark, texts) == want


def test_a_bucket_of_unlike_documents_with_copies_inside(spark):
    """One passage is in all documents, the least and the greatest are unlike the rest."""
    draw = np.random.default_rng(12)
    words = lambda n: [f"x{i}" for i in draw.integers(0, 1 << 40, n)]
    passage = words(40)
    texts = [passage + words(8)]
    for _ in range(15):
        own = words(12)
        texts += [passage + own, [*passage, *own[:-1], "end"]]
    texts = [" ".join(x) for x in [*texts, passage + words(9)]]
    want = left_by_brute_force(texts)
    assert len(want) == 17 and kept(spark, texts) == want


def test_appended_passages_at_the_bound(spark):
    """A quarter of new words at the end: the similarity is just 0.8 and all are found."""
    draw = np.random.default_rng(13)
    words = lambda n: [f"x{i}" for i in draw.integers(0, 1 << 40, n)]
    texts = []
    for _ in range(60):
        a = words(84)
        texts += [" ".join(a), " ".join(a + words(20))]
    assert simhash.shingle_similarity(texts[0].encode(), texts[1].encode()) == 0.8
    assert kept(spark, texts) == set(range(0, 120, 2))


def test_texts_without_words_are_alike(spark):
    texts = ["a b", None, "", "a  B", " \n", "c"]
    assert kept(spark, texts) == {0, 1, 5}


def test_what_repeats_is_counted_in_place():
    """A block of 3,000,000 hashes, few of them equal, takes little more than itself."""
    import tracemalloc

    draw = np.random.default_rng(14)
    block = draw.integers(0, 1 << 62, 3_000_000).astype(np.uint64)
    block[:5], block[10:13] = 7, 9
    want = np.unique(block, return_counts=True)
    tracemalloc.start()
    value, times = simhash.repeated(block)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < block.nbytes / 4
    assert value.tolist() == want[0][want[1] > 1].tolist() and times.tolist() == want[1][want[1] > 1].tolist()
    assert not len(simhash.repeated(np.zeros(0, np.uint64))[0]) and simhash.repeated(np.full(4, 3, np.uint64))[1].tolist() == [4]


def test_blocks_may_end_inside_a_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    text = " ".join(f"w{i}" for i in range(40))
    shingle, times = simhash.common_shingles(spark.createDataFrame([(i, text.encode()) for i in range(16)], "id long, t binary").coalesce(1))
    assert len(shingle) == 36 and (times > 1).all()


def test_documents_meet_by_fingerprints_first(spark, monkeypatch):
    """What op2 links is what near dedup compares first; one repeated passage gives one fingerprint to texts that are not alike, and both stay."""
    draw = np.random.default_rng(15)
    words = lambda n: [f"x{i}" for i in draw.integers(0, 1 << 40, n)]
    texts = []
    for _ in range(6):
        a = words(900)
        texts += [" ".join(a), " ".join([*a[:-1], "end"]), " ".join([*a, *words(150)])]  # at two bits or less, beyond them
    texts += ["lorem ipsum dolor sit amet " * 2000 + " ".join(words(40)) for _ in range(2)] + [None, "", texts[0].upper()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []
    own = simhash.fingerprint_pairs

    def seen(*a):
        out = own(*a)
        met.extend(out.collect())
        return out

    monkeypatch.setattr(simhash, "fingerprint_pairs", seen)
    want = left_by_brute_force([t or "" for t in texts])
    assert {r.doc_id for r in simhash.keep_dissimilar(rows).collect()} == want and {18, 19} <= want
    reach = {r.node: r.component for r in simhash.connected_components(spark.createDataFrame(met), "a", "b").collect()}
    assert {r.doc_id: r.component_id for r in simhash.near_dedup(rows).collect()} == {i: reach.get(i, i) for i in range(len(texts))}
    assert any(reach.get(i + 1) == i for i in range(0, 18, 3)) and reach[19] == 18
