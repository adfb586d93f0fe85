"""SimHash near-dedup by Golay-code fuzzy hashing.

Equal fingerprints are one node. A fingerprint of 64 bits is cut into three segments
(22, 21 and 21 bits). Two that differ in at most two bits agree on one segment, by the
pigeonhole, and differ in at most two bits of the next. That next segment, padded to 23
bits, is decoded by the perfect binary Golay code: its keys are the codewords within
distance 4, of which a word has one (at distance 2 or less from its codeword) or six
(at distance 3). Words at distance 2 or less share one of them, since the word half way
between them lies within 3 of a codeword. So a fingerprint has at most 18 keys (segment,
its bits, codeword index), each of 34 bits, and every link meets on one of them; the
join then verifies.

A fingerprint has at most 2,080 others within two bits, so verified links are linear in
the number of different fingerprints. A bucket over ``wide`` fingerprints is not joined
with itself: its members are keyed once more with every two of the remaining bits
masked out. At most four of them agree on such a key, so each costs a fixed number of
rows, and all pairs that agree are links: both ways give the same links.
"""

from __future__ import annotations

import gc
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.tables import free
from .common import column_free, stored
from .tokens import batches, release

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width of each
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the binary Golay code of length 23
BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    tokens = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters alone
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = [0, *ends[: -words].tolist()]
        shingles = [line[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    hashed = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8").view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(hashed[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(shingles)).tolist())


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; a null text has the fingerprint zero."""

    def run(parts):
        for batch in batches(parts):
            values = [fingerprint(t or b"", words) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _remainder(v: np.ndarray) -> np.ndarray:
    """The syndrome: what is left of 23-bit words divided by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


@cache
def _patterns() -> np.ndarray:
    """For each of 2,048 syndromes, the error patterns of weight 4 or less: one, or six of which five have weight 4; -1 fills."""
    out = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for word, s in zip(words.tolist(), _remainder(words).tolist(), strict=True):
            out[s, used[s]] = word
            used[s] += 1
    return out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): indices (12 bits) of the codewords within distance 4 of 23-bit words; -1 fills."""
    errors = _patterns()[_remainder(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of unsigned 64-bit fingerprints."""
    rows, keys = [], []
    parts = [(fp >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1) for shift, width in SEGMENTS]
    for i in range(3):
        codes = golay_keys(parts[(i + 1) % 3])
        row, col = np.nonzero(codes >= 0)
        rows.append(row)
        keys.append(i << 34 | parts[i][row] << 12 | codes[row, col])
    return np.concatenate(rows), np.concatenate(keys)


WIDE = 2048  # from about here on, masking a member's pairs of bits costs less than meeting all members


def links(nodes: DataFrame, wide: int = WIDE) -> DataFrame:
    """(a, b) with a < b (as signed): different fingerprints of ``nodes`` (fp) that differ in at most two bits."""

    def run(parts):
        for batch in parts:
            fp = batch.column(0).to_numpy()
            row, key = fuzzy_keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keyed = stored(nodes.select("fp").mapInArrow(run, "key long, fp long"), "keys")
    wide_keys = keyed.groupBy("key").count().where(F.col("count") > wide).select("key")
    wide_keys = stored(wide_keys, "wide")
    some = not wide_keys.isEmpty()
    usual = keyed.join(wide_keys, "key", "left_anti") if some else keyed
    # a pair is taken where its first agreeing segment is the key's, so other segments do not repeat it
    differs = [F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), shift).bitwiseAND((1 << width) - 1) != 0 for shift, width in SEGMENTS]
    segment = F.shiftright("key", 34)
    first = (segment == 0) | ((segment == 1) & differs[0]) | ((segment == 2) & differs[0] & differs[1])
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2) & first
    left, right = usual.select("key", F.col("fp").alias("a")), usual.select(F.col("key").alias("key_b"), F.col("fp").alias("b"))
    found = left.join(right, (F.col("key") == F.col("key_b")) & near).select("a", "b")
    if some:
        found = found.union(masked_links(keyed.join(wide_keys, "key", "left_semi").select(F.shiftright("key", 34).alias("segment"), "fp").distinct()))
    found = stored(found.distinct(), "links")
    free(keyed, wide_keys)
    return found


def masked_links(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: all of ``members`` (segment, fp) that agree on the segment and in all but two of the other bits."""

    def run(parts):
        for batch in parts:
            segment, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for i, (shift, width) in enumerate(SEGMENTS):
                mine = fp[segment == i]
                rest = [b for b in range(64) if not shift <= b < shift + width]
                for block in range(0, len(mine), 1024):
                    part = mine[block : block + 1024]
                    for p, q in combinations(rest, 2):
                        kept = part & ~np.uint64(1 << p | 1 << q)
                        code = np.full(len(part), (i * 64 + p) * 64 + q, np.int32)
                        yield pa.record_batch([pa.array(code), pa.array(kept.view(np.int64)), pa.array(part.view(np.int64))], names=["code", "kept", "fp"])

    masked = members.mapInArrow(run, "code int, kept long, fp long")
    several = masked.groupBy("code", "kept").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # four at most
    both = several.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return both.where("a < b")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, wide: int = WIDE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fp, component_id, n_links.

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id
    that can be reached; rows that repeat an id or a text are rows like any other. Texts
    without words (null too) have the fingerprint zero and link like any other. A null
    doc_id keeps its row and is nobody's component_id, unless no other id is reached.
    n_links counts the fingerprints linked to the row's own. A text of any length is read
    whole. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, text, doc_id, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes, wide)
    reach = connected_components(found, "a", "b", small=0).withColumnRenamed("node", "fp")
    degree = found.select(F.col("a").alias("fp")).unionAll(found.select("b")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    of = nodes.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    known = of.join(least, "component").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(known, "fp").select("doc_id", "fp", "component_id", "n_links")


# --- near copies by similarity ----------------------------------------------------
#
# Documents meet by their SimHash first, as above: those of one fingerprint, and those
# whose fingerprints the Golay keys link. What so meets is compared by the shingles
# themselves, since texts of one often repeated passage may have one fingerprint and
# little else in common. Two bits do not reach every edit, so what is not joined yet goes
# on to an exact filter. Sets of word shingles that are ``similarity`` alike share at least that part of the
# larger set. So with all sets in one order of shingles, each pair has a shingle that is
# among the first n - ceil(similarity * n) + 1 of both (prefix filter): these are a
# document's keys, and no similar pair is without a common one. The order puts shingles
# that many documents have last, by their counts, which keeps buckets small; any order
# gives the same pairs. What meets is compared by the shingles themselves.

COMMON, OFTEN = 200_000, 2  # so many shingles stand last at most; counted where a block of texts has one so often
BLOCK, BLOCK_ROWS = 6_000_000, 16_000  # shingles counted at once, and about so many texts
KNOWN_WORDS = 200_000  # words whose hash a worker remembers


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, 42)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


def shingle_hashes(text: bytes, known: _Words, words: int = 5) -> np.ndarray:
    """Hashes of a text's different word shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    out = np.zeros(max(1, len(h) - words + 1), np.uint64)
    for i in range(min(words, len(h))):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def repeated(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) of what ``block`` has ``OFTEN`` times or more. It is sorted in place: an executor's workers have no room for copies of it."""
    block.sort()
    at = np.flatnonzero(block[1:] == block[:-1])
    new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    times = np.diff(np.append(new, len(at))) + 1
    often = times >= OFTEN
    return block[at[new[often]]], times[often]


def common_shingles(rows: DataFrame, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the shingles of ``rows`` (id, t) that most documents have, ascending by hash."""

    def count(parts):
        release()
        known, held, n = _Words(), np.empty(BLOCK, np.uint64), 0

        def out():
            shingle, c = repeated(held[:n])
            return pa.record_batch([pa.array(shingle.view(np.int64)), pa.array(c.astype(np.int64))], names=["shingle", "c"])

        for batch in batches(parts, "t"):
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t or b"", known, words)
                while len(h):
                    part, h = h[: BLOCK - n], h[BLOCK - n :]
                    held[n : n + len(part)] = part
                    n += len(part)
                    if n == BLOCK:
                        yield out()
                        n = 0
        yield out()

    blocks = -(-rows.count() // BLOCK_ROWS)  # many small partitions would each see too little of what is common
    counted = rows.coalesce(max(1, blocks)).mapInArrow(count, "shingle long, c long").groupBy("shingle").agg(F.sum("c").alias("c"))
    top = counted.orderBy(F.desc("c"), "shingle").limit(COMMON).toArrow()
    shingle, c = top["shingle"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    order = np.argsort(shingle)
    return shingle[order], c[order]


def shingle_keys(rows: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, id, n, at): the keys of ``rows`` (id, t), the number of a document's shingles and the key's place among them."""
    shingle, count = common_shingles(rows, words)

    def run(parts):
        release()
        known = _Words()
        for batch in batches(parts, "t"):
            keys, sizes, ns = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t or b"", known, words)
                n = len(h)
                first = n - int(np.ceil(similarity * n - 1e-9)) + 1
                if len(shingle) and n:
                    place = np.minimum(np.searchsorted(shingle, h), len(shingle) - 1)
                    h = h[np.argsort(np.where(shingle[place] == h, count[place], 0), kind="stable")]
                keys.append(h[:first] if n else np.zeros(1, np.uint64))  # texts without words are alike
                sizes.append(len(keys[-1]))
                ns.append(n)
            sizes = np.asarray(sizes, np.int64)
            at = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
            ids = np.repeat(batch.column(0).to_numpy(), sizes)
            columns = [np.concatenate(keys).view(np.int64), ids, np.repeat(np.asarray(ns, np.int32), sizes), at.astype(np.int32)] if keys else [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "id", "n", "at"])

    return rows.mapInArrow(run, "key long, id long, n int, at int")


def shingle_similarity(a: bytes, b: bytes, words: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; a text of fewer words is one shingle, one without words has none."""

    def shingles(text: bytes) -> set[bytes]:
        w = text.lower().split()
        return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    s, t = shingles(a), shingles(b)
    both = len(s & t)
    return both / (len(s) + len(t) - both) if s or t else 1.0


def fingerprint_pairs(rows: DataFrame, wide: int = WIDE) -> DataFrame:
    """(a, b) with a < b: enough pairs of ``rows`` (id, t) to link all of one fingerprint and all whose fingerprints differ in at most two bits, as :func:`near_dedup` links them."""
    prints = stored(fingerprints(rows, "t", "id"), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    near = links(nodes, wide)
    same = prints.join(nodes, "fp").where(F.col("doc_id") > F.col("least")).select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    of = lambda p: nodes.select(F.col("fp").alias(p), F.col("least").alias(f"least_{p}"))
    across = near.join(of("a"), "a").join(of("b"), "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    out = stored(same.unionByName(across), "met")
    free(prints, nodes, near)
    return out


def _tried(least: DataFrame, pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(the similar ones, those compared) of ``pairs`` (a, b): each document first meets its least partner of ``least``; of the other pairs, those that this has joined need no look."""
    first = stored(least.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    found = _compared(first, rows, words, similarity)
    rest = stored(_apart(pairs.join(first, ["a", "b"], "left_anti"), connected_components(found, "a", "b", small=0)), "rest")
    return found.unionByName(_compared(rest, rows, words, similarity)), first.unionByName(rest)


def similar_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): pairs of documents whose shingle sets are at least ``similarity`` alike, enough to link each such pair.

    Documents whose fingerprints link meet first. Of those that this does not join, every
    member of a bucket of the filter meets the least and the greatest member. Then all
    pairs of members that these links have not joined meet, whatever the bucket's size.
    A document with a null id takes no part.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    near = fingerprint_pairs(rows)
    found, tried = _tried(near, near, rows, words, similarity)
    joined = connected_components(found, "a", "b", small=0)
    keys = stored(shingle_keys(rows, words, similarity), "keys")
    met = keys.groupBy("key").count().where("count > 1").select("key")
    shared = stored(keys.withColumn("place", F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).select("key", "id", "place").join(met, "key"), "shared")
    free(keys)
    shared_by = shared.select("key", "id", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("at"))
    ends = shared.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    ended = shared_by.join(ends, "key")
    of = lambda p: (F.col("id").alias(p), F.col("n").alias(f"n{p}"), F.col("at").alias(f"at{p}"))
    # what can still be common from a pair's first common key on must do
    fit = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-6
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def star(end: str) -> DataFrame:
        centre, member = ended.where(F.col("id") == F.col(end)).select("key", *of("a")), ended.where(F.col("id") != F.col(end)).select("key", *of("b"))
        return _apart(centre.join(member, "key").where(fit).select(*ordered).distinct(), joined).join(tried, ["a", "b"], "left_anti")

    low = stored(star("low"), "low")
    more, also = _tried(low, low.unionByName(star("high")).distinct(), rows, words, similarity)
    found, tried = found.unionByName(more), tried.unionByName(also)
    reach = connected_components(found, "a", "b", small=0).select(F.col("node").alias("id"), "component")
    # buckets that are still in several parts, by part, so that a part is not joined with itself, and by size, since sizes of similar texts differ little
    band = F.floor(F.log("n") / float(-np.log(similarity)) + 1e-9).cast("int").alias("band")
    split = stored(shared_by.join(reach, "id", "left").select("key", "id", "n", "at", F.coalesce("component", "id").alias("part"), band), "split")
    free(shared)
    several = split.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("key")
    split = split.join(several, "key", "left_semi")
    # what a pair needs in common grows with its sizes, so a part's least size and its most that follows the key bound what its members can reach
    parts = stored(split.groupBy("key", "part", "band").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("at")).alias("room")), "parts")
    need = lambda x, y: (F.col(x) + F.col(y)) * (similarity / (1 + similarity)) - 1e-6
    side = lambda p: parts.select("key", *(F.col(c).alias(f"{c}_{p}") for c in ("part", "band", "least", "room")))
    meet = side("a").withColumn("at_band", F.explode(F.array(*(F.col("band_a") + k for k in (-1, 0, 1))))).join(side("b").withColumn("at_band", F.col("band_b")), ["key", "at_band"])
    meet = meet.where((F.col("part_a") < F.col("part_b")) & (F.least("room_a", "room_b") >= need("least_a", "least_b"))).drop("at_band", "least_a", "room_a")
    member = lambda p: split.select("key", F.col("part").alias(f"part_{p}"), F.col("band").alias(f"band_{p}"), *of(p))
    reached = meet.join(member("a"), ["key", "part_a", "band_a"]).where(F.least(F.col("na") - F.col("ata"), F.col("room_b")) >= need("na", "least_b"))
    joint = reached.join(member("b"), ["key", "part_b", "band_b"])
    # at a pair's first common key, what follows it must suffice on both sides: most keys that merely happen to be common come too late
    every = joint.where((F.col("a") != F.col("b")) & fit).select(*ordered).distinct()
    every = stored(every.join(tried, ["a", "b"], "left_anti"), "every")
    free(near, low, parts)
    gc.collect()  # Spark removes the shuffle files of the steps before when the driver's garbage goes
    docs.sparkSession.sparkContext._jvm.System.gc()
    return found.unionByName(_compared(every, rows, words, similarity))


def _apart(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that are in different components of ``reach`` (node, component)."""
    side = lambda p: reach.select(F.col("node").alias(p), F.col("component").alias(f"{p}_of"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b")


def _compared(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts in ``rows`` (id, t) are similar."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    part = stored(rows.join(ends, "id", "left_semi"), "texts")
    texts = pairs.join(part.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(part.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def compare(parts):
        release()
        for batch in batches(parts, "tb"):
            good = [shingle_similarity(x or b"", y or b"", words) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = stored(texts.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"), "similar")
    free(part)
    return out


def keep_dissimilar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that reach a smaller row over similar pairs.

    Rows are in the order of doc_id, null ids last, and of rows with one id those with
    smaller text hashes first; each row stands for itself, so of two unlike texts with
    one id only a near copy goes. Rows that repeat id and text are copies: one stays.
    Null texts and texts without words are alike. Texts of any length are compared whole.
    Columns of any name pass through. An empty table gives no rows.
    """
    # a number for each row in that order, without one task sorting all: ids themselves, unless some repeat or are null
    own = F.col(doc_id).cast("long")
    counts = docs.select(own.alias("i")).groupBy("i").count().where(F.col("i").isNull() | (F.col("count") > 1))
    if counts.isEmpty():
        rows, at = docs, doc_id
    else:
        at = column_free(docs, "row_number__")
        order = (own.asc_nulls_last(), F.xxhash64(text))
        ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = stored(ranged.withColumn(at, F.monotonically_increasing_id()), "numbered")
    reach = connected_components(similar_pairs(rows, text, at, words, similarity), "a", "b", small=0)
    gone = reach.where("node > component").select(F.col("node").alias(column_free(rows, "gone_id")))
    return rows.join(gone, rows[at] == gone[gone.columns[0]], "left_anti").select(*docs.columns)
