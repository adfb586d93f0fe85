"""Best-fit packing of token sequences by a configuration linear program.

Only the length histogram (one count for each length up to the capacity) reaches the
driver, whatever the number of documents. A configuration is a multiset of lengths that
fits one sequence; the program asks for the fewest configurations that cover all counts.

Multiplicative weights solve it. A length's weight falls exponentially with the part of
its count that is covered so far; its price is its weight over its count. One knapsack
dynamic program prices all lengths at once: it gives the configuration of the highest
price and, for each length, the best configuration that holds it. Those close to the
highest price are used for a small share of their counts, so no length gains more than
``STEP`` of its count before prices are taken again. The uses of all rounds, averaged, are
the solution. Each round's prices over the highest price are a solution of the dual
program, so they bound the number of sequences from below; when rounding comes within
``GAP`` of the best bound, the rounds end.

The solution is rounded down to whole sequences, what is left is solved again, and the
rest goes best fit. Best fit works on counts too: bins that are filled alike are one
entry. Of the tries, plain best fit among them, the one with the fewest sequences stays.

The plan is a table of slots: for each (length, configuration) which ranks of that length
go where. Pieces get ranks within their length by hash buckets and running counts of the
buckets, so a length with a third of all rows is dealt out like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_free, stored
from .tokens import batches, crc_of, encoder, give_back, release

CAPACITY = 2048
BATCH_BYTES = 3 << 20  # of text that is encoded together
ROUNDS, BURN, STEP, ETA = 240, 60, 0.1, 5.0  # pricings at most, those that do not count; coverage a round; how fast weights fall with coverage, over the root of the round
SLACK, GAP = 0.01, 0.0005  # configurations so close to the highest price are used; the gap at which rounds end
Config = tuple[int, ...]  # lengths, longest first
Runs = dict[Config, int]  # how many sequences hold a configuration


def priced(prices: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(value, used, choice) for each room from 0 to the capacity: the highest price of lengths that fit it, how much of the room they need, and one of them.

    ``prices`` is by length, 0 for lengths that do not occur; any number of copies may be taken.
    """
    room = len(prices) - 1
    value, used, choice = np.zeros(room + 1), [0] * (room + 1), [0] * (room + 1)
    for c in range(1, room + 1):
        got = prices[1 : c + 1] + value[c - 1 :: -1]
        best = int(got.argmax())
        if got[best] > value[c - 1]:
            value[c], used[c], choice[c] = got[best], c, best + 1
        else:
            value[c], used[c] = value[c - 1], used[c - 1]
    return value, used, choice


def fractional(counts: np.ndarray, rounds: int = ROUNDS, step: float = STEP, eta: float = ETA, slack: float = SLACK, gap: float = GAP, burn: int = BURN) -> tuple[dict[Config, float], float]:
    """({configuration: times}, lower bound) for ``counts`` by length: the averaged solution of the program and its best dual bound."""
    capacity = len(counts) - 1
    there = np.flatnonzero(counts)
    covered, logs, uses, bound = np.zeros(capacity + 1), np.zeros(capacity + 1), Counter(), float(counts @ np.arange(capacity + 1)) / capacity
    for turn in range(1, rounds + 1):
        prices = np.zeros(capacity + 1)
        prices[there] = np.exp(logs[there] - logs[there].max()) * there  # with equal weights all tokens have one price
        value, used, choice = priced(prices)
        bound = max(bound, float(counts @ prices) / value[capacity])
        gain = dict.fromkeys(there.tolist(), 0.0)
        near = there[prices[there] + value[capacity - there] >= (1 - slack) * value[capacity]]
        for first in near[np.argsort(covered[near], kind="stable")].tolist():
            if gain[first] >= step:
                continue
            held, room = [first], used[capacity - first]
            while room:
                held.append(choice[room])
                room = used[room - choice[room]]
            config = Counter(held)
            times = min((step - gain[k]) * counts[k] / n for k, n in config.items())
            if times <= 0:
                continue
            for k, n in config.items():
                gain[k] += times * n / counts[k]
            uses[tuple(sorted(held, reverse=True))] += times
        for k, g in gain.items():
            covered[k] += g
            logs[k] -= eta * g / turn**0.5
        if turn == burn:
            uses.clear()
            covered[:] = 0.0
        if turn % 20 == 0 and turn > burn and sum(uses.values()) <= (1 + gap) * bound * covered[there].min():
            break
    share = float(counts @ np.arange(capacity + 1)) / float((counts * covered) @ np.arange(capacity + 1))
    return {c: x * share for c, x in uses.items()}, bound


def best_fit(histogram: dict[int, int], capacity: int) -> Runs:
    """Bins for the lengths of ``histogram``, longest first, each into the fullest bin that has room; bins filled alike are one entry."""
    gaps: list[int] = []  # ascending, with room left
    bins: dict[int, list[tuple[Config, int]]] = {}
    done: Counter[Config] = Counter()

    def put(gap: int, config: Config, n: int, least: int) -> None:
        if gap < least:
            done[config] += n
            return
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((config, n))

    least = min((k for k, n in histogram.items() if n > 0), default=1)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        at = bisect_left(gaps, length)
        while left > 0 and at < len(gaps):
            gap = gaps.pop(at)
            held = bins.pop(gap)
            most = gap // length  # a bin takes all that it has room for: it stays the fullest
            for config, n in held:
                whole = min(n, left // most)
                left -= whole * most
                if whole:
                    put(gap - most * length, config + (length,) * most, whole, least)
                if n > whole and 0 < left < most:
                    put(gap - left * length, config + (length,) * left, 1, least)
                    whole, left = whole + 1, 0
                if n > whole:
                    put(gap, config, n - whole, least)
            at = bisect_left(gaps, length)
        most = capacity // length
        if left >= most:
            put(capacity - most * length, (length,) * most, left // most, least)
        if left % most:
            put(capacity - left % most * length, (length,) * (left % most), 1, least)
    for held in bins.values():
        for config, n in held:
            done[config] += n
    return dict(done)


def take_whole(uses: dict[Config, float], left: dict[int, int], up: bool) -> Runs:
    """Whole uses of ``uses`` as far as ``left`` goes, which loses what they take: rounded down, or one more of each (``up``), the largest remainder first."""
    runs: Runs = {}
    for config, x in sorted(uses.items(), key=lambda u: (-(u[1] % 1 if up else u[1]), u[0])):
        held = Counter(config)
        n = min(1 if up else int(x + 1e-9), *(left.get(k, 0) // a for k, a in held.items()))
        if n > 0:
            runs[config] = n
            for k, a in held.items():
                left[k] -= n * a
    return runs


def plan(histogram: dict[int, int], capacity: int = CAPACITY, solutions: int = 3) -> list[tuple[Config, int]]:
    """[(lengths of a sequence, number of such sequences)] that hold each length as often as ``histogram`` says.

    After each rounding the rest is tried by best fit, and the best of all tries stays;
    plain best fit is the first of them.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    best = Counter(best_fit(left, capacity))
    runs: Counter[Config] = Counter()
    bound = ceil(sum(k * n for k, n in left.items()) / capacity)
    for solution in range(solutions):
        if not left or sum(best.values()) <= bound:
            break
        counts = np.zeros(capacity + 1)
        counts[list(left)] = list(left.values())
        uses, dual = fractional(counts)
        if solution == 0:
            bound = ceil(dual - 1e-6)
        for up in (False, True):
            runs.update(take_whole(uses, left, up))
            left = {k: n for k, n in left.items() if n > 0}
            whole = runs + Counter(best_fit(left, capacity))
            best = min(best, whole, key=Counter.total)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def slots(runs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset), by length and first rank."""
    rows, ranks, sequence = [], Counter(), 0
    for lengths, n in runs:
        offset = 0
        for length, copies in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, ranks[length], sequence, copies, offset))
            ranks[length] += n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(parts: Iterator[pa.RecordBatch], tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, added: bool = False) -> Iterator[pa.RecordBatch]:
    """The pieces of batches of (doc_id, text); each batch's memory goes back before the next."""
    enc = encoder(tokenizer, added)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    for batch in batches(parts, most=BATCH_BYTES):
        rows = []
        for doc, got in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
            ids = np.append(got, np.uint32(end_id))
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                rows.append((doc, k, a, b - a, crc_of(ids[a:b]), *([ids[a:b].astype(np.int32)] if with_ids else [])))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)
        del rows, columns
        give_back()


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut into full pieces but the first."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda parts: cut(parts, tokenizer, end_id, capacity, with_ids, added), schema)


def pack(rows: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY, bucket_rows: int = 50_000) -> DataFrame:
    """``rows`` with sequence_id and offset. ``order`` makes rows of one length distinct.

    ``rows`` must be a stored table: it is read for the histogram, for the buckets' counts
    and for the result, and must say the same each time. Lengths are from 1 to
    ``capacity``. Rows that agree in all of ``order`` change places freely. An empty table
    gives no rows. New columns that clash with one of ``rows`` get underscores at the end.
    """
    bucket, place_, in_bucket = (column_free(rows, c) for c in ("bucket_", "rank_", "b_"))
    names = [column_free(rows, c) for c in ("sequence_id", "offset")]
    histogram = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}
    table = slots(plan(histogram, capacity))
    n = max(1, -(-max(histogram.values(), default=0) // bucket_rows))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n)))
    running = Window.partitionBy(length).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(length, bucket).count().withColumn("before", F.coalesce(F.sum("count").over(running), F.lit(0)))
    before = before.select(F.col(length).alias(f"{in_bucket}length"), F.col(bucket).alias(in_bucket), F.col("before").alias(f"{in_bucket}before"))
    within = F.row_number().over(Window.partitionBy(length, bucket).orderBy(*order)) - 1
    ranked = dealt.withColumn(place_, within).join(before, (F.col(length) == F.col(f"{in_bucket}length")) & (F.col(bucket) == F.col(in_bucket)))
    ranked = ranked.select(*rows.columns, (F.col(place_) + F.col(f"{in_bucket}before")).alias(place_))
    base = 1 << 40
    keys = table[:, 0] * base + table[:, 1]

    def place(parts):
        release()  # the pieces are stored: no task needs the encoder again
        for batch in parts:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            size = batch.column(batch.schema.get_field_index(length)).to_numpy()
            at = np.searchsorted(keys, size * base + rank, side="right") - 1
            q = rank - table[at, 1]
            arrays = [*batch.columns[:-1], pa.array(table[at, 2] + q // table[at, 3]), pa.array(table[at, 4] + q % table[at, 3] * size)]
            yield pa.record_batch(arrays, names=[*batch.schema.names[:-1], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{names[0]}` long, `{names[1]}` long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Every piece of every row of ``docs`` with its place: a null or empty text is the end id alone.

    Rows that share a doc_id are packed each on its own; a null doc_id is kept. A text of
    any length is cut whole. An empty table gives no rows.
    """
    rows = stored(pieces(docs, tokenizer, text, doc_id, end_id, capacity, with_ids, added), "pieces")
    return pack(rows, ["doc_id", "piece", "start", "ids_crc32"], "length", capacity)
