"""Best-fit packing of documents into sequences of a fixed length by a configuration linear program.

Only the histogram of piece lengths (one number per length, at most ``capacity`` of them) reaches the driver.
The configuration program asks for the fewest sequences, each filled by some multiset of lengths, that hold all
pieces. Multiplicative weights solve it in rounds: a knapsack dynamic program prices all configurations under the
present weights and yields, for every length, the best configuration around it; configurations are taken from the
best on, as often as this round's allowance of every length permits, so that no length is covered more than its
share of a round; what has been covered loses weight. Steps are whole numbers, which rounds the program on the way;
what is left at the end is put by best fit into the gaps of the chosen configurations, then into new sequences.

The resulting plan says, for the pieces of each length in some order, which sequence and place the r-th one gets.
Its size depends on ``capacity`` and ``rounds`` alone. The order comes from counting within buckets: a length with a
third of all pieces is counted in many buckets, and offsets between buckets come from their counts.

Defined cases: a null text is an empty document of one token, the separator; longer documents than the capacity are
cut, only the last piece may be shorter; repeated rows are packed once each; an empty table gives an empty table;
null identifiers are kept; other columns pass through, those called like a result or a helper as ``own_<name>``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.llm.bpe import LIBRARY_WORDS, library_word_ids, vocabulary_path
from tabloom.llm.common import put_aside, slices, stored

CAPACITY = 4096
_NAMES = (
    "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "length_", "buckets_", "bucket_", "rank_", "start_", "n_",
)
#: A bucket of pieces of one length holds about this many of them, or this share of all pieces if that is more.
BUCKET_ROWS, BUCKET_SHARE = 500, 1 / 10_000


def pieces(
    df: DataFrame, text: str = "text", capacity: int = CAPACITY, separator: int = 1, path: str | None = None, ids: bool = True,
    words: int = LIBRARY_WORDS,
) -> DataFrame:
    """One row per piece: the other columns of ``df``, piece, start, length, ids_crc32 and, if asked for, ids.

    A Python worker keeps the ids of up to twice ``words`` words, also after its task; more of them save time.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    df = put_aside(df, ("piece", "start", "length", "ids_crc32", "ids"), (text,))
    kept = [c for c in df.columns if c != text]
    added = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    added += [("ids", T.ArrayType(T.IntegerType()))] if ids else []
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in added]])
    end = np.array([separator], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = library_word_ids(path, words)
        for batch in slices(batches, text, 2_000_000):
            rows, numbers, parts = [], [], []
            for row, value in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                whole = memory.of(value) + end
                for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    rows.append(row)
                    numbers.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if ids:
                        parts.append(np.frombuffer(part, np.int32))
            taken = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in kept]
            columns = [pa.array(c, t) for c, t in zip(zip(*numbers), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            more = [pa.array(parts, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([*taken, *columns, *more], names=schema.names)

    return df.select(*kept, text).mapInArrow(run, schema)


# --- the configuration program: driver work on the histogram alone ----------------------------------------------------


@dataclass
class Lot:
    """``count`` sequences filled alike: lengths (in order) and how often each occurs."""

    items: tuple[tuple[int, int], ...]
    count: int

    @property
    def filled(self) -> int:
        return sum(length * times for length, times in self.items)


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every capacity 0..capacity, and the length to take first (0: none)."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    for room in range(1, capacity + 1):
        n = np.searchsorted(lengths, room, side="right")
        if not n:
            continue
        total = worth[:n] + best[room - lengths[:n]]
        i = int(total.argmax())
        best[room], first[room] = total[i], lengths[i]
    return best, first


def configurations(values: np.ndarray, capacity: int, active: np.ndarray) -> tuple[np.ndarray, list[dict[int, int]]]:
    """For every active length the best configuration that holds it, from the highest value on."""
    best, first = knapsack(values, capacity)
    worth = values[active] + best[capacity - active]
    order = np.argsort(-worth, kind="stable")
    found = []
    for length in active[order].tolist():
        chosen, room = {length: 1}, capacity - length
        while room and first[room]:
            take = int(first[room])
            chosen[take] = chosen.get(take, 0) + 1
            room -= take
        found.append(chosen)
    return worth[order], found


def solve(histogram: np.ndarray, capacity: int, rounds: int = 24) -> list[Lot]:
    """Lots that hold exactly ``histogram[length]`` pieces of every length.

    Fewer, larger rounds round less finely; where many rounds miss the bound that the sum of lengths sets, they are
    tried as well, and the fewest sequences count.
    """
    bound = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    best = None
    for number in dict.fromkeys((rounds, 1, max(1, rounds // 6))):
        lots = weighted_rounds(histogram, capacity, number)
        used = sum(lot.count for lot in lots)
        if best is None or used < best[0]:
            best = (used, lots)
        if used <= bound:
            break
    return best[1]


def weighted_rounds(histogram: np.ndarray, capacity: int, rounds: int, rate: float = 0.5) -> list[Lot]:
    """Multiplicative weights in ``rounds`` rounds, and best fit for what is left."""
    left = histogram.astype(np.int64).copy()
    lots = []
    if left[capacity]:
        lots.append(Lot(((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    demand = left.copy()
    weight = np.arange(capacity + 1) / capacity
    allowed = np.zeros(capacity + 1)
    for number in range(rounds):
        active = np.flatnonzero(left)
        if not active.size:
            break
        allowed += demand / rounds
        whole = np.minimum(np.floor(allowed + 1e-9), left).astype(np.int64) if number + 1 < rounds else left.copy()
        usable = np.flatnonzero(whole)
        if not usable.size:
            continue
        before = left.copy()
        # Lengths without allowance cannot be used in this round and are priced at nothing.
        priced = np.zeros_like(weight)
        priced[usable] = weight[usable]
        for chosen in configurations(priced, capacity, usable)[1]:
            times = min(int(whole[length]) // n for length, n in chosen.items())
            if times <= 0 or sum(length * n for length, n in chosen.items()) < capacity - capacity // 256:
                continue
            for length, n in chosen.items():
                whole[length] -= n * times
                left[length] -= n * times
                allowed[length] -= n * times
            lots.append(Lot(tuple(sorted(chosen.items(), reverse=True)), times))
        covered = np.divide(before - left, np.maximum(demand / rounds, 1e-9))
        weight = weight * np.exp(-rate * np.minimum(covered, 1.0) / rounds)
        weight[demand > 0] *= 1 + rate / rounds * (left[demand > 0] / np.maximum(demand[demand > 0], 1))
    return best_fit(lots, left, capacity)


def best_fit(lots: list[Lot], left: np.ndarray, capacity: int) -> list[Lot]:
    """The remaining pieces, longest first, each into the smallest gap that holds it; lots split as needed."""
    full, by_gap = [], {}
    for lot in lots:
        gap = capacity - lot.filled
        by_gap.setdefault(gap, []).append(lot) if gap else full.append(lot)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g, own in by_gap.items() if g >= length and own), default=None)
            if gap is None:
                each = capacity // length
                for times, count in ((each, n // each), (n % each, 1)):
                    if times and count:
                        room = capacity - times * length
                        (by_gap.setdefault(room, []) if room else full).append(Lot(((length, times),), count))
                n = 0
                continue
            lot = by_gap[gap].pop()
            used = min(n, lot.count)
            if used < lot.count:
                by_gap[gap].append(Lot(lot.items, lot.count - used))
            items = dict(lot.items)
            items[length] = items.get(length, 0) + 1
            room = gap - length
            (by_gap.setdefault(room, []) if room else full).append(Lot(tuple(items.items()), used))
            n -= used
    return full + [lot for own in by_gap.values() for lot in own]


@dataclass
class Plan:
    """Runs of pieces: the pieces numbered ``begin`` and on (over all lengths) fill ``times`` places of each sequence."""

    base: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = self.base[length] + rank
        run = np.searchsorted(self.begin, number, side="right") - 1
        within = number - self.begin[run]
        times = self.times[run]
        return self.sequence[run] + within // times, self.offset[run] + within % times * length


def plan_of(lots: list[Lot], histogram: np.ndarray) -> Plan:
    base = np.concatenate([[0], np.cumsum(histogram)])[:-1].astype(np.int64)
    used, rows, sequence = base.copy(), [], 0
    for lot in lots:
        offset = 0
        for length, times in lot.items:
            rows.append((used[length], length, times, sequence, offset))
            used[length] += times * lot.count
            offset += times * length
        sequence += lot.count
    if not np.array_equal(used, base + histogram):
        raise AssertionError("the plan does not hold every piece once")
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(base, *columns)


def packed(rows: DataFrame, length: str = "length", order: tuple[str, ...] = (), capacity: int = CAPACITY, rounds: int = 24) -> DataFrame:
    """``rows`` (a stored table of pieces) with ``sequence_id`` and ``offset``. ``order`` makes reruns equal."""
    counted = rows.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted.collect():  # at most one row per length up to the capacity
        if row.length is None or not 1 <= row.length <= capacity:
            raise ValueError(f"piece length {row.length} is not between 1 and {capacity}")
        histogram[row.length] = row.n
    plan = plan_of(solve(histogram, capacity, rounds), histogram)
    spark = rows.sparkSession
    size = max(BUCKET_ROWS, int(np.ceil(histogram.sum() * BUCKET_SHARE)))
    buckets = spark.createDataFrame(
        [(int(i), int(-(-histogram[i] // size))) for i in np.flatnonzero(histogram)], "length_ long, buckets_ int"
    )
    keys = [c for c in order if c in rows.columns]
    spread = F.xxhash64(*[F.col(c) for c in keys]) if keys else F.spark_partition_id()
    placed = rows.join(F.broadcast(buckets), rows[length] == buckets["length_"])
    placed = placed.withColumn("bucket_", F.pmod(spread, F.col("buckets_")).cast("int"))
    if not keys:
        placed = stored(placed, "buckets")
    counts = placed.groupBy("length_", "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("length_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length_", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    # One row per length and bucket: at most 1 / BUCKET_SHARE of them and one per length beside.
    inside = Window.partitionBy("length_", "bucket_").orderBy(*[F.col(c) for c in keys] or [F.lit(0)])
    ranked = placed.withColumn("rank_", F.row_number().over(inside) - 1)
    ranked = ranked.join(F.broadcast(starts), ["length_", "bucket_"]).withColumn("rank_", (F.col("rank_") + F.col("start_")).cast("bigint"))
    ranked = ranked.drop("bucket_", "buckets_", "start_")
    shared, names = spark.sparkContext.broadcast(plan), rows.columns
    fields = [*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length_")).to_numpy()
            ranks = batch.column(batch.schema.get_field_index("rank_")).to_numpy()
            sequence, offset = own.places(lengths, ranks)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def packed_documents(
    df: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, words: int = LIBRARY_WORDS
) -> DataFrame:
    """Documents cut, and their pieces packed: the columns beside the text, and those of ``pieces`` and ``packed``."""
    df = put_aside(df, _NAMES, ("text",))
    rows = stored(pieces(df, "text", capacity, ids=keep_ids, words=words), "pieces")
    order = tuple(c for c in ("doc_id", "piece", "ids_crc32", "start") if c in rows.columns)
    return packed(rows, order=order, capacity=capacity)
