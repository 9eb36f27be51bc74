"""Importance resampling towards a target distribution, with exact integer weights from bit planes.

Features are all runs of one to ``longest`` consecutive words of a lower-cased text, repeats counted; a feature's
bucket is the CRC-32 of its bytes modulo ``buckets``. A bucket gains floor(1000 ln(target share / corpus share)),
both shares smoothed by one. A document's weight is the sum of the gains over its features.

The weight is a product of a count vector and a gain vector, worked out bit by bit: the bucket counts of a document
become planes of ``buckets`` bits (plane k holds bit k of every count), the gains become planes of their positive and
of their negative bits, and weight = sum over planes (k, j) of +-2^(k+j) * popcount(count plane k AND gain plane j).
Only whole numbers are added, so weights do not depend on the order of features, batches or tasks.

CRC-32 of a run comes from those of its words: crc(a || b) = crc(a) moved over the length of b, XOR crc(b); moving is
linear over bits, four table reads for short lengths and one set of reads per bit of a long length.

Per document only counts and the weight leave a task; the corpus contributes one count per bucket and task. The draw
orders all documents by range partitions, never in one task.

Defined cases: null and empty texts have no words, no features and weight 0; a null key counts as an empty one in the
random part; repeated rows are rows of their own, with equal weights and scores and ranks in any order among
themselves; an empty corpus gives an empty table, an empty target a gain from its smoothed zero counts. A text of any
length is hashed in pieces and counted in pieces. A column of the input called like a result or a helper column comes
back as ``own_<name>``; with `resampled`, which adds no columns, all come back as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col
from tabloom.llm.common import shield, slices, stored
from tabloom.operators.ordered import number_rows

#: Bytes hashed at once, words whose runs are formed at once, documents whose planes are formed at once.
PIECE_BYTES = 2_000_000
PIECE_WORDS = 300_000
PLANE_ROWS = 64
#: Lengths up to this have a table of their own.
SHORT = 64
_RESULTS = ("n_words", "n_features", "weight", "score", "rank")
_HELPERS = ("order_tier_", "order_score_", "order_place_", "_part", "_pos", "_start")


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    longest: int = 3
    percent: int = 5
    least_words: int = 20
    seed: int = 42


@lru_cache(maxsize=1)
def _step_table() -> np.ndarray:
    """CRC-32 of one byte step, from the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _moved(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map of a 4 x 256 table applied to 32-bit numbers."""
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


@lru_cache(maxsize=1)
def _move_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that move a CRC over 0..SHORT bytes, and over 2^i bytes for every i below 40."""
    step = _step_table()
    short = np.empty((SHORT + 1, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT + 1):
        short[n] = (short[n - 1] >> 8) ^ step[short[n - 1] & 255]
    powers = [short[1]]
    for _ in range(39):
        powers.append(_moved(powers[-1], powers[-1]))
    return short, powers


def moved(c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved over ``lengths`` bytes each."""
    short, powers = _move_tables()
    flat = short.reshape(-1)
    at = np.minimum(lengths, SHORT).astype(np.int64) * 1024
    out = flat[at + (c & 255)]
    out ^= flat[at + 256 + ((c >> 8) & 255)]
    out ^= flat[at + 512 + ((c >> 16) & 255)]
    out ^= flat[at + 768 + (c >> 24)]
    far = np.flatnonzero(lengths > SHORT)
    if len(far):
        rest, value = lengths[far] - SHORT, out[far]
        for i, table in enumerate(powers):
            bit = (rest >> i) & 1 == 1
            if bit.any():
                value[bit] = _moved(table, value[bit])
        out[far] = value
    return out


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, and which lower-cased bytes belong to words."""
    fold = np.arange(256, dtype=np.uint8)
    fold[0x41:0x5B] += 0x20
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    return fold, inside


def _pieces(raw: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Lower-cased parts of the bytes, cut only between words, with their places."""
    fold, inside = _letters()
    start = 0
    while start < len(raw):
        size = limit
        while True:
            part = fold[raw[start : start + size]]
            if start + size >= len(raw):
                break
            gaps = np.flatnonzero(~inside[part])
            if len(gaps):
                part = part[: gaps[-1] + 1]
                break
            size *= 2
        yield start, part
        start += len(part)


def word_codes(texts: Sequence[bytes], limit: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, CRC-32, byte length) of every word, in order."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    step, (_, inside) = _step_table(), _letters()
    found = []
    for place, part in _pieces(raw, limit):
        edge = np.diff(np.concatenate(([0], inside[part].view(np.int8), [0])).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = stops - starts
        order = np.argsort(-lengths, kind="stable")
        at, sizes = starts[order], lengths[order]
        c = np.full(len(at), 0xFFFFFFFF, np.uint32)
        long = int(np.searchsorted(-sizes, -SHORT, "left"))
        # Sorted by length, the words that still have a byte are always the first ones.
        active = len(at)
        for p in range(min(SHORT, int(sizes[0]) if len(sizes) else 0)):
            active = int(np.searchsorted(-sizes[:active], -p, "left"))
            head = c[:active]
            c[:active] = step[(head ^ part[at[:active] + p]) & 255] ^ (head >> 8)
        for i in range(long):
            value = int(c[i])
            c[i] = _crc_rest(part[at[i] + SHORT : at[i] + sizes[i]], value)
        crc = np.empty(len(at), np.uint32)
        crc[order] = c ^ np.uint32(0xFFFFFFFF)
        found.append((np.searchsorted(ends, starts + place, "right"), crc, lengths))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _crc_rest(part: np.ndarray, state: int) -> int:
    """The running CRC carried over more bytes."""
    import zlib

    return zlib.crc32(part.tobytes(), state ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def runs(
    owner: np.ndarray, crc: np.ndarray, size: np.ndarray, longest: int, limit: int = PIECE_WORDS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, CRC-32) of every run of 1 to ``longest`` words of one owner, words joined by a blank."""
    import zlib

    n = len(crc)
    for start in range(0, n, limit):
        last = min(start + limit, n)
        until = min(last + longest - 1, n)
        who, code, length = owner[start:until], crc[start:until], size[start:until]
        blank = moved(np.full(len(code), zlib.crc32(b" "), np.uint32), length) ^ code
        run, count = code[: last - start], last - start
        yield who[:count], run
        for k in range(1, longest):
            count = min(count, len(code) - k)
            if count <= 0:
                break
            run = moved(run[:count], length[k : k + count] + 1) ^ blank[k : k + count]
            same = who[:count] == who[k : k + count]
            yield who[:count][same], run[same]


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    column = batch.column(at).cast(pa.large_binary())
    return [b"" if v is None else v for v in column.to_pylist()]


def bucket_counts(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> np.ndarray:
    """How many features of all rows fall into each bucket; one number per bucket reaches the driver."""
    buckets, longest = settings.buckets, settings.longest

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(iter([batch]), "text_"):
                for _, codes in runs(*word_codes(_texts(part, 0)), longest):
                    total += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    rows = df.select(col(text).cast("string").alias("text_")).mapInArrow(count, "bucket int, n bigint")
    found = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket, B buckets, in doubles."""
    size = float(len(corpus))
    s_all, t_all = float(corpus.sum()) + size, float(target.sum()) + size
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs]


@dataclass(frozen=True)
class GainPlanes:
    """The gains as planes of bits: (exponent, sign, packed bits) each."""

    width: int
    planes: tuple[tuple[int, int, np.ndarray], ...]

    @classmethod
    def of(cls, values: Sequence[int]) -> GainPlanes:
        width = -(-len(values) // 64) * 64
        g = np.zeros(width, np.int64)
        g[: len(values)] = values
        planes = []
        for sign in (1, -1):
            part = np.maximum(sign * g, 0)
            for j in range(int(part.max(initial=0)).bit_length()):
                bits = (part >> j) & 1
                if bits.any():
                    planes.append((j, sign, np.packbits(bits.astype(bool)).view(np.uint64)))
        return cls(width, tuple(planes))

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Exact sums of count x gain per row of a (rows, width) table of counts."""
        rows = len(counts)
        total = np.zeros(rows, np.int64)
        places = np.flatnonzero(counts.reshape(-1))
        values = counts.reshape(-1)[places]
        for k in range(int(values.max(initial=0)).bit_length()):
            hit = places[(values >> k) & 1 == 1]
            if not len(hit):
                continue
            here, row = np.unique(hit // self.width, return_inverse=True)
            flags = np.zeros((len(here), self.width), bool)
            flags.reshape(-1)[row * self.width + hit % self.width] = True
            plane = np.packbits(flags, axis=1).view(np.uint64)
            for j, sign, bits in self.planes:
                found = np.bitwise_count(plane & bits).sum(axis=1, dtype=np.int64)
                total[here] += sign * (found << (k + j))
        return total


def _measured(texts: list[bytes], planes: GainPlanes, settings: Settings) -> tuple[np.ndarray, ...]:
    """(words, features, weight) per text."""
    owner, crc, size = word_codes(texts)
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for start in range(0, n, PLANE_ROWS):
        stop = min(start + PLANE_ROWS, n)
        a, b = np.searchsorted(owner, [start, stop])
        counts = np.zeros((stop - start) * planes.width, np.int64)
        for who, codes in runs(owner[a:b] - start, crc[a:b], size[a:b], settings.longest):
            counts += np.bincount(who * planes.width + codes % np.uint32(settings.buckets), minlength=len(counts))
        table = counts.reshape(stop - start, planes.width)
        features[start:stop] = table.sum(axis=1)
        weight[start:stop] = planes.weights(table)
    return words, features, weight


def weighed(
    df: DataFrame, gain: Sequence[int], text: str = "text", settings: Settings = Settings(), carry_text: bool = True
) -> DataFrame:
    """``df`` with n_words, n_features and weight (all bigint); without its text where ``carry_text`` is false."""
    planes = GainPlanes.of(gain)
    plain, back = shield(df, (*_RESULTS, *_HELPERS))
    text = next((new for new, old in back.items() if old == text), text)
    kept = [f for f in plain.schema.fields if carry_text or f.name != text]
    at, chosen = plain.columns.index(text), [plain.columns.index(f.name) for f in kept]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])

    def measure(batches):
        for batch in slices(batches, text, PIECE_BYTES):
            made = _measured(_texts(batch, at), planes, settings)
            columns = [*[batch.column(i) for i in chosen], *[pa.array(m, pa.int64()) for m in made]]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(measure, schema)


def noise(key: Column, seed: int) -> Column:
    """floor of 1000 Gumbel draws' worth of a key: -1000 ln(-ln((h + 1/2) / 2^32)), h from SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(weights: DataFrame, key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Rows of `weighed` (a stored table) with score, and rank 1, 2, ... of those drawn, null for the others.

    Of the N rows with enough words the floor(percent * N / 100) highest scores are drawn, ties to the smaller key.
    """
    enough = F.coalesce(F.col("n_words") >= settings.least_words, F.lit(False))
    scored = weights.withColumn("score", F.col("weight") + noise(col(key), settings.seed))
    eligible = weights.where(enough).count()
    sortable = scored.withColumns({"order_tier_": F.when(enough, 0).otherwise(1), "order_score_": -F.col("score")})
    numbered = number_rows(sortable, ["order_tier_", "order_score_", key], "order_place_")
    taken = settings.percent * eligible // 100
    drawn = F.when((F.col("order_tier_") == 0) & (F.col("order_place_") <= taken), F.col("order_place_").cast("bigint"))
    return numbered.withColumn("rank", drawn).drop("order_tier_", "order_score_", "order_place_")


def scored(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    settings: Settings = Settings(), carry_text: bool = False,
) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank; the texts stay behind unless carried."""
    gain = gains(bucket_counts(docs, text, settings), bucket_counts(target, target_text, settings))
    return ranked(stored(weighed(docs, gain, text, settings, carry_text), "weighed"), key, settings)


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """The drawn documents with the columns of ``docs``."""
    plain, back = shield(docs, tuple(n for n in (*_RESULTS, *_HELPERS) if n not in (key.lower(), text.lower())))
    found = scored(plain, target, key, text, target_text, settings, True).where(F.col("rank").isNotNull())
    return found.select(*[col(c) for c in plain.columns]).withColumnsRenamed(back)
