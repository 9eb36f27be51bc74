"""Near duplicates by SimHash fingerprints, searched with a generalised pigeonhole.

Two fingerprints that differ in at most ``k`` bits agree, in some partition i of the bits, up to a threshold
t_i, whenever the thresholds satisfy sum(t_i + 1) = k + 1 (t_i = -1 leaves a partition out). Bits that go
together over the corpus are put into the same partition, so that the partitions are as independent as the
data allows. Every fingerprint chooses its own thresholds: a dynamic program over the partitions weighs the
keys that a threshold makes it probe against the candidates it must expect there, estimated from counts of
short bit groups over all fingerprints. Index keys and probes meet in a join that also verifies the distance.

A key shared by more than ``key_limit`` fingerprints is not paired. All fingerprints that lie on it or probe
it are linked in another exact way: each writes itself and its 64 one-bit neighbours as keys, two fingerprints
share such a key exactly if they differ in two bits or fewer, and each is linked with the smallest one of the
key. The work is 65 keys a fingerprint however many meet (for k = 2; for k = 1 that link is verified).

Components come from alternating large-star and small-star rounds over the links; each round is a stored table.

Defined cases: a null text has no words; a text without words has fingerprint 0 and is linked like any other;
shorter texts than the shingle give one shingle; null identifiers never become a component's name unless a
component has no other; repeated rows share a component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import BLANK_CHARS, UPPER, free_name, put_aside, shield, slices, stored

SEED = 42
BITS = 64
_LOWER = str.maketrans(UPPER, UPPER.lower())
_BLANKS = str.maketrans({c: " " for c in BLANK_CHARS})
#: Bit groups of this width are counted over all fingerprints.
PIECE = 8


@dataclass(frozen=True)
class Search:
    k: int = 2
    #: Keys with more fingerprints than this are linked through one-bit neighbours instead of pairs.
    key_limit: int = 64
    #: Cost of one probe against one candidate.
    probe_cost: float = 1.0
    candidate_cost: float = 1.0


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    import xxhash

    found = (text or "").translate(_LOWER).translate(_BLANKS).split(" ")
    tokens = [w.encode("utf-8", "surrogatepass") for w in found if w]
    if not tokens:
        return 0
    if len(tokens) < size:
        size = len(tokens)
    whole = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(tokens) - size + 1].tolist()
    stops = (ends - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", size: int = 3) -> DataFrame:
    """``df`` with the fingerprint of each text as a bigint."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            place = batch.schema.get_field_index(text)
            prints = [fingerprint_of(x.as_py(), size) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


# --- statistics over all fingerprints: bounded tables -------------------------------------------------------------


def _bits_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    numbers = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unpackbits(numbers.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """How often each two bits are both set: 64 x 64 numbers, summed over all tasks."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.float64)
        for batch in batches:
            bits = _bits_of(batch, "fp").astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS), pa.int64()), pa.array(total.ravel().astype(np.int64))], names=["at", "n"]
        )

    rows = prints.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for row in rows:
        both[row.at] = row.n
    return both.reshape(BITS, BITS)


def correlated_partitions(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits 0-63 in ``m`` partitions of like width, each grown around the bit with the strongest ties left."""
    rate = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    ties = np.abs(both / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(ties, 0)
    left, out = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        order = sorted(left)
        members = [max(order, key=lambda b: (ties[b, order].sum(), -b))]
        left.discard(members[0])
        while len(members) < width:
            best = max(sorted(left), key=lambda b: (ties[b, members].sum(), -b))
            members.append(best)
            left.discard(best)
        out.append(members)
    return out


def _values(bits: np.ndarray, chosen: list[int]) -> np.ndarray:
    """The chosen bits of each row as one number."""
    value = np.zeros(len(bits), np.int64)
    for place, bit in enumerate(chosen):
        value |= bits[:, bit].astype(np.int64) << place
    return value


def piece_counts(prints: DataFrame, pieces: list[list[int]]) -> np.ndarray:
    """For each bit group, how many fingerprints have each of its values."""

    def run(batches):
        total = np.zeros((len(pieces), 1 << PIECE), np.int64)
        for batch in batches:
            bits = _bits_of(batch, "fp")
            for i, piece in enumerate(pieces):
                total[i] += np.bincount(_values(bits, piece), minlength=1 << PIECE)
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used])], names=["at", "n"])

    rows = prints.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(pieces) << PIECE)
    for row in rows:
        out[row.at] = row.n
    return out.reshape(len(pieces), 1 << PIECE)


@dataclass
class Plan:
    """Partitions, their pieces, and per piece value the share of fingerprints at distance 0, 1, ... k."""

    partitions: list[list[int]]
    pieces: list[list[list[int]]]
    shares: list[list[np.ndarray]]
    n: int
    search: Search

    def signatures(self, i: int, t: int) -> int:
        width, total, ways = len(self.partitions[i]), 0, 1
        for d in range(t + 1):
            total += ways
            ways = ways * (width - d) // (d + 1)
        return total

    def candidates(self, bits: np.ndarray, i: int) -> np.ndarray:
        """Expected candidates of each row in partition i at thresholds 0..k."""
        k = self.search.k
        near = np.zeros((len(bits), k + 1))
        near[:, 0] = 1
        for piece, share in zip(self.pieces[i], self.shares[i], strict=True):
            own = share[_values(bits, piece)]
            mixed = np.zeros_like(near)
            for a in range(k + 1):
                for b in range(k + 1 - a):
                    mixed[:, a + b] += near[:, a] * own[:, b]
            near = mixed
        return self.n * np.cumsum(near, axis=1)

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the thresholds with the least expected cost, and that cost: a DP over partitions."""
        need, m = self.search.k + 1, len(self.partitions)
        best = np.full((len(bits), need + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((m, len(bits), need + 1), np.int64)
        for i in range(m):
            expected = self.candidates(bits, i)
            after = np.full_like(best, np.inf)
            for spent in range(need + 1):  # spent = t + 1
                cost = 0.0
                if spent:
                    cost = self.search.probe_cost * self.signatures(i, spent - 1)
                    cost = cost + self.search.candidate_cost * expected[:, spent - 1]
                for before in range(need + 1 - spent):
                    total = best[:, before] + cost
                    better = total < after[:, before + spent]
                    after[:, before + spent] = np.where(better, total, after[:, before + spent])
                    choice[i, :, before + spent] = np.where(better, spent, choice[i, :, before + spent])
            best = after
        out = np.zeros((len(bits), m), np.int64)
        at = np.full(len(bits), need)
        for i in reversed(range(m)):
            out[:, i] = choice[i, np.arange(len(bits)), at]
            at = at - out[:, i]
        return out - 1, best[:, need]


def _distance_shares(counts: np.ndarray, k: int) -> np.ndarray:
    numbers = np.arange(1 << PIECE)
    apart = np.bitwise_count(numbers[:, None] ^ numbers[None, :])
    share = counts / max(counts.sum(), 1)
    return np.stack([(apart == d) @ share for d in range(k + 1)], axis=1)


def plan_search(prints: DataFrame, search: Search) -> Plan | None:
    """The partitioning with the least expected cost over all fingerprints, or None for no fingerprints."""
    both = bit_counts(prints)
    n = prints.count()
    if not n:
        return None
    options = []
    for m in range(search.k, search.k + 3):
        partitions = correlated_partitions(both, n, m)
        options.append((partitions, [[p[i : i + PIECE] for i in range(0, len(p), PIECE)] for p in partitions]))
    flat = [piece for _, pieces in options for own in pieces for piece in own]
    counts = iter(piece_counts(prints, flat))
    best = None
    for partitions, pieces in options:
        shares = [[_distance_shares(next(counts), search.k) for _ in own] for own in pieces]
        plan = Plan(partitions, pieces, shares, n, search)
        typical = np.random.default_rng(0).random((4096, BITS)) < np.diag(both) / n
        cost = plan.thresholds(typical.astype(np.uint8))[1].mean()
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


# --- probing --------------------------------------------------------------------------------------------------------


def keyed(prints: DataFrame, plan: Plan) -> DataFrame:
    """(key, fp, probe): one index row per partition and fingerprint, and the probes that its thresholds ask for."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                fps = part.column(part.schema.get_field_index("fp")).to_numpy(zero_copy_only=False).astype(np.int64)
                bits = _bits_of(part, "fp")
                limits, _ = plan.thresholds(bits)
                for i, members in enumerate(plan.partitions):
                    value = _values(bits, members)
                    tag = np.int64(i) << 58
                    yield _keys(value | tag, fps, False)
                    for t in range(plan.search.k + 1):
                        rows = limits[:, i] >= t
                        for flips in combinations(range(len(members)), t) if rows.any() else ():
                            mask = np.int64(sum(1 << f for f in flips))
                            yield _keys((value[rows] ^ mask) | tag, fps[rows], True)

    return prints.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def _keys(keys, fps, probe: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(np.full(len(fps), probe))], names=["key", "fp", "probe"]
    )


def links(prints: DataFrame, search: Search = Search()) -> DataFrame:
    """Links (a, b), a < b, that connect exactly the fingerprints reachable over ``k`` or fewer differing bits."""
    if not 1 <= search.k <= 2:
        raise ValueError("k is 1 or 2: the exact way for crowded keys is built for it")
    spark = prints.sparkSession
    plan = plan_search(prints, search)
    if plan is None:
        return spark.createDataFrame([], "a long, b long")
    keys = keyed(prints, plan)
    crowded = keys.filter(~F.col("probe")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(crowded.filter(F.col("n") > search.key_limit).select("key"), "crowded")
    any_crowded = not crowded.isEmpty()
    index = keys.filter(~F.col("probe")).select("key", F.col("fp").alias("b"))
    probes = keys.filter("probe").select("key", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= search.k
    if any_crowded:
        index = index.join(crowded, "key", "left_anti")
        probes = probes.join(crowded, "key", "left_anti")
    pairs = probes.join(index, "key").filter((F.col("a") != F.col("b")) & near)
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if any_crowded:
        meeting = keys.join(crowded, "key", "left_semi").select("fp").distinct()
        found = found.unionByName(neighbour_links(stored(meeting, "meeting"), search.k))
    return found.distinct()


def neighbour_links(prints: DataFrame, k: int) -> DataFrame:
    """Links through shared one-bit neighbours: 65 keys a fingerprint, no pairs."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("bigint") for b in range(BITS)])
    keys = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    if k == 1:
        # Two fingerprints one bit apart: each is a key of the other, so the key itself is the partner.
        return keys.join(prints.select(F.col("fp").alias("key")), "key", "left_semi").filter("fp <> key").select(
            F.least("fp", "key").alias("a"), F.greatest("fp", "key").alias("b")
        )
    first = keys.groupBy("key").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(first, "key").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable."""
    edges = stored(edges, "edges")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("low"))
        moved = down.join(lowest, "a").select("b", "low").filter("b <> low").select(F.col("low").alias("a"), "b")
        stars = lowest.select(F.col("low").alias("a"), F.col("a").alias("b"))
        edges = stored(moved.unionByName(stars).distinct(), "edges")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == (row.n, row.x):
            break
        state = (row.n, row.x)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def with_components(
    rows: DataFrame, id_col: str = "doc_id", fingerprint: str = "fingerprint", search: Search = Search(),
    edges: DataFrame | None = None,
) -> DataFrame:
    """``rows`` (a stored table with fingerprints) with ``component_id``, the smallest identifier reachable.

    ``edges`` are links (a, b) between fingerprints found in another way than by ``search``. Columns called like a
    result or a helper come back as ``own_<name>``.
    """
    rows = put_aside(rows, ("component_id", "component_root", "fp_", "root_", "name_"), (id_col, fingerprint))
    groups = rows.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "fingerprints")
    labels = components(links(groups, search) if edges is None else edges)
    linked = stored(groups.join(labels, groups["fp"] == labels["node"]).select("fp", "root", "first_id"), "linked")
    names = linked.groupBy("root").agg(F.min("first_id").alias("name"))
    named = linked.join(names, "root").select("fp", "root", "name")
    copies = groups.filter("n > 1").join(linked.select("fp"), "fp", "left_anti")
    named = named.unionByName(copies.select("fp", F.col("fp").alias("root"), F.col("first_id").alias("name")))
    named = named.withColumnsRenamed({"fp": "fp_", "root": "root_", "name": "name_"})
    joined = rows.join(named, rows[fingerprint] == named["fp_"], "left")
    name = F.when(F.col("root_").isNotNull(), F.col("name_")).otherwise(rows[id_col])
    root = F.coalesce(F.col("root_"), rows[fingerprint])
    return joined.withColumns({"component_id": name, "component_root": root}).drop("fp_", "root_", "name_")


def survivors(df: DataFrame, id_col: str = "doc_id", text: str = "text", search: Search = Search()) -> DataFrame:
    """One document of each component, the one with the smallest identifier, with the columns of ``df``."""
    plain, back = shield(df, ("fingerprint", "component_id", "component_root", "fp_", "root_", "name_"))
    rows = stored(with_fingerprints(plain, text), "fingerprinted")
    return one_each(with_components(rows, id_col, search=search), rows, plain.columns, id_col).withColumnsRenamed(back)


def one_each(named: DataFrame, rows: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """``columns`` of one row a component. ``named`` is ``rows`` as ``with_components`` returns them."""
    found = named.filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    repeated = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = stored(repeated.select(id_col), "repeated")
    if repeated.isEmpty():
        return found.select(*columns)
    # The identifier that stays may name several rows of a component; only such rows pay for one more step.
    key, mark = free_name(found, "repeated_id"), free_name(found, "repeated_mark")
    repeated = repeated.select(F.col(id_col).alias(key), F.lit(True).alias(mark))
    found = stored(found.join(repeated, found[id_col].eqNullSafe(repeated[key]), "left").drop(key), "survivors")
    once = found.filter(F.col(mark).isNull())
    single = found.filter(F.col(mark)).dropDuplicates([id_col, "component_root"])
    return once.unionByName(single).select(*columns)
