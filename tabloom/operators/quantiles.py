"""Exact quantiles and order statistics of columns of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. Here
a group is first measured: within ``limit`` values the built-in is used. Beyond it a sketch
gives a bracket that must hold the wanted rank, the values outside are only counted, and the
bracket is narrowed again until it is small. The answer is exact either way.

Quantiles of several columns are read off digit by digit: the bits of a double, put so that they order as the value does,
are a number, and every pass counts the next digit of the values that agree with a wanted one so far. The passes are as
many as there are digits, whatever the number of rows, columns and ranks, and no sketch is made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col

DIRECT_LIMIT = 1_000_000
_ACCURACY = 10_000
#: Bits of the digits that doubles are read by, the brackets of one pass (each a count per digit), rows counted at once.
_DIGITS, _MOST_BRACKETS, _COUNTED_ROWS = (12, 13, 13, 13, 13), 400, 65_536


def order_statistics(
    df: DataFrame, value: Column, ranks: Sequence[int], limit: int = DIRECT_LIMIT
) -> list:
    """The values at the given 0-based ranks of the ascending, non-null values.

    ``value`` is numeric, date or timestamp. Each pass is one aggregate over the rows that
    are still inside some bracket; no row is moved.
    """
    found = order_statistics_of(df.select(value.alias("v")), {"v": ranks}, limit)["v"]
    return [found[r] for r in ranks]


def order_statistics_of(frame: DataFrame, wanted: dict[str, Sequence[int]], limit: int = DIRECT_LIMIT) -> dict[str, dict]:
    """The same for several columns of one type: name -> rank -> value.

    All brackets of all columns are measured, narrowed and read together, so a round is four jobs however many
    columns and ranks there are, and the rounds are those of the slowest column.
    """
    found: dict[str, dict[int, object]] = {name: {} for name in wanted}
    # (column, rank) -> (low, high, values below low); None means unbounded.
    open_ranks = {(c, r): (None, None, 0) for c, ranks in wanted.items() for r in sorted(set(ranks))}
    while open_ranks:
        brackets = list(dict.fromkeys((c, b) for (c, _), b in open_ranks.items()))
        measured = _measure(frame, brackets)
        split: dict[tuple, tuple] = {}
        small: dict[tuple, list[int]] = {}
        for (c, rank), bracket in open_ranks.items():
            inside, low, high = measured[c, bracket]
            if low == high:
                found[c][rank] = low
            elif inside <= limit:
                small.setdefault((c, bracket), []).append(rank)
            else:
                split[c, rank] = (bracket, inside)
        if small:
            for c, rank, value in _pick(frame, small):
                found[c][rank] = value
        open_ranks = _narrow(frame, split) if split else {}
    return found


def _inside(column: str, bracket) -> Column:
    low, high, _ = bracket
    test = col(column).isNotNull()
    if low is not None:
        test = test & (col(column) >= F.lit(low))
    if high is not None:
        test = test & (col(column) <= F.lit(high))
    return test


def _measure(frame: DataFrame, brackets: list) -> dict:
    aggs = []
    for i, (c, b) in enumerate(brackets):
        v = F.when(_inside(c, b), col(c))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = frame.agg(*aggs).first()
    return {key: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, key in enumerate(brackets)}


def _pick(frame: DataFrame, small: dict[tuple, list[int]]) -> list[tuple]:
    """(column, rank, value) read off brackets of at most `limit` values; only the answers reach the driver."""
    keys = list(small)
    cells = [F.struct(F.lit(i).alias("b"), F.when(_inside(*key), col(key[0])).alias("v")) for i, key in enumerate(keys)]
    spread = frame.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
    counts = spread.groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v"))
    spans = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    # One row per bracket and rank.
    asked = frame.sparkSession.createDataFrame(
        [(i, r, r - key[1][2]) for i, key in enumerate(keys) for r in small[key]], "at int, rank bigint, place bigint"
    )
    hit = (F.col("b") == F.col("at")) & (F.col("from") <= F.col("place")) & (F.col("upto") > F.col("place"))
    rows = spans.join(F.broadcast(asked), hit).select("b", "rank", "v").collect()
    return [(keys[row["b"]][0], row["rank"], row["v"]) for row in rows]


def _narrow(frame: DataFrame, split: dict[tuple, tuple]) -> dict:
    """Smaller brackets: a sketch proposes two values around every rank, counting tells where the rank lies.

    It lies below the first, on it, between them, on the second or beyond; each of the five is a bracket without the
    values tested, so brackets shrink however many rows share a value.
    """
    aggs = []
    for i, ((c, rank), (bracket, inside)) in enumerate(split.items()):
        share = (rank - bracket[2] + 0.5) / inside
        edge = [max(0.0, share - 2 / _ACCURACY), min(1.0, share + 2 / _ACCURACY)]
        aggs.append(F.percentile_approx(F.when(_inside(c, bracket), col(c)), edge, _ACCURACY).alias(f"r{i}"))
    edges = frame.agg(*aggs).first()
    facts = []
    for i, (c, _) in enumerate(split):
        for name, value in zip("lh", edges[f"r{i}"], strict=True):
            edge = F.lit(value)
            facts += [
                F.count_if(col(c) < edge).alias(f"{name}_under{i}"), F.count_if(col(c) <= edge).alias(f"{name}_upto{i}"),
                F.max(F.when(col(c) < edge, col(c))).alias(f"{name}_before{i}"), F.min(F.when(col(c) > edge, col(c))).alias(f"{name}_after{i}"),
            ]
    row = frame.agg(*facts).first()
    narrowed = {}
    for i, (key, (bracket, _)) in enumerate(split.items()):
        (low, high), rank = edges[f"r{i}"], key[1]
        l_under, l_upto, h_under, h_upto = (row[f"{n}{i}"] for n in ("l_under", "l_upto", "h_under", "h_upto"))
        if rank < l_under:
            narrowed[key] = (bracket[0], row[f"l_before{i}"], bracket[2])
        elif rank < l_upto:
            narrowed[key] = (low, low, l_under)
        elif rank < h_under:
            narrowed[key] = (row[f"l_after{i}"], row[f"h_before{i}"], l_upto)
        elif rank < h_upto:
            narrowed[key] = (high, high, h_under)
        else:
            narrowed[key] = (row[f"h_after{i}"], bracket[1], h_upto)
    return narrowed


def quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: Sequence[float],
    limit: int = DIRECT_LIMIT,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several numeric columns."""
    frame = df.select(*[v.cast("double").alias(n) for n, v in columns.items()])
    sizes = frame.agg(*[F.count(col(n)).alias(n) for n in columns]).first()
    places = {n: [(sizes[n] - 1) * p for p in probs] for n in columns if sizes[n]}
    wanted = {n: sorted({r for h in hs for r in (math.floor(h), math.ceil(h))}) for n, hs in places.items()}
    found = _ranked({n: r for n, r in wanted.items() if sizes[n] <= limit}, frame)
    large = {n: r for n, r in wanted.items() if sizes[n] > limit}
    if large:
        found |= _by_digits(frame, large)
    answer: dict[str, list[float | None]] = {}
    for name in columns:
        if name not in places:
            answer[name] = [None] * len(probs)
            continue
        at = found[name]
        answer[name] = [
            at[math.floor(h)] + (h - math.floor(h)) * (at[math.ceil(h)] - at[math.floor(h)]) for h in places[name]
        ]
    return answer


def _as_ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order, NaN last; 0.0 and -0.0 are one."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _as_double(place: int) -> float:
    bits = place ^ (1 << 63) if place >> 63 else ~place & (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _by_digits(frame: DataFrame, wanted: dict[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """Column of doubles -> rank -> value, by one pass per digit for as many columns as fit `_MOST_BRACKETS`."""
    found: dict[str, dict[int, float]] = {}
    group: dict[str, Sequence[int]] = {}
    for name, ranks in wanted.items():
        if group and sum(map(len, group.values())) + len(ranks) > _MOST_BRACKETS:
            found |= _digits_of(frame, group)
            group = {}
        group[name] = ranks
    return found | (_digits_of(frame, group) if group else {})


def _digits_of(frame: DataFrame, wanted: dict[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    names = list(wanted)
    slim = frame.select(*[col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    # (column, rank) -> digits so far, and the values below them.
    at = {(i, r): (0, 0) for i, n in enumerate(names) for r in wanted[n]}
    used = 0
    for bits in _DIGITS:
        heads = [np.array(sorted({at[k][0] for k in at if k[0] == i}), np.uint64) for i in range(len(names))]
        counts = _digit_counts(slim, heads, used, bits)
        upto = F.sum("n").over(Window.partitionBy("c", "h").orderBy("d"))
        spans = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
        # One row per column and rank.
        rows = [(i, int(np.searchsorted(heads[i], np.uint64(head))), r, r - below) for (i, r), (head, below) in at.items()]
        asked = frame.sparkSession.createDataFrame(rows, "ac int, ah int, rank bigint, place bigint")
        hit = (F.col("c") == F.col("ac")) & (F.col("h") == F.col("ah")) & (F.col("from") <= F.col("place")) & (F.col("upto") > F.col("place"))
        for row in spans.join(F.broadcast(asked), hit).select("c", "rank", "d", "from").collect():
            head, below = at[row["c"], row["rank"]]
            at[row["c"], row["rank"]] = ((head << bits) | row["d"], below + row["from"])
        used += bits
    found: dict[str, dict[int, float]] = {n: {} for n in names}
    for (i, rank), (place, _) in at.items():
        found[names[i]][rank] = _as_double(place)
    return found


def _digit_counts(slim: DataFrame, heads: list[np.ndarray], used: int, bits: int) -> DataFrame:
    """(column, number of the head, digit, n): the values that begin with one of the column's heads, by their next digit."""
    size, columns = 1 << bits, len(heads)

    def count(batches):
        counts = [np.zeros(len(h) * size, np.int64) for h in heads]

        def add(held):
            for i in range(columns):
                places = _as_ordered(np.concatenate([b.column(i).drop_null().to_numpy() for b in held]))
                digit = ((places >> np.uint64(64 - used - bits)) & np.uint64(size - 1)).astype(np.int64)
                if used:
                    top = places >> np.uint64(64 - used)
                    number = np.searchsorted(heads[i], top)
                    number[number == len(heads[i])] = 0
                    mine = heads[i][number] == top
                    digit = (number * size + digit)[mine]
                counts[i] += np.bincount(digit, minlength=len(counts[i]))

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _COUNTED_ROWS:
                add(held)
                held, rows = [], 0
        if held:
            add(held)
        for i, total in enumerate(counts):
            some = np.flatnonzero(total)
            parts = [np.full(len(some), i, np.int32), (some // size).astype(np.int32), (some % size).astype(np.int32), total[some]]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["c", "h", "d", "n"])

    made = slim.mapInArrow(count, "c int, h int, d int, n bigint")
    return made.groupBy("c", "h", "d").agg(F.sum("n").alias("n"))


def _ranked(wanted: dict[str, list[int]], frame: DataFrame) -> dict[str, dict[int, float]]:
    """Values at ranks of columns that fit one task each: counts per distinct value, added up in
    value order. Only the values at the ranks reach the driver."""
    if not wanted:
        return {}
    index = {n: i for i, n in enumerate(wanted)}
    counts = (
        frame.select(F.posexplode(F.array(*[col(n) for n in index])).alias("c", "v"))
        .where(F.col("v").isNotNull())
        .groupBy("c", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("v"))
    spans = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    # One row per column and rank.
    asked = frame.sparkSession.createDataFrame(
        [(i, r) for n, i in index.items() for r in wanted[n]], "at int, rank bigint"
    )
    hit = (F.col("c") == F.col("at")) & (F.col("from") <= F.col("rank")) & (F.col("upto") > F.col("rank"))
    found: dict[str, dict[int, float]] = {n: {} for n in index}
    names = list(index)
    for row in spans.join(F.broadcast(asked), hit).select("c", "rank", "v").collect():
        found[names[row["c"]]][row["rank"]] = row["v"]
    return found


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """Exact median per group, also when one group outgrows a task."""
    frame = df.select(*[col(k) for k in keys], value.cast("double").alias("v")).where(F.col("v").isNotNull())
    groups = [col(k) for k in keys]
    sizes = frame.groupBy(*groups).agg(F.count("v").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= limit:
        return frame.groupBy(*groups).agg(F.median("v").alias(out))

    # Small groups keep all their values; those of a large group's sketch bracket are counted before they are used.
    group = [f"_g{i}" for i in range(len(keys))]
    middle = [F.floor((F.col("n") - 1) / 2).cast("bigint"), F.floor(F.col("n") / 2).cast("bigint")]
    state = frame.groupBy(*groups).agg(F.count("v").alias("n"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    state = state.select(
        *[col(k).alias(g) for k, g in zip(keys, group, strict=True)], middle[0].alias("_lower"), middle[1].alias("_upper"),
        "_low", "_high", F.lit(0).cast("bigint").alias("_below"), F.col("n").alias("_inside"),
    )
    # A round keeps about 3 / 64 of a bracket; where few values make up most of it, it cannot shrink and need not.
    for _ in range(8):
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        largest = state.where(F.col("_low") < F.col("_high")).agg(F.max("_inside")).first()[0] or 0
        if largest <= limit:
            break
        state = _narrowed(frame, keys, group, state, limit)
    tagged = _tagged(frame, keys, group, state)
    kept = [F.col(g) for g in group] + [F.col(c) for c in ("_lower", "_upper", "_below")]
    inside = tagged.where(F.col("v").between(F.col("_low"), F.col("_high"))).groupBy(*kept, "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("v")) + F.col("_below")
    spans = inside.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("c"))
    low_hit = (F.col("_from") <= F.col("_lower")) & (F.col("_upto") > F.col("_lower"))
    high_hit = (F.col("_from") <= F.col("_upper")) & (F.col("_upto") > F.col("_upper"))
    found = spans.groupBy(*group).agg(
        F.max(F.when(low_hit, F.col("v"))).alias("_a"), F.max(F.when(high_hit, F.col("v"))).alias("_b")
    )
    return found.select(
        *[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], ((F.col("_a") + F.col("_b")) / 2).alias(out)
    )


def _tagged(frame: DataFrame, keys: Sequence[str], group: Sequence[str], state: DataFrame) -> DataFrame:
    """Every value with its group's bracket; adaptive skew handling splits a hot group."""
    same = F.lit(True)
    for g, k in zip(group, keys, strict=True):
        same = same & col(k).eqNullSafe(F.col(g))
    return frame.join(state, same)


def _narrowed(frame: DataFrame, keys: Sequence[str], group: Sequence[str], state: DataFrame, limit: int) -> DataFrame:
    """Brackets of large groups made smaller by a sketch, checked by counting: where the sketch misses the
    middle, the part of the old bracket beside it is taken, which holds it for certain."""
    tagged = _tagged(frame, keys, group, state.where(F.col("_inside") > limit))
    fixed = [F.col(g) for g in group] + [F.col(c) for c in ("_lower", "_upper", "_low", "_high", "_below", "_inside")]
    v = F.when(F.col("v").between(F.col("_low"), F.col("_high")), F.col("v"))
    steps = [F.lit(i / 64) for i in range(1, 64)]
    cuts = tagged.groupBy(*fixed).agg(F.percentile_approx(v, F.array(*steps), F.lit(_ACCURACY)).alias("_cuts"))
    share = (F.col("_lower") - F.col("_below")) / F.col("_inside")
    at = F.greatest(F.lit(0), F.least(F.floor(share * 64).cast("int"), F.lit(63)))
    cuts = cuts.withColumns(
        {"_p": F.when(at >= 2, F.get("_cuts", at - 2)).otherwise(F.col("_low")), "_q": F.when(at <= 60, F.get("_cuts", at + 1)).otherwise(F.col("_high"))}
    ).drop("_cuts")
    pieces = _tagged(frame, keys, group, cuts)
    counted = pieces.groupBy(*fixed, "_p", "_q").agg(
        F.count_if(F.col("v") < F.col("_p")).alias("_under"), F.count_if(F.col("v") <= F.col("_q")).alias("_to"),
        F.min(F.when(F.col("v") > F.col("_q"), F.col("v"))).alias("_next"), F.max(F.when(F.col("v") < F.col("_p"), F.col("v"))).alias("_prior"),
    )
    holds = (F.col("_under") <= F.col("_lower")) & (F.col("_upper") < F.col("_to"))
    left = F.col("_upper") < F.col("_under")
    right = F.col("_lower") >= F.col("_to")
    # The two middle ranks may lie on both sides of an edge; then the whole bracket stays, less its far side.
    new_low = F.when(holds, F.col("_p")).when(right, F.col("_next")).when(left, F.col("_low")).otherwise(
        F.when(F.col("_lower") < F.col("_under"), F.col("_prior")).otherwise(F.col("_p"))
    )
    new_high = F.when(holds, F.col("_q")).when(left, F.col("_prior")).when(right, F.col("_high")).otherwise(
        F.when(F.col("_upper") >= F.col("_to"), F.col("_next")).otherwise(F.col("_q"))
    )
    fresh = counted.select(
        *[F.col(g) for g in group], "_lower", "_upper", new_low.alias("_low"), new_high.alias("_high")
    )
    sized = _tagged(frame, keys, group, fresh).groupBy(*[F.col(g) for g in group], "_lower", "_upper", "_low", "_high").agg(
        F.count_if(F.col("v") < F.col("_low")).alias("_below"), F.count_if(F.col("v").between(F.col("_low"), F.col("_high"))).alias("_inside")
    )
    return state.where(F.col("_inside") <= limit).select(*sized.columns).unionByName(sized)


def keys_at_ranks(
    df: DataFrame, order_by: Sequence[str], ranks: Sequence[int], limit: int = DIRECT_LIMIT
) -> list[tuple]:
    """The order keys of the rows at 0-based ranks, nulls last in every column; order keys are
    numeric or time-like, and together unique (rows that repeat a key are interchangeable).

    The first column is selected for all ranks at once; rows that tie with a selected value are
    ranked by the remaining columns.
    """
    first, rest = order_by[0], list(order_by[1:])
    slim = df.select(*[col(c) for c in order_by])
    filled = slim.agg(F.count(col(first))).first()[0]
    inside = [r for r in ranks if r < filled]
    at = dict(zip(inside, order_statistics(slim, col(first), inside, limit), strict=True)) if inside else {}
    values = [at.get(r) for r in ranks]
    if not rest:
        return [(v,) for v in values]
    picked = list(dict.fromkeys(values))
    facts = slim.agg(
        *[(F.count_if(col(first) < F.lit(v)) if v is not None else F.count(col(first))).alias(f"b{i}") for i, v in enumerate(picked)],
        *[F.count_if(col(first).eqNullSafe(F.lit(v))).alias(f"s{i}") for i, v in enumerate(picked)],
    ).first()
    below = {v: facts[f"b{i}"] for i, v in enumerate(picked)}
    left = {r: r - below[v] for r, v in zip(ranks, values, strict=True)}
    big = {v for i, v in enumerate(picked) if facts[f"s{i}"] > limit}
    keys: dict[int, tuple] = {}
    for v in big:
        mine = [r for r, w in zip(ranks, values, strict=True) if w == v]
        tied = slim.where(col(first).eqNullSafe(F.lit(v)))
        tails = keys_at_ranks(tied, rest, [left[r] for r in mine], limit)
        keys.update({r: (v, *tail) for r, tail in zip(mine, tails, strict=True)})
    small = [(r, v) for r, v in zip(ranks, values, strict=True) if v not in big]
    if small:
        order = Window.partitionBy(col(first)).orderBy(*[col(c).asc_nulls_last() for c in rest])
        hit, tie = F.lit(False), F.lit(False)
        for r, v in small:
            same = col(first).eqNullSafe(F.lit(v))
            tie = tie | same
            hit = hit | (same & (F.col("_place") == left[r]))
        tied = slim.where(tie).withColumn("_place", F.row_number().over(order) - 1)
        rows = {(row[first], row["_place"]): row for row in tied.where(hit).collect()}
        for r, v in small:
            row = rows[v, left[r]]
            keys[r] = (v, *[row[c] for c in rest])
    return [keys[r] for r in ranks]


def after_key(order_by: Sequence[str], key: tuple) -> Column:
    """True for rows that come after the key in the order, nulls last; never null."""
    test = F.lit(False)
    for i in reversed(range(len(order_by))):
        here, at = col(order_by[i]), key[i]
        if at is None:
            test = here.isNull() & test
        else:
            later = here.isNull() | (here > F.lit(at))
            test = later | (F.coalesce(here == F.lit(at), F.lit(False)) & test)
    return test
