"""Whitening of embeddings along exact principal axes.

Every entry becomes the whole number y = floor(scale * c). The scatter M = n * sum(y y') - S S' is then a matrix of
whole numbers, n^2 times the covariance, and everything up to the axes is worked out without rounding:

* sums and products per task, added up by Spark in 40-bit limbs, so no size overflows;
* the characteristic polynomial of M modulo many primes below 2^31, each by reduction to Hessenberg form (the primes
  are dealt to tasks; as many as the bound binomial(d, k) * (trace / d)^k on its coefficients asks for), put together
  by Chinese remaindering;
* its largest roots. M has only real roots, none negative, so by Budan and Fourier the sign changes of the polynomial
  moved to ``a`` are exactly the number of roots above ``a``. Bisection isolates each root, a bracketed Newton
  iteration on whole numbers narrows it to `BITS` binary digits;
* the axis of a root: inverse iteration on the null space of M - root, started in doubles and corrected with residuals
  that are computed in whole numbers, until the correction is below double precision.

Axes of roots that agree to within 1e-12 of the largest root are not distinguishable; an orthonormal basis of their
common space is taken. Only numbers per pair of dimensions reach the driver.

Defined cases: rows whose vector is null, holds a null or a non-finite entry or one whose scaled value leaves 62 bits,
or has another length than the commonest (the longest among equally common ones) take no part; repeated rows count as
often as they occur; axes of the root 0 do not exist (they cannot be scaled), so there are min(components, rank) of
them: none for a single row, for equal rows and for an empty table. A squared deviation beyond 64 bits is null. Columns
of the input called like a result come back as ``own_<name>``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col
from tabloom.llm.common import shield
from tabloom.llm.vectors import commonest_length, usable, whole

#: Binary digits of a root, relative to the largest one.
BITS = 128
#: Roots closer than this share of the largest one count as one root with several axes.
CLOSE = 1e-12
_LIMB = 40
_LIMBS = 6
_PRIMES_PER_TASK = 32


def _parts(y: np.ndarray) -> Iterator[np.ndarray]:
    rows = max(1, min(4096, 2**20 // y.shape[1]))
    for start in range(0, len(y), rows):
        yield y[start : start + rows]


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, by double products that stay below 2^53."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    digits, rest = [], y
    while rest.any():
        low = ((rest + 2**19) & (2**20 - 1)) - 2**19
        digits.append(low.astype(np.float64))
        rest = (rest - low) >> 20
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (20 * (i + j)))
    return total


def _limbs(value: int) -> list[int]:
    found = []
    for _ in range(_LIMBS - 1):
        low = value & (2**_LIMB - 1)
        found.append(low)
        value = (value - low) >> _LIMB
    return [*found, value]


def scatter(df: DataFrame, vector: str, d: int, scale: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, sum of y y') as Python integers; a task sends one number per pair of dimensions."""
    upper = np.triu_indices(d)

    def add_up(batches):
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for y in _parts(whole(batch.column(0), d, scale)):
                n += len(y)
                # 62-bit entries are added in halves.
                sums = sums + (y >> 31).sum(axis=0).astype(object) * 2**31 + (y & (2**31 - 1)).sum(axis=0).astype(object)
                products = products + _exact_products(y)
        numbers = [n, *sums.tolist(), *products[upper].tolist()]
        if n:
            columns = [pa.array(x, pa.int64()) for x in zip(*[_limbs(int(v)) for v in numbers], strict=True)]
            names = ["place", *[f"l{i}" for i in range(_LIMBS)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int32()), *columns], names)

    schema = ", ".join(["place int", *[f"l{i} bigint" for i in range(_LIMBS)]])
    found = df.select(col(vector)).mapInArrow(add_up, schema).groupBy("place")
    numbers = [0] * (1 + d + len(upper[0]))
    for row in found.agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(_LIMBS)]).collect():
        numbers[row["place"]] = sum(row[f"l{i}"] << (_LIMB * i) for i in range(_LIMBS))
    products = np.zeros((d, d), object)
    products[upper] = numbers[1 + d :]
    products.T[upper] = numbers[1 + d :]
    return numbers[0], np.array(numbers[1 : 1 + d], object), products


def is_prime(p: int) -> bool:
    """Miller and Rabin with bases that decide every number below 3,215,031,751."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_beyond(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` binary digits."""
    found, product, p = [], 1, 2**31 + 1
    while product.bit_length() <= bits:
        p -= 2
        if is_prime(p):
            found.append(p)
            product *= p
    return found


def residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of the characteristic polynomial modulo each prime, via Hessenberg form."""
    d, q = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    a = np.stack([(matrix % prime).astype(np.int64) for prime in primes])
    flat, wide = p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        below = a[:, m:, m - 1] != 0
        pivot = below.argmax(axis=1) + m
        for i in np.flatnonzero(pivot != m):
            a[i][[m, pivot[i]]] = a[i][[pivot[i], m]]
            a[i][:, [m, pivot[i]]] = a[i][:, [pivot[i], m]]
        inverse = np.array([pow(int(x), -1, int(r)) if x else 0 for x, r in zip(a[:, m, m - 1], p, strict=True)], np.int64)
        u = a[:, m + 1 :, m - 1] * inverse[:, None] % flat
        a[:, m + 1 :, m - 1 :] = (a[:, m + 1 :, m - 1 :] - u[:, :, None] * a[:, m : m + 1, m - 1 :] % wide) % wide
        a[:, :, m] = (a[:, :, m] + (a[:, :, m + 1 :] * u[:, None, :] % wide).sum(axis=2)) % flat
    polys = np.zeros((q, d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(1, d + 1):
        made = np.zeros((q, d + 1), np.int64)
        made[:, 1:] = polys[:, k - 1, :-1]
        made = (made - a[:, k - 1, k - 1, None] * polys[:, k - 1] % flat) % flat
        if k > 1:
            factors, run = np.empty((q, k - 1), np.int64), np.ones(q, np.int64)
            for i in range(k - 2, -1, -1):
                run = run * a[:, i + 1, i] % p
                factors[:, i] = run * a[:, i, k - 1] % p
            made = (made - (factors[:, :, None] * polys[:, : k - 1] % wide).sum(axis=1)) % flat
        polys[:, k] = made
    return polys[:, d]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial of a symmetric matrix without negative roots."""
    d = len(matrix)
    mean = -(-sum(int(matrix[i, i]) for i in range(d)) // d)
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    primes = primes_beyond(bound.bit_length() + 1)
    size = _PRIMES_PER_TASK

    def reduce(batches):
        for batch in batches:
            mine = [primes[i] for i in batch.column(0).to_pylist()]
            for start in range(0, len(mine), size):
                chosen = mine[start : start + size]
                rows = pa.array(residues(matrix, chosen).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), rows], ["prime", "residues"])

    dealt = spark.range(0, len(primes), 1, -(-len(primes) // size))
    found = dealt.mapInArrow(reduce, "prime bigint, residues array<bigint>").collect()
    product = math.prod(primes)
    total = [0] * (d + 1)
    for row in found:
        others = product // row["prime"]
        unit = pow(others % row["prime"], -1, row["prime"])
        for k, r in enumerate(row["residues"]):
            total[k] += others * (r * unit % row["prime"])
    reduced = (c % product for c in total)
    return [c - product if 2 * c > product else c for c in reduced]


def _moved(coefficients: list[int], a: int, s: int) -> list[int]:
    """Coefficients of the polynomial in x + a / 2^s, times a power of two."""
    d = len(coefficients) - 1
    c = [v << (s * (d - k)) for k, v in enumerate(coefficients)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    return c


def roots_above(coefficients: list[int], a: int, s: int = 0) -> int:
    """Number of roots above a / 2^s of a polynomial with real roots only."""
    signs = [c > 0 for c in _moved(coefficients, a, s) if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _value(coefficients: list[int], x: int, s: int) -> tuple[int, int]:
    """Polynomial and derivative at x / 2^s, both times 2^(s * degree); the derivative per step of 2^-s."""
    value, slope = 0, 0
    for k, c in enumerate(reversed(coefficients)):
        slope = slope * x + value
        value = value * x + (c << (s * k))
    return value, slope


def _narrowed(coefficients: list[int], low: int, high: int, above: int, s: int) -> int:
    """The only root in (low, high] / 2^s as a whole number of 2^-s, rounded to one of its neighbours.

    ``above`` is the number of roots above ``low``: the polynomial has the sign (-1)^above between ``low`` and the root.
    """
    sign = -1 if above % 2 else 1
    x = (low + high) // 2
    while high - low > 1:
        value, slope = _value(coefficients, x, s)
        if value == 0:
            return x
        if (value > 0) == (sign > 0):
            low = x
        else:
            high = x
        step = -value // slope if slope else 0
        guess = x + step
        if abs(step) <= 1:
            # Newton has arrived: close the bracket from the other side as well.
            guess = low + 1 if (value > 0) == (sign > 0) else high - 1
        x = guess if low < guess < high else (low + high) // 2
    return high


def largest_roots(coefficients: list[int], wanted: int) -> tuple[list[int], int]:
    """The largest non-zero roots, falling and as often as they occur, as whole numbers of 2^-s, and s."""
    while len(coefficients) > 1 and coefficients[0] == 0:
        coefficients = coefficients[1:]
    d = len(coefficients) - 1
    if d < 1:
        return [], 0
    top = max(1, -coefficients[-2]).bit_length()
    s_last = max(0, BITS - top)
    found: list[int] = []
    #: (low, high, s, roots above low, roots above high): roots lie in (low, high] / 2^s; the upper part comes first.
    open_parts = [(0, 1 << top, 0, d, 0)]
    while open_parts and len(found) < wanted:
        low, high, s, above_low, above_high = open_parts.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if inside == 1 or (s >= s_last and high - low <= 1):
            shift = max(0, s_last - s)
            if inside == 1:
                found.append(_narrowed(coefficients, low << shift, high << shift, above_low, s + shift))
            else:
                found.extend([high << shift] * inside)
            continue
        if high - low == 1:
            low, high, s = low * 2, high * 2, s + 1
        middle = (low + high) // 2
        above = roots_above(coefficients, middle, s)
        open_parts.append((low, middle, s, above_low, above))
        open_parts.append((middle, high, s, above, above_high))
    return found[:wanted], s_last


def _unit(v: np.ndarray, digits: int) -> np.ndarray:
    """A vector of whole numbers scaled to length 2^digits."""
    length = math.isqrt(sum(int(x) * int(x) for x in v))
    return np.array([(int(x) << digits) // length for x in v], object)


def axes(matrix: np.ndarray, roots: list[int], s: int, digits: int = 120) -> np.ndarray:
    """One unit vector per root, as columns of doubles: inverse iteration with whole-number residuals."""
    d = len(matrix)
    unit = 1 << max(0, max(int(matrix[i, i]) for i in range(d)).bit_length() - 1)
    rough = np.array([[int(x) / unit for x in row] for row in matrix])
    values = [r / (unit << s) for r in roots]
    groups: list[list[int]] = []
    for i, value in enumerate(values):
        if groups and values[groups[-1][-1]] - value <= CLOSE * values[0]:
            groups[-1].append(i)
        else:
            groups.append([i])
    found = np.zeros((d, len(roots)))
    rng = np.random.default_rng(42)
    for group in groups:
        middle = values[group[0]]
        shifted = rough - (middle + 1e-15 * max(values[0], 1e-300)) * np.eye(d)
        block = np.linalg.qr(rng.standard_normal((d, len(group))))[0]
        for _ in range(4):
            block = np.linalg.qr(np.linalg.solve(shifted, block))[0]
        border = np.zeros((d + len(group), d + len(group)))
        border[:d, :d] = rough - middle * np.eye(d)
        border[:d, d:], border[d:, :d] = block, block.T
        done: list[np.ndarray] = []
        for j, i in enumerate(group):
            v = np.array([int(round(x * 2**60)) << (digits - 60) for x in block[:, j].tolist()], object)
            root = roots[i if len(group) == 1 else group[0]]
            for _ in range(6):
                left = matrix.dot(v) - ((v * root) >> s)
                right = np.array([-int(x) / unit / 2**digits for x in left] + [0.0] * len(group))
                change = np.linalg.solve(border, right)[:d]
                v = v + np.array([int(round(x * 2**digits)) for x in change.tolist()], object)
                if np.abs(change).max() < 1e-20:
                    break
            for other in done:
                along = sum(int(a) * int(b) for a, b in zip(v, other, strict=True)) >> digits
                v = v - ((other * along) >> digits)
            v = _unit(v, digits)
            done.append(v)
            exact = np.array([int(x) / 2**digits for x in v])
            found[:, i] = exact * np.sign(exact[np.abs(exact).argmax()])
    return found


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: rows and sums of the fit, variances and axes (one column each) by falling variance."""

    scale: int
    dimension: int
    n: int
    sums: tuple[int, ...]
    variances: tuple[float, ...]
    explained: tuple[float, ...]
    axes: np.ndarray

    def _rows(self, df: DataFrame, vector: str) -> DataFrame:
        fine = usable(df, vector, 2.0**62 / self.scale)
        return fine.where(F.size(col(vector)) == self.dimension)

    def _project(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened rows, and the exact squared distance of n * y from the sums."""
        sums = np.array(self.sums, object)
        reach = self.n * int(np.abs(y).max(initial=0)) + max((abs(v) for v in self.sums), default=0)
        if reach < 2**62:
            off = self.n * y - sums.astype(np.int64)
            small = reach * reach * self.dimension < 2**63
            squares = (off * off).sum(axis=1).tolist() if small else [sum(v * v for v in r) for r in off.tolist()]
            centred = off / self.n
        else:
            exact = y.astype(object) * self.n - sums
            squares = [sum(v * v for v in r) for r in exact.tolist()]
            centred = np.array([[v / self.n for v in r] for r in exact.tolist()]).reshape(y.shape)
        return centred @ self.axes / np.sqrt(np.array(self.variances)), squares

    def transform(self, df: DataFrame, vector: str = "embedding", carry_vector: bool = True) -> DataFrame:
        """Usable rows with ``deviation`` (n^2 times the squared distance from the mean) and ``whitened``."""
        plain, back = shield(df, ("deviation", "whitened"))
        vector = next((new for new, old in back.items() if old == vector), vector)
        kept = [f for f in plain.schema.fields if carry_vector or f.name != vector]
        at, chosen = plain.columns.index(vector), [plain.columns.index(f.name) for f in kept]
        made = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
        schema = T.StructType([*kept, *made])
        model = self

        def apply(batches):
            for batch in batches:
                values, squares = [], []
                for y in _parts(whole(batch.column(at), model.dimension, model.scale)):
                    w, more = model._project(y)
                    values.append(w)
                    squares += [v if v < 2**63 else None for v in more]
                if not squares:
                    continue
                flat = np.concatenate(values)
                offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))
                columns = [*[batch.column(i) for i in chosen], pa.array(squares, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return self._rows(plain, vector).mapInArrow(apply, schema)

    def identity_error(self, df: DataFrame, vector: str = "embedding") -> float:
        """Largest absolute entry of the covariance of the whitened rows minus the identity; one more pass."""
        k = len(self.variances)
        upper = np.triu_indices(k)
        model = self

        def add_up(batches):
            sums, products = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                for y in _parts(whole(batch.column(0), model.dimension, model.scale)):
                    w, _ = model._project(y)
                    sums += w.sum(axis=0)
                    products += w.T @ w
            numbers = np.concatenate((sums, products[upper]))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int32()), pa.array(numbers)], ["place", "v"])

        if not k:
            return 0.0
        rows = self._rows(df.select(col(vector)), vector).mapInArrow(add_up, "place int, v double")
        found = {r["place"]: r["v"] for r in rows.groupBy("place").agg(F.sum("v").alias("v")).collect()}
        mean = np.array([found[i] for i in range(k)]) / self.n
        covariance = np.zeros((k, k))
        covariance[upper] = [found[k + i] / self.n for i in range(len(upper[0]))]
        covariance -= np.triu(np.outer(mean, mean))
        return float(np.abs(covariance - np.triu(np.eye(k))).max())


def fit(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64) -> Whitening:
    """The whitening of all usable vectors of ``df``."""
    rows = usable(df.select(col(vector)), vector, 2.0**62 / scale)
    d = commonest_length(rows, vector)
    n, sums, products = scatter(rows.where(F.size(col(vector)) == d), vector, d, scale) if d else (0, np.zeros(0, object), None)
    if not n:
        return Whitening(scale, d, 0, (), (), (), np.zeros((d, 0)))
    matrix = products * n - np.outer(sums, sums)
    trace = sum(int(matrix[i, i]) for i in range(d))
    if not trace:
        return Whitening(scale, d, n, tuple(int(v) for v in sums), (), (), np.zeros((d, 0)))
    roots, s = largest_roots(characteristic(df.sparkSession, matrix), components)
    unit = n * n << s
    return Whitening(
        scale, d, n, tuple(int(v) for v in sums), tuple(r / unit for r in roots), tuple(r / (trace << s) for r in roots),
        axes(matrix, roots, s),
    )
