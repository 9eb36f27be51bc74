"""Normal equations in SQL, for the counterparts of linear models."""

from __future__ import annotations

from collections.abc import Sequence


def comoments(feats: Sequence[str], y: str) -> str:
    """Centred sums of products c{i}_{j} (i <= j, the target last), means m{i}, the row count n."""
    names = [*feats, y]
    k = len(names)
    pairs = [
        f"covar_pop({names[i]}::DOUBLE, {names[j]}::DOUBLE) * count(*) AS c{i}_{j}" for i in range(k) for j in range(i, k) if i < len(feats)
    ]
    return ", ".join([*pairs, *[f"avg({n}::DOUBLE) AS m{i}" for i, n in enumerate(names)], "count(*) AS n"])


def solved(source: str, k: int, keep: Sequence[str] = (), alpha: str = "0", standard: bool = False) -> str:
    """A select of ``keep`` and the coefficients b0..b{k-1} and intercept b of each row of co-moments.

    Elimination downwards, substitution upwards; ``alpha`` is added to the squares of the features, in units of their
    population variance times the row count where ``standard`` asks for standardised features.
    """
    held = ", ".join([*keep, *[f"m{i}" for i in range(k + 1)], "n"])
    penalty = [f"{alpha} * c{i}_{i} / n" if standard else alpha for i in range(k)]
    diagonal = ", ".join(
        f"c{i}_{j}" + (f" + {penalty[i]}" if i == j else "") + f" AS c{i}_{j}" for i in range(k) for j in range(i, k + 1)
    )
    sql = f"SELECT {held}, {diagonal} FROM ({source})"
    for p in range(k - 1):
        same = [f"c{i}_{j}" for i in range(p + 1) for j in range(i, k + 1)]
        less = [f"c{i}_{j} - c{p}_{i} * c{p}_{j} / c{p}_{p} AS c{i}_{j}" for i in range(p + 1, k) for j in range(i, k + 1)]
        sql = f"SELECT {held}, {', '.join([*same, *less])} FROM ({sql})"
    for i in reversed(range(k)):
        rest = "".join(f" - c{i}_{j} * b{j}" for j in range(i + 1, k))
        sql = f"SELECT *, (c{i}_{k}{rest}) / c{i}_{i} AS b{i} FROM ({sql})"
    betas = ", ".join(f"b{i}" for i in range(k))
    intercept = " - ".join([f"m{k}", *[f"b{i} * m{i}" for i in range(k)]])
    return f"SELECT {', '.join([*keep, betas])}, {intercept} AS b FROM ({sql})"


def predicted(feats: Sequence[str]) -> str:
    """The prediction of a row joined with its coefficients."""
    return " + ".join(["b", *[f"b{i} * {f}" for i, f in enumerate(feats)]])


def r2(y: str, guess: str) -> str:
    return f"1 - sum(({y} - ({guess})) * ({y} - ({guess}))) / (count(*) * var_pop({y}))"
