"""Column expressions Spark lacks; all stay in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308
#: Coefficients of the Stirling series of ln Gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _lgamma_text(x: str) -> str:
    x = f"cast(({x}) as double)"
    y, u = f"({x} + 8)", f"({x} * ({x} + 7))"
    w, tail = f"(1 / ({y} * {y}))", f"{STIRLING[-1]!r}D"
    for c in reversed(STIRLING[:-1]):
        tail = f"({c!r}D + {tail} * {w})"
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {tail} / {y} - ln({u} * ({u} + 6) * ({u} + 10) * ({u} + 12)))"


def lgamma(x: Column | str) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, less the logarithm of x (x + 1) ... (x + 7).

    There is no branch, so generated code shares its parts; the product is a polynomial of u = x (x + 7). ``x`` given as
    SQL text makes the expression in one call.
    """
    if isinstance(x, str):
        return F.expr(_lgamma_text(x))
    x = x.cast("double")
    y, u = x + 8, x * (x + 7)
    w, tail = 1 / (y * y), F.lit(STIRLING[-1])
    for c in reversed(STIRLING[:-1]):
        tail = F.lit(c) + tail * w
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + tail / y - F.log(u * (u + 6) * (u + 10) * (u + 12))


def with_lgamma(df: DataFrame, **of: str) -> DataFrame:
    """``df`` with ln Gamma of each SQL expression under its name.

    The parts of the series that are used again are columns of their own on the way, so the expressions stay small.
    """
    part = lambda made: {f"_{k}_{n}": F.expr(t) for n in of for k, t in made(n).items()}
    out = df.withColumns({f"_x_{n}": F.expr(f"cast({t} as double)") for n, t in of.items()})
    out = out.withColumns(part(lambda n: {"y": f"_x_{n} + 8", "u": f"_x_{n} * (_x_{n} + 7)"}))
    out = out.withColumns(part(lambda n: {"w": f"1 / (_y_{n} * _y_{n})"}))
    made = {}
    for n in of:
        tail = f"{STIRLING[-1]!r}D"
        for c in reversed(STIRLING[:-1]):
            tail = f"({c!r}D + {tail} * _w_{n})"
        made[n] = F.expr(f"(_y_{n} - 0.5D) * ln(_y_{n}) - _y_{n} + {0.5 * math.log(2 * math.pi)!r}D + {tail} / _y_{n} - ln(_u_{n} * (_u_{n} + 6) * (_u_{n} + 10) * (_u_{n} + 12))")
    return out.withColumns(made).drop(*[f"_{k}_{n}" for k in "xyuw" for n in of])


def gain(count: Column | str, psi: Column | str) -> Column:
    """ln Gamma(count + psi) - ln Gamma(psi): what a count adds to a likelihood; 0 for count 0. Both columns, or both SQL text."""
    if isinstance(count, str):
        return F.expr(f"({_lgamma_text(f'({count}) + ({psi})')} - {_lgamma_text(psi)})")
    return lgamma(count + psi) - lgamma(psi)


def nb_logpmf(x: Column, mean: Column, phi: Column) -> Column:
    """Negative binomial log-probability with variance mean + mean^2 / phi."""
    mean, phi = F.greatest(mean, F.lit(TINY)), F.greatest(phi, F.lit(TINY))
    p = phi / (phi + mean)
    return lgamma(x + phi) - lgamma(phi) - lgamma(x + 1) + phi * F.log(p) + x * F.log1p(-p)


def rank01(order: list[Column], group: list[str]) -> Column:
    """Stable rank scaled to 0 .. 1 within a group; 1 for a group of one row."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return F.when(n <= 1, 1.0).otherwise((F.row_number().over(w) - 1) / (n - 1))


def power_of_two(ratio: Column) -> Column:
    """2 to the rounded (half to even) binary logarithm; 1 where there is nothing."""
    return F.when(ratio <= 0, 1.0).otherwise(F.pow(F.lit(2.0), F.rint(F.log2(F.greatest(ratio, F.lit(1e-12))))))


def uniform(seed: int, purpose: str, *keys) -> Column:
    """A number in 0 .. 1 (below 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
