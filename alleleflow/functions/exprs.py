"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log-factorials below come from a literal, the others from Stirling's series, which is exact to
# double precision from there on. So no operator needs to know the largest sample size beforehand.
_SERIES_FROM = 64


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def multiply(terms) -> Column:
    return reduce(lambda a, b: a * b, terms)


def smallest(cols) -> Column:
    cols = list(cols)
    return cols[0] if len(cols) == 1 else F.least(*cols)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is zero."""
    return F.when(den != 0, num / den)


def rounded(c: str | Column, digits: int = 6, nudge: float = 0.0) -> Column:
    """Round to `digits` decimals and turn -0.0 into 0.0. `nudge` moves values off a rounding
    edge, so that engines that differ in the last bit round alike."""
    return F.round(col(c).cast("double") + nudge, digits) + F.lit(0.0)


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def hash_order(seed, *keys) -> Column:
    """A reproducible pseudo-random ordering string, md5 of 'seed:key[:key...]'."""
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(seed, *keys) -> Column:
    """A reproducible uniform number in [0, 1) from the first 32 bits of `hash_order`."""
    head = F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def poisson_one(u: Column) -> Column:
    """Poisson(1) quantile of a uniform number, by comparing with the cumulative mass. What lies
    above the last entry is less than 2^-32, the step of the uniform numbers, so no weight is cut."""
    cumulative, total = [], 0.0
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        cumulative.append(total)
    return add([(u > F.lit(c)).cast("int") for c in cumulative])


def log_factorial(n: str) -> str:
    """SQL for ln(n!) of a count: plain arithmetic, the same at every size, with no array in the row."""
    x = f"cast({n} AS double)"
    # a string literal folds to one array literal, which keeps the plan small
    values = ",".join(repr(math.lgamma(k + 1.0)) for k in range(_SERIES_FROM))
    table = f"cast(split('{values}', ',') AS array<double>)"
    series = (f"(({x} + 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + (1D / {x})"
              f" * (1D/12 - (1D/360 - 1D/1260 / ({x} * {x})) / ({x} * {x})))")
    return f"if({n} < {_SERIES_FROM}, get({table}, cast({n} AS int)), {series})"


def absent(rest: str, depth: str, log_rest: str, log_all: str) -> str:
    """SQL for C(rest, depth) / C(total, depth): the chance that an allele is missing from a
    subsample of `depth` when `rest` of `total` gene copies are of other alleles; 0 if it cannot be
    missed. `log_rest` is ln(rest!) and `log_all` ln(total!) - ln((total - depth)!); both are the
    caller's columns, so that neither is computed once per allele and depth."""
    exponent = f"{log_rest} - {log_all} - {log_factorial(f'({rest} - {depth})')}"
    return f"coalesce(if({rest} >= {depth}, exp({exponent}), 0D), 0D)"


def argmax_label(scores, labels) -> Column:
    """Label of the largest score; the first one wins ties."""
    arr = F.array(*[col(s) for s in scores])
    return F.element_at(F.array(*[F.lit(x) for x in labels]),
                        F.array_position(arr, F.array_max(arr)).cast("int"))
