"""SQL text builders for the DuckDB oracle (mirrors of the Spark operators).

These produce plain SQL over the pre-registered views; they are the
independent second implementation that each query is checked against.
"""

from __future__ import annotations

from fractions import Fraction


def r(expr: str, digits: int = 6) -> str:
    """Same rounding as ``functions.exprs.rnd``."""
    return f"(floor(cast({expr} as double) * 1e{digits} + 0.5) / 1e{digits})"


def sdiv(num: str, den: str, empty: str = "0e0") -> str:
    return f"(case when ({den}) = 0 then {empty} else cast({num} as double) / cast({den} as double) end)"


def h(seed: int, key: str = "row_id") -> str:
    return f"md5('{seed}#' || cast({key} as varchar))"


def frac(f) -> Fraction:
    return Fraction(str(f)) if not isinstance(f, Fraction) else f


def quota_ctes(src: str, label: str | None, test_fraction, prefix: str = "q") -> str:
    """CTEs ``{prefix}`` (cls, n, n_train, n_test): largest-remainder train counts."""
    f = frac(test_fraction)
    lab = label if label else "'all'"
    return f"""
{prefix}0 as (select {lab} as cls, count(*) as n from {src} group by all),
{prefix}1 as (select cls, n, sum(n) over () as nn from {prefix}0),
{prefix}2 as (select cls, n, nn, nn - (nn * {f.numerator} + {f.denominator - 1}) // {f.denominator} as k from {prefix}1),
{prefix}3 as (select *, (n * k) // nn as base, (n * k) % nn as rem from {prefix}2),
{prefix}4 as (select *, k - sum(base) over () as deficit,
  row_number() over (order by rem desc, cls asc nulls first) as pos from {prefix}3),
{prefix} as (select cls, n, cast(base + case when pos <= deficit then 1 else 0 end as bigint) as n_train,
  cast(n - base - case when pos <= deficit then 1 else 0 end as bigint) as n_test from {prefix}4)"""


def split_ctes(src: str, label: str | None, test_fraction, seed: int = 42, name: str = "sp",
               key: str = "row_id") -> str:
    """CTE ``{name}``: src.* + split in {'train','test'} (rank by md5 within class <= n_train)."""
    lab = label if label else "'all'"
    return quota_ctes(src, label, test_fraction, prefix=f"{name}_q") + f""",
{name}_r as (select s.*, row_number() over (partition by {lab} order by {h(seed, key)}, {key}) as rn__
  from {src} s),
{name} as (select {name}_r.* exclude (rn__),
  case when rn__ <= {name}_q.n_train then 'train' else 'test' end as split
  from {name}_r join {name}_q on {name}_q.cls is not distinct from {('{0}_r.'.format(name) + label) if label else "'all'"})"""
