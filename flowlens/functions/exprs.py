"""Small column helpers shared by the operators.

``rnd`` rounds with plain IEEE operations (multiply, add, floor, divide) so the
same value comes out of Spark and of any SQL engine; Spark's ``round`` goes
through a decimal string and can differ from other engines on halves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c, digits: int = 6) -> Column:
    scale = float(10 ** digits)
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def rnd_sql(expr: str, digits: int = 6) -> str:
    """SQL text of :func:`rnd` for the DuckDB oracle."""
    return f"(floor(cast({expr} as double) * 1e{digits} + 0.5) / 1e{digits})"


def safe_div(num, den, empty=0.0) -> Column:
    """num / den as double; ``empty`` (a number or None) when den == 0."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    val = num.cast("double") / den.cast("double")
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(val)


def half_up_ratio(num, den, digits: int) -> Column:
    """round(num / den, digits), half-up, computed in integer arithmetic.

    Exact for integer num/den, so it does not depend on how an engine prints
    or rounds the double quotient.
    """
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    scale = 10 ** digits
    q = F.floor((num.cast("bigint") * (2 * scale) + den) / (den * 2))
    return (q / F.lit(float(scale))).cast("double")


def stable_hash(seed: int, key) -> Column:
    """Deterministic per-row hex hash of (seed, key): md5 of '<seed>#<key>'."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}#"), key.cast("string")))


def stable_hash_sql(seed: int, key: str) -> str:
    return f"md5('{seed}#' || cast({key} as varchar))"
