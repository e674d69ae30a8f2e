"""Reproducible draws: a multiplicative congruential step on an id, exact on every engine.

The value depends only on (id, salt), so a re-run task after a lost executor gives the
same row, which ``rand(seed)`` does not promise once the partitioning changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
STEP_A = 48271
STEP_B = 16807


def draw(row_id: Column, salt: int) -> Column:
    """An integer in [0, MODULUS) for (id, salt)."""
    first = F.pmod((row_id % MODULUS + 1) * STEP_A + salt * 7919, F.lit(MODULUS))
    return F.pmod(first * STEP_B + salt, F.lit(MODULUS))


def draw_sql(row_id: str, salt: int) -> str:
    """The same draw as SQL text, for the comparison queries."""
    first = f"((({row_id}) % {MODULUS} + 1) * {STEP_A} + {salt * 7919}) % {MODULUS}"
    return f"((({first}) * {STEP_B} + {salt}) % {MODULUS})"


def pick(row_id: Column, salt: int, values: list, weights: list[int]) -> Column:
    """A weighted choice among literal values."""
    point = draw(row_id, salt) % sum(weights)
    out, bound = None, 0
    for value, weight in zip(values, weights):
        bound += weight
        out = F.when(point < bound, F.lit(value)) if out is None else out.when(point < bound, F.lit(value))
    return out


def pick_sql(row_id: str, salt: int, values: list, weights: list[int]) -> str:
    point = f"{draw_sql(row_id, salt)} % {sum(weights)}"
    arms, bound = [], 0
    for value, weight in zip(values, weights):
        bound += weight
        shown = str(value) if not isinstance(value, str) else "'" + value.replace("'", "''") + "'"
        arms.append(f"WHEN {point} < {bound} THEN {shown}")
    return "CASE " + " ".join(arms) + " END"


def between(row_id: Column, salt: int, low: int, high: int) -> Column:
    """A whole number in [low, high]."""
    return (F.lit(low).cast("bigint") + draw(row_id, salt) % (high - low + 1))


def between_sql(row_id: str, salt: int, low: int, high: int) -> str:
    return f"({low} + {draw_sql(row_id, salt)} % {high - low + 1})"


def digits(row_id: Column, salt: int, width: int) -> Column:
    """``width`` decimal digits as text."""
    return F.lpad((draw(row_id, salt) % (10 ** min(width, 9))).cast("string"), width, "0")


def digits_sql(row_id: str, salt: int, width: int) -> str:
    return f"lpad(CAST({draw_sql(row_id, salt)} % {10 ** min(width, 9)} AS VARCHAR), {width}, '0')"


def unit(row_id: Column, salt: int) -> Column:
    """A number in (0, 1)."""
    return (draw(row_id, salt) + 1) / F.lit(float(MODULUS + 1))


def unit_sql(row_id: str, salt: int) -> str:
    return f"(({draw_sql(row_id, salt)} + 1) / {float(MODULUS + 1)}::DOUBLE)"


def normal(row_id: Column, salt: int, mean: float, stddev: float) -> Column:
    """Normal draw: the sum of twelve unit draws minus six (exact arithmetic, no ln or cos)."""
    total = sum((draw(row_id, salt + 31 * k) for k in range(1, 12)), draw(row_id, salt))
    return F.lit(mean) + F.lit(stddev) * (total / F.lit(float(MODULUS)) - 6.0)


def normal_sql(row_id: str, salt: int, mean: float, stddev: float) -> str:
    total = " + ".join(draw_sql(row_id, salt + 31 * k) for k in range(12))
    return f"({float(mean)}::DOUBLE + {float(stddev)}::DOUBLE * (({total}) / {float(MODULUS)}::DOUBLE - 6.0::DOUBLE))"


def gamma(row_id: Column, salt: int, low: float, high: float, shape: int) -> Column:
    """Right-skewed draw in [low, high]: the product of ``shape`` unit draws, scaled."""
    product = unit(row_id, salt)
    for k in range(1, shape):
        product = product * unit(row_id, salt + 57 * k)
    return F.lit(low) + F.lit(high - low) * product


def gamma_sql(row_id: str, salt: int, low: float, high: float, shape: int) -> str:
    product = " * ".join(unit_sql(row_id, salt + 57 * k) for k in range(shape))
    return f"({float(low)}::DOUBLE + {float(high - low)}::DOUBLE * ({product}))"
