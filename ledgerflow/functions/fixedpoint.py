"""Sums of money that are exact, and so do not depend on the order in which rows meet.

A DOUBLE amount below 9e9 stands for the nearest number of millionths, plus what
it differs from that number's own DOUBLE: 0.1 is exactly one tenth.
:func:`exact_sum` deals every amount to integer limbs, so partial sums merge
without rounding and 0.1 + 0.2 - 0.3 is 0 in every order:

=========  ================================================================
``whole``  units, with the sign of the amount
``micro``  millionths beside them
``pico``   the difference, in units of 1e-12 ...
``atto``   ... and of 1e-18 beside those; a DOUBLE from 9e9 up has none
``dust``   units of 1e-28: what is left of an amount below 0.01
``rest``   a plain DOUBLE sum of all other values (1e15 and more, less than
           1e-11, NaN); only such a sum still depends on the order
=========  ================================================================

All limbs but the last are BIGINT, each far below 1e7 a row for usual amounts
(``whole`` is the amount itself), so 1e12 rows fit in one sum; an overflow fails
the query.  The arithmetic is IEEE's, without text or DECIMAL, so an aggregate
costs little more than plain sums.

The finished sum is a DOUBLE kept to ``DIGITS`` significant digits, which hides
how the limbs were put together.  No value, however small, becomes zero.
"""
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

DIGITS = 13
# Below this the unit of settled() would not fit a DOUBLE; such sums stay as they are.
LEAST_SETTLED = 1e-280

LIMBS = ("whole", "micro", "pico", "atto", "dust", "rest")
_MICROS, _WHOLE, _LEAST = 9e9, 1e15, 1e-11


def settled(total: Column) -> Column:
    """A finished DOUBLE sum kept to ``DIGITS`` significant digits (NULL stays NULL)."""
    x = total.cast("double")
    unit = F.pow(F.lit(10.0), F.lit(float(DIGITS - 1)) - F.floor(F.log10(F.abs(x))).cast("double"))
    return F.when(F.abs(x) < F.lit(LEAST_SETTLED), x + F.lit(0.0)).otherwise(F.rint(x * unit) / unit)


def limbs(x: Column) -> dict:
    """The limbs of an amount (all NULL for a NULL one); their sums, merged in any way, make its
    exact sum.  ``x`` is repeated often: give a plain column."""
    v = x.cast("double")
    a = F.abs(v)
    zero, million = F.lit(0).cast("bigint"), F.lit(1_000_000).cast("bigint")
    usual = (a < F.lit(_MICROS)) & ((a >= F.lit(_LEAST)) | (a == F.lit(0.0)))
    large = (a >= F.lit(_MICROS)) & (a < F.lit(_WHOLE))
    near = F.rint(v * F.lit(1e6))
    millionths = near.cast("bigint")
    differs = v - near / F.lit(1e6)
    attos = F.rint(differs * F.lit(1e18))
    left = F.rint((differs - attos / F.lit(1e18)) * F.lit(1e28)).cast("bigint")
    whole = F.rint(v)
    beside = F.rint((v - whole) * F.lit(1e6)).cast("bigint")

    def div(n):
        return F.call_function("div", n, million)

    parts = {
        "whole": F.when(usual, div(millionths)).when(large, whole.cast("bigint")),
        "micro": F.when(usual, millionths % million).when(large, beside),
        "pico": F.when(usual, div(attos.cast("bigint"))),
        "atto": F.when(usual, attos.cast("bigint") % million),
        "dust": F.when(usual & (a < F.lit(0.01)), left),
    }
    parts = {name: part.when(v.isNotNull(), zero) for name, part in parts.items()}
    return {**parts, "rest": F.when(usual | large, F.lit(0.0)).otherwise(v)}


def total_of(sums: dict) -> Column:
    """The DOUBLE that summed limbs stand for; NULL if no amount went in."""
    total = sums["whole"].cast("double")
    for name, unit in (("micro", 1e-6), ("pico", 1e-12), ("atto", 1e-18), ("dust", 1e-28)):
        total = total + sums[name].cast("double") * F.lit(unit)
    return total + sums["rest"]


def exact_sum(x: Column) -> Column:
    """Order-free aggregate sum of a DOUBLE column (NULL for no value), to be settled once."""
    return total_of({name: F.sum(part) for name, part in limbs(x).items()})


def exact_sums(rows: GroupedData | DataFrame, sums: dict, *others: Column, zero: bool = False) -> DataFrame:
    """``rows.agg`` of ``others`` and the settled exact sums of named columns; ``zero``: 0 instead of
    NULL for no value.  Settling is a projection of its own: inside the aggregate it would repeat
    every limb's expression."""
    out = rows.agg(*others, *[exact_sum(x).alias(name) for name, x in sums.items()])
    return out.withColumns({name: settled(F.coalesce(F.col(name), F.lit(0.0)) if zero else F.col(name)) for name in sums})
