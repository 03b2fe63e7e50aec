"""Exact sums and averages of 64-bit values, as SQL text and as columns.

``sum(decimal)`` is exact but about five times slower than ``sum(bigint)``, and
``sum(bigint)`` overflows. A value is therefore split into three limbs of at
most 22 bits (the top one carries the sign) whose bigint sums cannot overflow
below 2**41 rows per group; the total is put together once per group.
"""

from pyspark.sql import Column, functions as F

MAX_ROWS_PER_GROUP = 1 << 41


def exact_sum_sql(value: str) -> str:
    """Exact ``DECIMAL(38,0)`` sum of the bigint expression ``value``."""

    def limb(expression: str, scale: int) -> str:
        return f"cast(sum({expression}) as decimal(20,0)) * cast({scale} as decimal(14,0))"

    total = " + ".join(
        [
            limb(f"shiftright({value}, 44)", 1 << 44),
            limb(f"shiftright({value}, 22) & 4194303", 1 << 22),
            limb(f"{value} & 4194303", 1),
        ]
    )
    return (
        f"cast(if(count({value}) <= {MAX_ROWS_PER_GROUP}, {total}, "
        f"raise_error('more than 2^41 rows in one group')) as decimal(38,0))"
    )


def exact_sum(value: str) -> Column:
    return F.expr(exact_sum_sql(value))


def exact_average_sql(total: str, cnt: str) -> str:
    """``total / cnt`` to two decimals, halves away from zero, as ``DECIMAL(21,2)``.

    Integer arithmetic throughout: rounding a decimal quotient would round twice.
    """
    hundredths = f"(200 * cast(abs({total} % {cnt}) as bigint) + {cnt}) div (2 * {cnt})"
    return (
        f"cast(cast({total} div {cnt} as decimal(20,0))"
        f" + cast(sign({total}) as decimal(1,0)) * cast({hundredths} as decimal(20,0))"
        f" * cast(0.01 as decimal(3,2)) as decimal(21,2))"
    )


def exact_average(total: str, cnt: str) -> Column:
    return F.expr(exact_average_sql(total, cnt))


def rounded_average(total: str, cnt: str) -> Column:
    """``total / cnt`` to a whole number, halves up (towards plus infinity)."""
    doubled = f"(2 * {total} + {cnt})"
    return F.expr(
        f"{doubled} div (2 * {cnt}) - if({doubled} % (2 * {cnt}) < 0, 1, 0)"
    ).cast("bigint")
