"""Means that do not depend on the order in which rows are summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value is cut into whole numbers of so many bits, and each cut is summed without rounding.
BITS = 26
#: Cuts below and above the point; bits below 2**-130 are left out.
LOWEST, HIGHEST = -5, 2


def exact_mean(value: str | Column) -> Column:
    """The mean of doubles, bit for bit the same under any partitioning; nulls do not count, and without values it is null.

    A double is the sum of its cuts of 26 bits. Those are whole numbers, so partial aggregates merge their sums in any
    order without rounding; only the end result is rounded. A long holds the cuts of 2**37 rows a group. A group
    with NaN, an infinity or a value from 2**78 up gets the plain mean.
    """
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    fits = F.when(F.abs(value) < 2.0 ** (BITS * (HIGHEST + 1)), value)
    carry, cuts = F.lit(0).cast("bigint"), []
    for k in range(LOWEST, HIGHEST + 1):
        cut = ((fits % 2.0 ** (BITS * (k + 1))) * 2.0 ** (-BITS * k)).cast("bigint")
        own = F.sum(cut) + carry
        if k < HIGHEST:  # all cuts but the highest, which has the sign, end between 0 and 2**26
            own, carry = own.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")), F.shiftright(own, BITS)
        cuts.append(own.cast("double") * 2.0 ** (BITS * k))
    total = cuts[-1]
    for cut in cuts[-2::-1]:  # downwards, so that a negative total loses nothing to cancellation
        total = total + cut
    return F.when(F.count(fits) == F.count(value), F.try_divide(total, F.count(value))).otherwise(F.avg(value))
