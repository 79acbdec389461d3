"""Rounding that does not depend on summation order.

Distributed sums of doubles differ in their last bits from run to run.  A value such as 1.37935
then lands on either side of a rounding border; rounding to ten digits first removes that noise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE_DIGITS = 10


def stable_round(col: Column | str, digits: int = 0) -> Column:
    return F.round(F.round(col, NOISE_DIGITS), digits)
