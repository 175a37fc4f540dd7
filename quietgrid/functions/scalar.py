"""Column functions on numbers and arrays that Spark has no name for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logsumexp(values: Column) -> Column:
    """ln of the sum of exponentials, shifted by the largest."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax(values: Column) -> Column:
    whole = logsumexp(values)
    return F.transform(values, lambda x: F.exp(x - whole))


def magnitude(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def direction_bin(dx: Column, dy: Column, bins: int = 8) -> Column:
    """The bin of a displacement's angle from 0 to 2 pi; the last one takes what rounding would put beyond it."""
    turn = F.pmod(F.atan2(dy, dx) + 2 * math.pi, F.lit(2 * math.pi))
    return F.least(F.floor(turn / (2 * math.pi) * bins), F.lit(bins - 1)).cast("int")


def quantised(value: Column, top: float | Column, at: int = 96, most: int = 255) -> Column:
    """A value as a byte, scaled so that `top`, a number or a column, becomes `at`."""
    scale = at / F.greatest(top, F.lit(1e-3)) if isinstance(top, Column) else F.lit(at / max(top, 1e-3))
    return F.least(F.lit(most), F.round(value * scale)).cast("int")


def clock(time: Column) -> Column:
    """A timestamp's time of day, HH:MM:SS."""
    return F.date_format(time, "HH:mm:ss")


def alarm_line(time: Column, frame: Column, score: Column, threshold: float | Column) -> Column:
    """What a live run prints for an alarm: when, which frame, and the score as a multiple of the threshold."""
    return F.format_string("[%s] frame %d: ALARM score/thr=%.2f", clock(time), frame, score / threshold)
