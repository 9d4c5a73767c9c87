"""Flajolet-Martin bit strings of 32 bits, position 0 at the most significant bit, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.generators import draw

#: Fixed value: the correction factor of the estimate.
PHI = 0.77351


def fm_mask(node: Column, k: int) -> Column:
    """A mask with one bit: position j with probability 2^-(j+1), from the leading zeros of a 32-bit draw; at most 30."""
    zeros = 32 - F.length(F.bin(draw(node, F.lit(k))))
    return F.expr("1L") * F.pow(F.lit(2.0), (31 - F.least(F.lit(30), zeros)).cast("double")).cast("bigint")


def least_zero_pos(mask: Column) -> Column:
    """The position of the first zero bit from the top; 32 if all are ones."""
    free = F.lit((1 << 32) - 1) - mask
    return 32 - F.when(free == 0, 0).otherwise(F.length(F.bin(free)))


def fm_estimate(masks: list[Column]) -> Column:
    total = sum((least_zero_pos(m) for m in masks[1:]), least_zero_pos(masks[0]))
    return F.pow(F.lit(2.0), total / F.lit(float(len(masks)))) / F.lit(PHI)


def mask_hex(mask: Column) -> Column:
    return F.lower(F.hex(mask))


def mask_from_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")
