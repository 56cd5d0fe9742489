"""Conversions between enum, one-hot, multi-hot and bitmask labels of one pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CLASSES = 23  # 24 bits of an RGB pixel; the top one marks ambiguity


def enum_to_onehot(enum: Column, n: int, ignore_first: bool = False) -> Column:
    """One-hot array; with ``ignore_first`` the background collapses onto channel 0."""
    if ignore_first:
        k_of = F.least(F.greatest(enum - 1, F.lit(0)), F.lit(n))
        channels = n - 1
    else:
        k_of, channels = enum, n
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda k: (k == k_of).cast("int"))


def onehot_to_enum(vec: Column, one_indexed: bool = False) -> Column:
    """Argmax, lowest index on ties; ``one_indexed`` puts a background channel first."""
    if one_indexed:
        mass = F.aggregate(vec, F.lit(0e0), lambda a, v: a + v)
        background = F.least(F.greatest(1 - mass, F.lit(0e0)), F.lit(1e0))
        vec = F.concat(F.array(background), F.transform(vec, lambda v: v.cast("double")))
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def enum_to_multihot(enum: Column, n: int, ignore_first: bool = False, one_indexed: bool = False) -> Column:
    """Exact equality per channel; a background under ``ignore_first`` is all zeros."""
    shift = 1 if (ignore_first or one_indexed) else 0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k + shift == enum).cast("int"))


def multihot_to_bitmask(vec: Column) -> Column:
    """Sum of 2**k over the set channels."""
    bits = F.transform(vec, lambda v, k: F.when(v > 0, F.pow(F.lit(2e0), k)).otherwise(F.lit(0e0)))
    return F.aggregate(bits, F.lit(0e0), lambda a, b: a + b).cast("int")


def bitmask_to_multihot(mask: Column, n: int) -> Column:
    """Channel k is bit k of the mask."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.getbit(mask, k).cast("int"))


def bit_length(mask: Column) -> Column:
    """Number of channels a mask needs; the default ``n`` is the maximum over a table."""
    return F.when(mask > 0, F.length(F.bin(mask))).otherwise(F.lit(0))


def enum_to_bitmask(enum: Column) -> Column:
    """Class k >= 1 sets bit k-1, background sets none."""
    return F.when(enum > 0, F.pow(F.lit(2e0), enum - 1).cast("int")).otherwise(F.lit(0))


def bitmask_to_enum(mask: Column) -> Column:
    """Highest set bit, counted from 1; 0 for an empty mask."""
    return bit_length(mask).cast("int")


def pack_bits_rgb(mask: Column) -> Column:
    """The three bytes of a mask, low byte first."""
    return F.struct(*[
        F.shiftright(mask, 8 * i).bitwiseAND(F.lit(255)).alias(name) for i, name in enumerate(("b0", "b1", "b2"))
    ])


def unpack_bits_rgb(b0: Column, b1: Column, b2: Column) -> Column:
    """Inverse of :func:`pack_bits_rgb`."""
    return b0 + F.shiftleft(b1, 8) + F.shiftleft(b2, 16)


def parse_weight_list(text: Column) -> Column:
    """``"5,1,.5"`` as an array of doubles, one per class; a blank entry is NULL."""
    return F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double"))
