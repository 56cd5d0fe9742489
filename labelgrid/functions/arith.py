"""Division rules and repeatable uniforms shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smart_div(num: Column, den: Column) -> Column:
    """0/0 is 1 (nothing to find, nothing claimed); K/0 is NULL."""
    return F.when((num == 0) & (den == 0), F.lit(1e0)).when(den != 0, num / den)


def ratio(num: Column, den: Column) -> Column:
    """Plain division, NULL where the denominator is 0."""
    return F.when(den != 0, num / den)


def harmonic(p: Column, r: Column, eps: float = 1e-14) -> Column:
    """2PR / max(P + R, eps)."""
    return 2 * p * r / F.greatest(p + r, F.lit(eps))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the key columns.

    The first 32 bits of an MD5 digest: the same on every engine, partitioning
    and retry, so a lost task draws again what it drew before.
    """
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296e0)


def total(cols: list[Column]) -> Column:
    """Sum of columns as one expression (kept inside code generation)."""
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out
