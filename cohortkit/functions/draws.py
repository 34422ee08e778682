"""Keyed random draws as Column expressions.

Every draw is a pure function of (seed, entity key, purpose): an md5 over ``seed|key...|purpose``
gives 128 bits, sliced into four unsigned 32-bit integers ("slots"). Results therefore do not
depend on partitioning, task retries or row order, and the same numbers can be recomputed by
any SQL engine with ``md5`` and hex parsing. ``F.rand`` is not used: it depends on partitioning.
"""

from __future__ import annotations

import math
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def key_md5(seed, *parts) -> Column:
    """Hex md5 of ``seed|part1|part2|...`` (parts are Columns or literals)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_part(p) for p in parts]))


def slot(md5hex: Column, i: int = 0) -> Column:
    """Unsigned 32-bit integer from hex characters ``8i+1 .. 8i+8`` of an md5 string."""
    return F.conv(F.substring(md5hex, 8 * i + 1, 8), 16, 10).cast("bigint")


def uniform(h: Column) -> Column:
    """Uniform double in (0, 1) from a 32-bit integer."""
    return (h + F.lit(0.5)) / F.lit(TWO_32)


def randint(h: Column, lo: int, hi: int) -> Column:
    """Integer in [lo, hi], both ends included (R2)."""
    return (F.lit(lo) + h % F.lit(hi - lo + 1)).cast("int")


def choice(values: Column, h: Column) -> Column:
    """Uniform choice from an array column."""
    return F.element_at(values, (h % F.size(values) + 1).cast("int"))


def bernoulli(h: Column, p: float) -> Column:
    """True with probability ``p``."""
    return uniform(h) < F.lit(p)


def normal_int(h1: Column, h2: Column, mean: float, sd: float, floor: int) -> Column:
    """``max(floor, int(normal(mean, sd)))`` via Box-Muller; int() truncates toward zero."""
    z = F.sqrt(F.lit(-2.0) * F.log(uniform(h1))) * F.cos(F.lit(2.0 * math.pi) * uniform(h2))
    return F.greatest(F.lit(floor), (F.lit(float(mean)) + F.lit(float(sd)) * z).cast("int"))


def sample_without_replacement(values: Column, k: Column, seed, *key_parts) -> Column:
    """First ``k`` of ``values`` ordered by a per-key, per-value hash (R7, prompt examples)."""
    keyed = F.transform(values, lambda v: F.struct(key_md5(seed, *key_parts, v).alias("h"), v.alias("v")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["v"]), 1, k)


def surrogate_id(prefix: str, seed, parts: Iterable) -> Column:
    """Repeatable surrogate id ``prefix + md5(seed:part:...)``."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws(":", F.lit(str(seed)), *[_part(p) for p in parts])))
