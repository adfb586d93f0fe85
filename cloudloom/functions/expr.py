"""Expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = 1 << 20  # voxel indices lie in [-HALF, HALF)
MASK = (1 << 21) - 1


def voxel_index(coordinate: Column, size: float) -> Column:
    return F.floor(coordinate / F.lit(float(size))).cast("long")


def voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """Three voxel indices of 21 bits in one long, anchored at the origin; null outside the range."""
    i, j, k = (voxel_index(c, size) + HALF for c in (x, y, z))
    inside = i.between(0, MASK) & j.between(0, MASK) & k.between(0, MASK)
    return F.when(inside, F.shiftleft(i, 42).bitwiseOR(F.shiftleft(j, 21)).bitwiseOR(k))


def voxel_of(key: Column) -> tuple[Column, Column, Column]:
    """The indices that :func:`voxel_key` packed."""
    return tuple(F.shiftrightunsigned(key, s).bitwiseAND(F.lit(MASK).cast("long")) - HALF for s in (42, 21, 0))


def squared_distance(a: str, b: str, axes: str = "xyz") -> Column:
    """Of columns ``a`` + axis and ``b`` + axis."""
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in axes]
    out = d[0] * d[0]
    for x in d[1:]:
        out = out + x * x
    return out


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def colour_mean(total: Column, n: Column) -> Column:
    """Mean colour as a byte: half goes to even, then clipped."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(total / n))).cast("smallint")


def orientation(verticality: Column) -> Column:
    """vertical above 0.7, horizontal below 0.35, else oblique."""
    return F.when(verticality > 0.7, "vertical").when(verticality < 0.35, "horizontal").otherwise("oblique")


def angular_bin(dx: Column, dy: Column, bins: int, turn: float = 6.283185307179586) -> Column:
    return F.least(F.floor(F.pmod(F.atan2(dy, dx), F.lit(turn)) / F.lit(turn / bins)), F.lit(bins - 1)).cast("int")


def slug(text: Column) -> Column:
    """Lower-case letters, digits and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_|_$", "")


def longest_prefix(text: Column, keys: list[str]) -> Column:
    """The longest of ``keys`` that ``text`` begins with, in lower case; null if none does."""
    out = F.lit(None).cast("string")
    for key in sorted(keys, key=len):
        out = F.when(F.lower(text).startswith(key), key).otherwise(out)
    return out


def first_keyword(text: Column, ordered: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first (keyword, value) whose keyword the lower-case text holds: its first line decides before the rest."""
    low = F.lower(text)
    line = F.substring_index(low, "\n", 1)
    out = F.lit(otherwise)
    for part in (low, line):
        for word, value in reversed(ordered):
            out = F.when(part.contains(word), value).otherwise(out)
    return out


def version_of(name: Column) -> Column:
    """The number of a name that ends in _vN; null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, "_v([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int")
