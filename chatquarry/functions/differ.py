"""Where two texts begin to differ. Native columns throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

#: Characters shown before and behind the place (fixed values).
BEFORE, BEHIND = 40, 80


def common_prefix(a: Column, b: Column) -> Column:
    """The number of characters that two texts begin with in common: halves are compared, 31 times at most."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s.lo + s.hi + 1) / 2).cast("int")
        same = F.left(a, middle) == F.left(b, middle)
        return F.when(s.lo >= s.hi, s).when(same, F.struct(middle.alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), (middle - 1).alias("hi")))

    shorter = F.least(F.length(a), F.length(b))
    rounds = F.sequence(F.lit(1), F.length(F.bin(shorter.cast("long"))) + 1)
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), shorter.alias("hi")), step, lambda s: s.lo)


def first_mismatch(a: Column, b: Column, before: int = BEFORE, behind: int = BEHIND) -> Column:
    """struct<place, kind, left, right> of the first character, from 0, in which two texts differ; null for equal ones.

    kind is `character`, or `length` where one text begins with the other; left and right are what stands around the
    place in each. Null differs from all but null: at place 0, of kind `null`.
    """
    around = lambda t, p: F.substr(F.coalesce(t, F.lit("")), F.greatest(p - before, F.lit(0)) + 1, F.least(p, F.lit(before)) + behind)

    def told(t: Column) -> Column:
        kind = F.when(t.a.isNull() | t.b.isNull(), "null").when(t.p == F.least(F.length(t.a), F.length(t.b)), "length").otherwise("character")
        place = F.coalesce(t.p, F.lit(0))
        return F.struct(place.alias("place"), kind.alias("kind"), around(t.a, place).alias("left"), around(t.b, place).alias("right"))

    found = let(F.struct(a.alias("a"), b.alias("b")), lambda t: let(F.struct(t.a.alias("a"), t.b.alias("b"), common_prefix(t.a, t.b).alias("p")), told))
    return F.when(a.eqNullSafe(b), None).otherwise(found)
