"""Small column helpers: binding, Python-like white space, seeded ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.isspace() holds for white space, as the inside of a regular expression's class.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What str.isdigit() holds for a digit, likewise.
DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: it becomes a lambda's argument, so a body may use it many times.

    Nested plain columns would double the expression with every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The same white space as characters: trimming by a set only looks at a text's ends, a regular expression at all of it.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def falsy(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def seeded_rank(key: Column, seed: int, salt: str = "") -> Column:
    """A pseudo-random order that follows from key, seed and salt alone, on any partitioning and in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")))


def seeded_number(key: Column, seed: int, salt: str, below: Column | int) -> Column:
    """A pseudo-random number from 0 up to `below`."""
    digits = F.conv(F.substring(seeded_rank(key, seed, salt), 1, 15), 16, 10).cast("long")
    return digits % (F.lit(below) if isinstance(below, int) else below)
