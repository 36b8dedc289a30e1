"""Column expressions shared by the operators; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(x: Column) -> Column:
    """Rounds to a whole number, halves to the even one (2.5 gives 2)."""
    return F.bround(x, 0).cast("long")


def is_infinite(x: Column | str) -> Column:
    return F.abs(col(x)) == F.lit(INFINITY)


def finite(x: Column | str) -> Column:
    """The value as a double; null for null, NaN and both infinities."""
    d = col(x).cast("double")
    return F.when(~F.isnan(d) & ~is_infinite(d), d)


#: The characters that count as white space at a text's ends, blanks of all widths and separators too.
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def stripped(x: Column | str) -> Column:
    """Text without any Unicode white space at its ends (trim() takes blanks only)."""
    return F.regexp_replace(col(x).cast("string"), f"^[{WHITE}]+|[{WHITE}]+$", "")


def own_name(taken: Iterable[str], name: str) -> str:
    """The name for a column of an operator's own: one that no column has, whatever its case."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def order_key(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible shuffle: the md5 of the seed and the row's key, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible draw in [0, 1) from the first 13 hex digits of order_key()."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def path_part(path: Column | str, from_end: int) -> Column:
    """A part of a path, counted from its end (1: the file's name, 2: its folder)."""
    return F.element_at(F.split(col(path), "/"), -from_end)


def as_number(x: Column | str) -> Column:
    """A number from text, null where it is none."""
    return col(x).try_cast("double")


def parsed_time(x: Column | str, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "d/M/yyyy h:mm:ss a", "d/M/yyyy H:mm", "yyyy-MM-dd")) -> Column:
    """The time that the first fitting format reads, else null."""
    return F.coalesce(*[F.try_to_timestamp(col(x), F.lit(f)) for f in formats])
