"""Options of command lines, one line or a column of them: `-name` alone is a flag, else it takes the words up to the next option.

A word that begins with a minus is an option, but for numbers and text, where a single value may be negative."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NUMBER, fields


def flag(line: Column, name: str) -> Column:
    """Whether the option is there."""
    return F.array_contains(fields(line), f"-{name}")


def text(line: Column, name: str, default: str | None = None) -> Column:
    """The word after the option, whatever it begins with."""
    words = fields(line)
    at = F.array_position(words, f"-{name}")
    return F.coalesce(F.when(at > 0, F.get(words, at.cast("int"))), F.lit(default))


def number(line: Column, name: str, default: float | None = None) -> Column:
    """The number after the option; null if it is none."""
    value = text(line, name)
    return F.when(value.isNull(), F.lit(default).cast("double")).when(value.rlike(NUMBER), F.regexp_replace(value, "[dD]", "e").cast("double"))


def whole(line: Column, name: str, default: int | None = None) -> Column:
    """The count after the option; a word that begins with a minus is the next option."""
    value = text(line, name)
    return F.when(value.isNull() | value.startswith("-"), F.lit(default).cast("long")).when(value.rlike(r"^\+?\d+$"), value.cast("long"))


def vector(line: Column, name: str) -> Column:
    """The numbers after the option, up to the next word that begins with a minus; null without the option or without any."""
    found = F.regexp_extract(F.concat(F.lit(" "), F.trim(line), F.lit(" ")), rf"\s-{re.escape(name)}((?:\s+[^-\s]\S*)+)\s", 1)
    return F.when(F.trim(found) != "", F.transform(fields(found), lambda x: x.cast("double")))


def hill_arguments(variables: int, periodic: dict[int, str], stride: int, kt: float, hills: str, surface: str = "fes.dat", only: list[int] | None = None) -> list[str]:
    """The arguments of a program that sums hills of a biased run to a free-energy surface: how many variables there are, which of them the surface has,
    their periods, the stride of the surfaces, kT, and the files."""
    only = list(range(1, variables + 1)) if only is None else only
    if bad := [v for v in (*only, *periodic) if not 1 <= v <= variables]:
        raise ValueError(f"no variables {bad} among {variables}")
    if len(only) not in (1, 2):
        raise ValueError("a surface has one or two variables")
    if stride < 0 or kt <= 0:
        raise ValueError("the stride is 0 or more, kT is positive")
    periods = [w for v in sorted(periodic) for w in (f"-{periodic[v]}", str(v))]
    return ["-ndim", str(variables), "-ndw", *map(str, only), *periods, "-stride", str(stride), "-kt", f"{kt:g}", "-file", hills, "-out", surface]
