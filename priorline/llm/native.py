"""Column expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII blanks, as a character list for translate() and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside lambdas an expression would be computed for each element."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII blanks."""
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def windows(hashes: Column, size: int) -> Column:
    """A hash for each run of ``size`` neighbours in an array of hashes; empty where there are fewer."""
    return F.when(
        F.size(hashes) >= size,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))
