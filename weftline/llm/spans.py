"""Pattern matches with their places, as column expressions: no Python runs on the rows.

Spark gives matches without places. Where matches cannot be empty, the text between them is what a split by the same pattern gives, so places are running sums
of lengths, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All leftmost non-overlapping matches, or a group of each."""
    return F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(group))


def gaps(text: Column, pattern: str | Column) -> Column:
    """What stands before, between and after the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b, none: int = 0) -> Column:
    """The sums of an array of whole numbers up to each place, or what else combine makes of two of them, none being neutral. Each step takes in what lies
    1, 2, 4, ... places before, so n places take log n passes."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(
        steps, F.transform(values, lambda v: v.cast("long")),
        lambda acc, k: F.transform(acc, lambda v, i: combine(v, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(none).cast("long")))),
    )


def starts(gap: Column, match: Column) -> Column:
    """The code point at which each match starts."""
    ends = running(F.zip_with(F.slice(gap, 1, F.size(match)), match, lambda g, m: F.length(g) + F.length(m)))
    return F.zip_with(ends, match, lambda e, m: (e - F.length(m)).cast("int"))


def where_found(text: Column, pattern: str, value: Column) -> Column:
    """value where the text has a match; it is not evaluated for the others, whose array is empty."""
    return F.when(text.rlike(pattern), value)
