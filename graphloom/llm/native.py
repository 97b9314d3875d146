"""Column expressions for whole texts: regex matches with their places, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block of the two-level prefix sums.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times, also within lambdas."""
    return F.transform(F.array(value), body)[0]


def running(a: Column) -> Column:
    """Exclusive prefix sums of an int array, in blocks, so that long arrays stay cheap."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda s, x: s + x),
    )

    def with_bases(bases: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return F.get(bases, b) + F.aggregate(F.slice(a, b * BLOCK + 1, i - b * BLOCK), F.lit(0), lambda s, y: s + y)

        return F.transform(a, at)

    return let(blocks, lambda s: let(F.transform(s, lambda x, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda t, y: t + y)), with_bases))


def running_max(a: Column) -> Column:
    """Inclusive running maxima of an int array, in blocks."""

    def of(a: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(tops, lambda t: F.transform(t, lambda x, b: F.array_max(F.slice(t, F.lit(1), b))))

        def at(before: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return F.greatest(F.get(before, b), F.array_max(F.slice(a, b * BLOCK + 1, i - b * BLOCK + 1)))

        return let(before, lambda t: F.transform(a, lambda x, i: at(t, i)))

    return let(a, of)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found), in code points, end exclusive.

    The pattern must not match the empty text.
    """

    def placed(g: Column, m: Column) -> Column:
        sizes = F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x))

        def build(before: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(g, i))
                return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("found"))

            return F.transform(m, one)

        return let(sizes, lambda a: let(running(a), build))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda g: placed(g, m)))


def replace(text: Column, pattern: Column, change: Callable[[Column], Column]) -> Column:
    """struct(matches as array, their replacements as array, the text with these)."""

    def build(g: Column, m: Column, r: Column) -> Column:
        joined = F.array_join(F.transform(g, lambda x, i: F.concat(x, F.coalesce(F.get(r, i), F.lit("")))), "")
        return F.struct(m.alias("found"), r.alias("made"), joined.alias("text"))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: let(F.transform(m, change), lambda r: let(F.split(text, pattern, -1), lambda g: build(g, m, r))))
