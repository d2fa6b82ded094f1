"""Matches with their places in a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,match:string>>"
_BLOCK = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern that don't overlap, with their starts from 0. The pieces between the matches give the
    places: running sums by blocks of `_BLOCK`, as appending to an array in a fold copies it each time. Texts without a
    match cost one search."""

    def place(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: F.length(F.element_at(x["p"], i + 1)) + F.length(m))

        def spans(n: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / _BLOCK).cast("int")), lambda b: _sum(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))

            def one(s: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    b = F.floor(i / _BLOCK).cast("int")
                    end = _sum(F.slice(s, F.lit(1), b)) + _sum(F.slice(n, b * _BLOCK + 1, i % _BLOCK + 1))
                    return F.struct((end - F.length(m)).alias("start"), m.alias("match"))

                return F.transform(x["m"], span)

            return F.element_at(F.transform(F.array(sums), one), 1)

        return F.element_at(F.transform(F.array(lengths), spans), 1)

    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(both), place), 1)).otherwise(F.array().cast(SPANS))


def starred(text: Column, spans: Column) -> Column:
    """The text with the spans (start, stop), which may overlap, as asterisks. Spans are sorted, and each adds the text
    since the furthest end so far."""

    def join(s: Column) -> Column:
        done = lambda i: F.coalesce(F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda x: x["stop"])), F.lit(0))

        def piece(x: Column, i: Column) -> Column:
            return F.element_at(F.transform(F.array(done(i)), lambda d: F.concat(F.substring(text, d + 1, F.greatest(x["start"] - d, F.lit(0))), F.repeat(F.lit("*"), F.greatest(x["stop"] - F.greatest(x["start"], d), F.lit(0))))), 1)

        return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(text, done(F.size(s)) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(F.array_sort(spans)), join), 1)).otherwise(text)
