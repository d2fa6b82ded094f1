"""Matches with their places in a text, as Spark SQL expressions: nothing leaves the JVM and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,rank:int,kind:string,stop:int,match:string>>"
_BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """The leftmost matches of a pattern that don't overlap, as SPANS in code points, stop exclusive.

    The pieces between the matches and the matches themselves give the places, as sums over blocks of pieces, so
    that a text with very many matches isn't summed from its start for each of them.
    """

    def place(x: Column) -> Column:
        lengths = F.zip_with(x["pieces"], x["found"], lambda p, m: F.char_length(p) + F.coalesce(F.char_length(m), F.lit(0)))
        blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / _BLOCK).cast("int")), lambda b: total(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))

        def spans(s: Column) -> Column:
            def one(b: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    block = F.floor(i / _BLOCK).cast("int")
                    at = total(F.slice(b, F.lit(1), block)) + total(F.slice(s, block * _BLOCK + 1, i % _BLOCK)) + F.char_length(F.element_at(x["pieces"], i + 1))
                    return F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + F.char_length(m)).alias("stop"), m.alias("match"))

                return F.transform(x["found"], span)

            return let(blocks(s), one)

        return F.when(F.size(x["found"]) > 0, let(lengths, spans)).otherwise(F.lit(None).cast(SPANS))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.coalesce(let(both, place), F.array().cast(SPANS)).cast(SPANS)


def guarded(text: Column, guard: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """matches() where the cheap guard holds, which must hold wherever the pattern matches and `keep` is true."""
    found = matches(text, pattern, kind, rank)
    return F.when(guard, F.filter(found, keep) if keep else found).otherwise(F.array().cast(SPANS))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; the spans are sorted by start and rank."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span, sorted by start, replaced by the mark; spans that overlap are replaced as one. Each span
    adds the text since the furthest end so far, so the text is put together once."""
    end = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s["stop"])), F.lit(0))

    def piece(s: Column, i: Column) -> Column:
        return let(end(i), lambda d: F.when(s["start"] >= d, F.concat(F.substring(text, d + 1, s["start"] - d), F.lit(mark))).otherwise(F.lit("")))

    whole = F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, end(F.size(spans)) + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
