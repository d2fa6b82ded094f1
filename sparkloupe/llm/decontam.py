"""Benchmark decontamination by template canonicalisation.

Words become tokens; numbers, units and names become typed placeholders and leave their values in slots. Windows of
`WINDOW` tokens of documents and benchmark items are joined by hash, and the matches of a document and an item with
the same shift between their positions are checked for slot consistency: equal values of the item must have become
equal values of the document. That catches questions asked again with other numbers or names, and leaves alone texts
that only share a form.

A window is rich if enough of its tokens are plain words, thin if some are. A document holds an item if `COVERAGE` of
the item's rich windows match consistently, or if `THIN_COVERAGE` of all its windows do in one alignment. Windows that
aren't rich are joined by their lower-cased words, too, so that items of numbers, units and names are found where they
are copied.

Scale: documents are read once, whole, without a shuffle. A document's windows leave the scan only where a Bloom filter
of the benchmark's, 32 MB at most whatever the benchmark's size, holds their hash; the join confirms. Candidate pairs
come from an item's rarer windows only, so many of them that every match of `COVERAGE` holds one: a stock phrase of
very many items doesn't pair all of them with all documents that hold it. Nothing is broadcast but the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Workspace, tune

WINDOW = 8
#: Words that aren't placeholders which a window needs, as a share.
CONTENT = 0.6
#: Share of an item's windows that a document must hold consistently.
COVERAGE = 0.3
#: Share of all windows, in one alignment, that a document must hold consistently if they aren't rich; plain words the item needs.
THIN_COVERAGE, THIN_WORDS = 0.8, 2
#: The filter's size as a power of two: bits a window, and the most.
FILTER_BITS, FILTER_MOST = 6, 28
CACHE = 200_000

#: Units that become a placeholder.
UNITS = frozenset("mm cm m km in ft yd mi mile miles metre metres meter meters g kg mg lb lbs oz ton tons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years l ml litre litres liter liters gallon gallons percent % dollar dollars euro euros cent cents usd eur gbp mph kmh km/h degrees celsius fahrenheit watt watts volt volts joule joules hz khz mhz ghz kb mb gb tb".split())
_NUMBER = re.compile(r"[+-]?\d[\d.,:/-]*")
_MEASURE = re.compile(r"[+-]?\d[\d.,]*[^\W\d_]{1,4}")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
WORD, NUMBER, UNIT, NAME, NONE = range(5)
_KINDS, _ENDS, _KEEP = np.uint64(7), np.uint64(8), np.uint64((1 << 64) - 16)


class Tokens(dict):
    """A word's token: a hash in the upper 60 bits, then whether it ends a sentence, then its kind. Kept in a bounded cache."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        core = _EDGE.sub("", word)
        if not core:
            kind, text = (UNIT, "") if word.strip("()[],.;") == "%" else (NONE, "")
        elif _NUMBER.fullmatch(core) or _MEASURE.fullmatch(core):
            kind, text = NUMBER, ""
        elif core.lower() in UNITS:
            kind, text = UNIT, ""
        else:
            kind, text = (NAME if core[0].isupper() and not core.isupper() else WORD), core.lower()
        out = xxhash.xxh64_intdigest(text or str(kind)) & ~15 | (8 if word.rstrip("\"')]")[-1:] in ".!?:" else 0) | kind
        self[word] = out
        return out


def canonical(text: str, tokens: Tokens, exact: bool = False) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """(hashes, kinds, words, own, plain) of the tokens of a text; a name that starts a sentence is a word, as any word
    can. own: hashes where names are words. plain, if exact: the hashes of the lower-cased words, without and with the
    signs before each."""
    words = text.split()
    codes = np.array([tokens[w] for w in words], "u8")
    kinds = (codes & _KINDS).astype("i1")
    there = kinds != NONE
    ends = np.concatenate(([True], (codes[:-1] & _ENDS) > 0))
    kinds[(kinds == NAME) & ends] = WORD
    own = codes & _KEEP
    hashes = own.copy()
    hashes[kinds == NAME] = np.uint64(16 * NAME)
    at = np.flatnonzero(there)
    plain = None
    if exact:
        bare = own.copy()
        for i in np.flatnonzero((kinds == NUMBER) | (kinds == UNIT)).tolist():
            bare[i] = xxhash.xxh64_intdigest(_EDGE.sub("", words[i]).lower() or "%")
        signed = bare.copy()
        signs = np.flatnonzero(~there)
        for i, k in zip(signs.tolist(), np.searchsorted(at, signs).tolist(), strict=True):
            if k < len(at):
                signed[at[k]] = np.uint64(xxhash.xxh64_intdigest(words[i], int(signed[at[k]])))
        plain = bare[at], signed[at]
    return hashes[at], kinds[at], [words[i] for i in at.tolist()] if len(at) < len(words) else words, own[at], plain


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), "u8")
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def windows(hashes: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, rich) of each window of this many tokens that has a word of its own; rich: has enough of them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, bool)
    own = np.concatenate(([0], np.cumsum(kinds == WORD)))
    count = own[size:] - own[:-size]
    at = np.flatnonzero(count)
    return _fold([hashes[i : i + n] for i in range(size)])[at], at, count[at] >= CONTENT * size


def named(hashes: np.ndarray, kinds: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each window that starts with a name, with the name as a word: an item's first token is one."""
    at = np.flatnonzero(kinds[: max(0, len(kinds) - size + 1)] == NAME)
    return _fold([own[at], *(hashes[at + i] for i in range(1, size))]), at


def verbatim(plain: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each window by its words and the signs between them."""
    bare, signed = plain
    n = len(bare) - size + 1
    if n <= 0:
        return np.empty(0, "u8"), np.empty(0, "i8")
    return _fold([bare[:n], *(signed[i : i + n] for i in range(1, size))]), np.arange(n)


def _slots(words: list[str], kinds: np.ndarray, start: int, size: int) -> list[str]:
    return [_EDGE.sub("", words[i]).lower() for i in range(start, start + size) if kinds[i] != WORD]


#: Added to the size of windows that are joined by their words.
_VERBATIM = 32
_ROW = "id long, hash long, start int, size int, slots array<string>"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
_ITEM = f"{_ROW}, rich boolean, own int, total int, words int"
_ITEM_TYPES = (*_TYPES, pa.bool_(), pa.int32(), pa.int32(), pa.int32())


def _batch(rows: list[tuple], schema: str, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f.strip().split(" ")[0] for f in schema.split(",")])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to its windows; an item shorter than a window is one window. own: rich windows; total: all places;
    words: plain words of the item."""
    tokens = Tokens()
    for batch in batches:
        rows = []
        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes, kinds, words, _, plain = canonical(text or "", tokens, True)
            size = min(WINDOW, len(words))
            if size >= 3:
                found, at, rich = windows(hashes, kinds, size)
                rest, places = verbatim(plain, size)
                counts = (int(rich.sum()), len(places), int((kinds == WORD).sum()))
                rows += [(item, h, a, size, _slots(words, kinds, a, size), r, *counts) for h, a, r in zip(found.view("i8").tolist(), at.tolist(), rich.tolist(), strict=True)]
                left = np.setdiff1d(places, at[rich])
                rows += [(item, h, a, size + _VERBATIM, [], False, *counts) for h, a in zip(rest[left].view("i8").tolist(), left.tolist(), strict=True)]
        yield _batch(rows, _ITEM, _ITEM_TYPES)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = []
        for places in batch.column(1).to_pylist():
            page = np.zeros(1 << 16, bool)
            page[places] = True
            pages.append(np.packbits(page, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.binary())], ["page", "bits"])


def _filter(known: DataFrame) -> np.ndarray:
    """A Bloom filter of known(hash), two bits a window, packed; made page by page in the executors."""
    size = 1 << min(FILTER_MOST, max(16, FILTER_BITS + known.count().bit_length()))
    both = F.explode(F.array(F.col("hash").bitwiseAND(size - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(size - 1)))
    pages = known.select(both.alias("bit")).select(F.col("bit").cast("int")).groupBy(F.shiftright("bit", 16).alias("page")).agg(F.collect_set(F.col("bit").bitwiseAND(65535)).alias("at"))
    out = np.zeros(size >> 3, "u1")
    for row in pages.mapInArrow(_pages, "page int, bits binary").toLocalIterator():
        out[row["page"] << 13 : (row["page"] + 1) << 13] = np.frombuffer(row["bits"], "u1")
    return out


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the filter holds."""
    mask = np.uint64(len(bits) * 8 - 1)
    out = np.arange(len(hashes))
    for shift in (0, 32):
        at = hashes[out] >> np.uint64(shift) & mask
        out = out[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).astype(bool)]
    return out


def _light(known: DataFrame) -> DataFrame:
    """known with `light`: whether a window is among so many of its item's rarest that every match of COVERAGE holds one."""
    held = known.groupBy("hash", "size").agg(F.countDistinct("item_id").alias("items"))
    ranked = known.join(held, ["hash", "size"])
    place = (F.col("size") > _VERBATIM) | F.col("rich")  # one row a place
    of, order = Window.partitionBy("item_id"), ["items", "item_start", "hash"]
    need = lambda n: F.ceil(F.col(n) * COVERAGE - 1e-9)
    for rank, rows, n in (("r", F.col("rich"), "own"), ("p", place, "total")):
        within = Window.partitionBy("item_id", rows).orderBy(*order)
        count = F.sum(rows.cast("int")).over(of)
        ranked = ranked.withColumn(rank, rows & (F.row_number().over(within) <= count - F.max(need(n)).over(of) + 1))
    at_place = F.max("p").over(Window.partitionBy("item_id", "item_start"))
    return ranked.withColumn("light", F.col("r") | at_place).drop("r", "p", "items")


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, name: str = "decontam") -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, exact) for each document of docs(doc_id, text) and item of
    items(item_id, text) that it holds; exact: with equal slots. The windows counted are the rich ones, or all of the
    item's where more of them match or the rich ones are too few.

    Null and empty texts match nothing. Items under three tokens are no items. Rows with equal ids count as one
    document or item. Rows whose id is null are left out. Other columns don't matter. An empty benchmark gives no row.
    """
    tune(spark)
    space = Workspace(spark, name)
    made = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(_item_windows, _ITEM)
    names = {"id": "item_id", "start": "item_start", "slots": "item_slots"}
    known = space.save(_light(made.withColumnsRenamed(names).distinct()), "items")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # 12 values at most
    shared = spark.sparkContext.broadcast((sizes, _filter(known)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        sizes, bits = shared.value
        exact = max(sizes, default=0) > _VERBATIM
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                hashes, kinds, words, own, plain = canonical(text, tokens, exact)
                for size in sizes:
                    ways = [verbatim(plain, size - _VERBATIM)] if size > _VERBATIM else [windows(hashes, kinds, size)[:2], named(hashes, kinds, own, size)]
                    for way, (found, at) in enumerate(ways):
                        maybe = _held(bits, found)
                        for h, a in zip(found[maybe].view("i8").tolist(), at[maybe].tolist(), strict=True):
                            rows.append((doc, h, a, size, [] if size > _VERBATIM else _slots(words, kinds, a + way, size - way)))
            yield _batch(rows, _ROW, _TYPES)

    seen = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _ROW)
    seen = space.save(seen.withColumnsRenamed({"id": "doc_id", "start": "doc_start"}), "seen")
    found = seen.select("doc_id", "hash", "size").distinct().join(known.where("light").select("item_id", "hash", "size").distinct(), ["hash", "size"])
    candidates = space.save(found.select("doc_id", "item_id").distinct(), "candidates")
    pairs = candidates.join(known, "item_id").join(seen, ["doc_id", "hash", "size"])

    shift = (F.col("doc_start") - F.col("item_start")).alias("shift")
    slots = lambda of: F.array_distinct(F.flatten(F.collect_set(F.when(of, F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))))))
    starts = lambda of: F.collect_set(F.when(of, F.col("item_start")))
    rich, formal = F.col("rich"), F.col("size") < _VERBATIM
    most = [F.max(c).alias(c) for c in ("own", "total", "words")]
    by_shift = pairs.groupBy("doc_id", "item_id", shift).agg(slots(rich).alias("slots"), slots(formal).alias("all_slots"), starts(rich).alias("starts"), starts(~formal).alias("others"), starts(F.lit(True)).alias("places"), *most)
    one_value = lambda s: F.size(F.array_distinct(F.transform(s, lambda x: x["a"]))) == F.size(s)
    equal = lambda s: F.forall(s, lambda x: x["a"].eqNullSafe(x["b"]))
    thin = one_value("all_slots") & (F.size("places") >= THIN_COVERAGE * F.col("total")) & (F.col("words") >= THIN_WORDS)
    by_shift = by_shift.withColumns({"fits": one_value("slots"), "thin": thin}).where(F.col("fits") | (F.size("others") > 0) | F.col("thin"))
    by_shift = by_shift.withColumn("starts", F.when(F.col("fits"), F.col("starts")).otherwise(F.array().cast("array<int>")))
    by_shift = by_shift.withColumn("exact", F.when(F.col("fits") & (F.size("starts") > 0), equal("slots")).when(F.col("thin"), equal("all_slots")).otherwise(F.size("others") > 0))
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    by_item = by_shift.groupBy("doc_id", "item_id").agg(union("starts").alias("starts"), union("others").alias("others"), F.max(F.when(F.col("thin"), F.size("places"))).alias("thin"), *most, F.max("exact").alias("exact"))
    own, both = F.size("starts"), F.size("starts") + F.size("others")
    counted = by_item.withColumn("all", (F.col("own") == 0) | (both * F.col("own") > own * F.col("total")))
    counted = counted.withColumns({"windows": F.when(F.col("all"), both).otherwise(own), "item_windows": F.when(F.col("all"), F.col("total")).otherwise(F.col("own"))})
    few = (F.col("windows") < COVERAGE * F.col("item_windows")) & F.col("thin").isNotNull()
    counted = counted.withColumns({"windows": F.when(few, F.col("thin")).otherwise(F.col("windows")).cast("long"), "item_windows": F.when(few, F.col("total")).otherwise(F.col("item_windows")).cast("long")})
    out = counted.withColumn("coverage", F.col("windows") / F.col("item_windows")).where(F.col("coverage") >= COVERAGE)
    return out.select("doc_id", "item_id", "windows", "item_windows", "coverage", "exact")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hits() of documents and benchmark: doc_id, item_id, windows, item_windows, coverage, exact."""
    return hits(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "op7")
