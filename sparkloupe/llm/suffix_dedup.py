"""Repeated byte strings, by a depth-limited radix sort of suffixes.

Only the first `THRESHOLD` bytes of a suffix are ordered. The most significant digit is an anchor: the window of
`THRESHOLD` bytes from a suffix has one k-gram with the least hash, which equal windows share at the same offset
(a minimizer). Suffixes whose anchor occurs once can't repeat and leave after this first pass, which carries 8-byte
hashes of about 3 % of the positions instead of every suffix. The suffixes left are grouped by (anchor, offset) and
ordered digit by digit of 8 bytes; after each pass, groups of one leave. The groups equal through all digits are
exactly the repeated windows, compared byte by byte.

Scale: equal texts count once (grouped by SHA-256 before all else). Counts of anchors are combined before the shuffle;
anchors are joined back by hash, where AQE splits hot keys. Each anchor occurrence carries the bytes that windows
around it can cover, and equal surroundings are settled without ordering their suffixes. The occurrences of an anchor
that has more than `GROUP` of them are dealt evenly and take all remaining digits at once, as grouped minima, which
are combined before the shuffle: no task holds a hot anchor. Both ways give the same rows. The shuffle files of each
step are deleted when its table is written. Joins are merges by hint: Spark goes by the compressed size of a saved table,
and would gather some ten times that in the driver to broadcast it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace, tune

THRESHOLD = 100
ANCHOR = 32
SIDE = THRESHOLD - ANCHOR  # bytes on either side of an anchor that a window around it can reach
WIDTH = 2 * SIDE + ANCHOR
GROUP = 1 << 15
CHUNK = 1 << 20
ROWS = 1 << 13
LAST = (1 << 63) - 1


def _slide(values: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each run of `width` values, in linear time: out[i] is of values[i : i + width]."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, fill, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def _gram_hashes(data: bytes) -> np.ndarray:
    """A hash over 1 of each ANCHOR bytes."""
    n = len(data) - ANCHOR + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.zeros(n, "u8")
    for at in range(0, ANCHOR, 8):
        out = (out ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out | np.uint64(1)


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the anchors of each text: of every window of THRESHOLD bytes, the k-grams with the least hash."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    part: list[tuple[int, int, bytes]] = []
    held = 0

    def work() -> None:
        nonlocal part, held
        data = b"".join(x[2] for x in part)
        if len(data) >= THRESHOLD:
            grams = _gram_hashes(data)
            least = _slide(grams, SIDE + 1, np.minimum, np.iinfo("u8").max)
            starts = np.cumsum([0] + [len(x[2]) for x in part])
            for end in starts[1:-1]:  # windows across texts don't count
                least[max(0, end - THRESHOLD + 1) : end] = 0
            reach = _slide(np.concatenate((np.zeros(SIDE, "u8"), least, np.zeros(SIDE, "u8"))), SIDE + 1, np.maximum, 0)
            at = np.flatnonzero(grams == reach)
            cut = np.searchsorted(at, starts)
            for i, (text, offset, _) in enumerate(part):
                mine = at[cut[i] : cut[i + 1]]
                found[text].append((mine - starts[i] + offset, grams[mine]))
        part, held = [], 0

    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - THRESHOLD + 1), CHUNK):
            piece = text[offset : offset + CHUNK + THRESHOLD - 1]
            if len(piece) >= THRESHOLD:
                part.append((i, offset, piece))
                held += len(piece)
                if held >= CHUNK:
                    work()
    if part:
        work()
    out = []
    for pieces in found:
        at = np.concatenate([p for p, _ in pieces] or [np.empty(0, "i8")])
        at, first = np.unique(at, return_index=True)
        out.append((at, np.concatenate([h for _, h in pieces] or [np.empty(0, "u8")])[first]))
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        pairs = anchors([t or b"" for t in batch.column(1).to_pylist()])
        sizes = [len(p) for p, _ in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for _, h in pairs] or [np.empty(0, "u8")]).view("i8")), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([p for p, _ in pairs] or [np.empty(0, "i8")]).astype("i4"))], ["gram", "content", "pos"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, sub, positions, text) to a row for each anchor with the bytes that windows around it can cover; the
    positions of hot anchors come as -1 - position."""
    for batch in batches:
        for doc, sub, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = sorted(at, key=lambda p: max(p, -1 - p))
            hot = [p < 0 for p in at]
            at = [max(p, -1 - p) for p in at]
            grams = np.array([xxhash.xxh64_intdigest(text[p : p + ANCHOR]) for p in at], "u8").view("i8")
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(n, doc, "i8")), pa.array(np.full(n, sub, "i4")), pa.array(at, pa.int32()), pa.array([min(p, SIDE) for p in at], pa.int32()), pa.array([text[max(0, p - SIDE) : p + ANCHOR + SIDE] for p in at], pa.binary()), pa.array(hot, pa.bool_())], [*NAMES, "hot"])


NAMES = ["gram", "doc", "sub", "pos", "before", "bytes"]
SETTLED = "gram long, doc long, sub int, pos int, before int, bytes binary"
OCCURRENCE = f"{SETTLED}, hot boolean"


def repeated(run: np.ndarray, before: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of anchor occurrences, in order of run and then of position in the corpus: (row, first, last) where the
    windows from `first` to `last` of that row's bytes start earlier, too."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), "i8", n)
    whole = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), "u8", n)
    order = np.lexsort((np.arange(n), whole, sizes, before, run))
    same = np.zeros(n, bool)
    a, b = order[:-1], order[1:]
    same[b] = (run[a] == run[b]) & (before[a] == before[b]) & (whole[a] == whole[b])
    same[b[same[b]]] = [texts[i] == texts[j] for i, j in zip(a[same[b]].tolist(), b[same[b]].tolist(), strict=True)]
    copies = np.flatnonzero(same & (sizes >= THRESHOLD))
    out = [(copies, np.zeros(len(copies), "i8"), sizes[copies] - THRESHOLD)]
    rows = np.flatnonzero(~same & (sizes >= THRESHOLD))
    rows = rows[np.isin(run[rows], run[rows[1:]][run[rows[1:]] == run[rows[:-1]]])] if len(rows) else rows
    starts = np.flatnonzero(np.concatenate(([True], run[rows[1:]] != run[rows[:-1]]))) if len(rows) else np.empty(0, "i8")
    part = np.unique(starts // ROWS, return_index=True)[1] if len(starts) else np.empty(0, "i8")
    for piece in np.split(rows, starts[part[1:]]) if len(rows) else []:  # about ROWS at a time, no run cut
        out.append(_radix(piece, run, before, texts))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _radix(rows: np.ndarray, run: np.ndarray, before: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the windows of these rows; an equal group's first row is where it starts first."""
    padded = np.frombuffer(b"".join((b"\0" * (SIDE - int(before[i])) + texts[i]).ljust(WIDTH, b"\0") for i in rows.tolist()), "u1").reshape(len(rows), WIDTH)
    digits = np.ndarray((len(rows), WIDTH - 7), ">u8", padded.tobytes(), strides=(WIDTH, 1)).astype("u8")
    low = SIDE - before[rows]
    high = low + np.fromiter((len(texts[i]) for i in rows.tolist()), "i8", len(rows)) - THRESHOLD
    counts = high - low + 1
    row = np.repeat(np.arange(len(rows)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    _, label = np.unique(run[rows], return_inverse=True)
    group = label[row] * (SIDE + 1) + start
    for at in [*range(0, THRESHOLD - 7, 8), THRESHOLD - 8]:
        digit = digits[row, start + at]
        order = np.lexsort((digit, group))
        group, digit, row, start = group[order], digit[order], row[order], start[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))) if len(row) else np.empty(0, bool)
        group = np.cumsum(new)
        keep = ~(new & np.append(new[1:], True)) if len(row) else new
        group, row, start = group[keep], row[keep], start[keep]
    order = np.lexsort((row, group))
    group, row, start = group[order], row[order], start[order]
    later = np.concatenate(([False], group[1:] == group[:-1])) if len(row) else np.empty(0, bool)
    row, start = row[later], start[later]
    if not len(row):
        return (np.empty(0, "i8"),) * 3
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.concatenate(([True], row[1:] != row[:-1]))
    last = np.append(first[1:], True)
    at = row[first]
    return rows[at], start[first] - low[at], start[last] - low[at]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by hot, gram, doc, sub, pos: covered ranges (pos, before as start, end; bytes null), and
    unchanged the occurrences of hot anchors."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, doc, sub, pos, before = (table.column(i).to_numpy() for i in range(5))
        texts = table.column(5).to_pylist()
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (pos[1:] != pos[:-1])))
        if not new.all():  # the same row of the input, twice
            gram, doc, sub, pos, before, texts = gram[new], doc[new], sub[new], pos[new], before[new], [t for t, k in zip(texts, new.tolist(), strict=True) if k]
        row, first, last = repeated(gram, before.astype("i8"), texts)
        start = pos[row] - before[row] + first
        yield pa.RecordBatch.from_arrays([pa.array(gram[row]), pa.array(doc[row]), pa.array(sub[row]), pa.array(start.astype("i4")), pa.array((start + last - first + THRESHOLD).astype("i4")), pa.nulls(len(row), pa.binary())], NAMES)

    for batch in batches:
        cold = int(np.count_nonzero(~batch.column(6).to_numpy(zero_copy_only=False)))
        batch = batch.select(range(6))
        if cold < batch.num_rows:
            yield batch.slice(cold)
        if not cold:
            continue
        held.append(batch.slice(0, cold))
        rows += cold
        if rows < 2 * ROWS:
            continue
        table = pa.Table.from_batches(held)
        gram = table.column(0).to_numpy()
        cut = int(np.searchsorted(gram, gram[-1], "left"))
        if cut:
            yield from work(table.slice(0, cut))
        held, rows = table.slice(cut).combine_chunks().to_batches(), len(gram) - cut
    if rows:
        yield from work(pa.Table.from_batches(held))


def _by_minima(over: DataFrame, space: Workspace) -> DataFrame:
    """Covered ranges (doc, sub, start, end) among the occurrences of hot anchors. The minima are saved before they are
    joined back, as AQE splits a hot key only of joins between plain shuffles."""
    key = ["gram", "before", "bytes"]
    over = over.withColumn("at", F.struct("doc", "sub", "pos"))
    firsts = space.save(over.groupBy(*key).agg(F.min("at").alias("first")).where(F.length("bytes") >= THRESHOLD), "firsts")
    begin = F.col("pos") - F.col("before")
    copies = over.join(firsts.hint("merge"), key).where("at > first").select("doc", "sub", begin.alias("start"), (begin + F.length("bytes")).alias("end"))
    windows = firsts.select(*key, "first", F.explode(F.sequence(F.lit(0), F.length("bytes") - THRESHOLD)).alias("s"))
    windows = windows.select("gram", "first", "before", "s", (F.col("before") - F.col("s")).alias("offset"), F.substring("bytes", F.col("s") + 1, F.lit(THRESHOLD)).alias("window"))
    lows = windows.groupBy("gram", "offset", "window").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").drop("high")
    lows = space.save(lows, "minima")
    begin = F.col("first.pos") - F.col("before")
    covered = windows.join(lows.hint("merge"), ["gram", "offset", "window"]).where("first > low").groupBy("first", "before").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return copies.union(covered.select("first.doc", "first.sub", begin + F.col("low"), begin + F.col("high") + THRESHOLD))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, copy, ranges) to the counts and the hash of what is left."""
    for batch in batches:
        rows = []
        for doc, text, copy, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or b""
            runs: list[list[int]] = []
            if copy and len(text) >= THRESHOLD:
                runs = [[0, len(text)]]
            elif ranges:
                for r in sorted((r["start"], r["end"]) for r in ranges):
                    if runs and r[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r[1])
                    else:
                        runs.append(list(r))
            kept, last = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[last:a])
                last = b
            kept.update(text[last:])
            rows.append((doc, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_ranges(spark: SparkSession, docs: DataFrame, space: Workspace, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(contents, ranges): contents(sha, content, doc, sub) has a row for each different text with its first document;
    ranges(doc, sub, start, end) are the bytes of those texts that repeat earlier ones."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sha = F.unhex(F.sha2(body, 256))
    content = F.conv(F.substring(F.hex(sha), 1, 15), 16, 10).cast("long")
    info = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), sha.alias("sha"))
    first = info.groupBy("sha").agg(F.min("doc").alias("doc"))
    sub = F.expr("cast(row_number() over (partition by doc order by sha) - 1 as int)")
    contents = space.save(first.withColumn("sub", sub).withColumn("content", F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")), "contents")
    found = space.save(docs.select(content.alias("content"), body.alias("text")).mapInArrow(_anchor_rows, "gram long, content long, pos int"), "anchors")
    one = F.xxhash64("content", "pos")
    more = found.groupBy("gram").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("n")).where("low <> high")
    more = space.save(more.select("gram", (F.col("n") > group).alias("hot")), "repeated")
    marked = F.when(F.col("hot"), -1 - F.col("pos")).otherwise(F.col("pos")).cast("int")
    places = space.save(found.join(more.hint("merge"), "gram").groupBy("content").agg(F.collect_set(marked).alias("at")), "places")
    space.drop(found)
    of = contents.join(places.hint("merge"), "content").select("doc", "sub", "sha", "at")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), sha.alias("sha"), body.alias("text"))
    near = texts.join(of.hint("merge"), ["doc", "sha"]).select("doc", "sub", "at", "text").mapInArrow(_occurrences, OCCURRENCE)
    dealt = near.repartition(F.when(F.col("hot"), F.xxhash64("doc", "sub", "pos")).otherwise(F.col("gram")))
    settled = space.save(dealt.sortWithinPartitions("hot", "gram", "doc", "sub", "pos").mapInArrow(_settle, SETTLED), "settled")
    space.drop(places)
    ranges = settled.where("bytes is null").select("doc", "sub", F.col("pos").alias("start"), F.col("before").alias("end"))
    if more.where("hot").isEmpty():
        return contents, ranges
    return contents, ranges.union(space.save(_by_minima(settled.where("bytes is not null"), space), "hot"))


def dedup(spark: SparkSession, docs: DataFrame, name: str = "suffix-dedup", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text).

    A null text is empty. Rows that are equal in doc_id and text are one document and get equal results. Different
    texts with one doc_id are ordered by SHA-256; rows whose doc_id is null come after all others. Texts shorter than
    the threshold lose nothing. Other columns of docs don't matter.
    """
    tune(spark)
    space = Workspace(spark, name)
    contents, ranges = removed_ranges(spark, docs, space, group)
    of = ranges.groupBy("doc", "sub").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    of = contents.join(of.hint("merge"), ["doc", "sub"], "left").select("sha", "doc", "ranges")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("sha"))
    joined = rows.join(of.hint("merge"), "sha").select("doc_id", "text", (F.coalesce("doc_id", F.lit(LAST)) != F.col("doc")).alias("copy"), "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup() of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "op9")
