"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint bit gets a nonzero vector of r+1 bits. For each nonzero v the mask keeps the bits whose
vector has an odd product with v. The at most r bits in which two fingerprints differ
span at most r dimensions, so some v is orthogonal to all of them: the mask of that v drops every differing
bit, and the two fingerprints share that table's bucket. 2^(r+1)-1 tables find every pair within radius r.

Scale: equal fingerprints are one row before the tables are made (grouped, combined before the shuffle); the
rows of a table are dealt by bucket. A bucket over `BUCKET` rows is passed on to a further covering family
within that bucket, which keeps about half of the bits still free, so buckets end bounded and no link is lost.
A bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace, components, tune

BUCKET = 4096
SEED = 42
CHUNK = 1 << 15
#: Bands of the near-duplicate groups and minima in each; rows that are compared with one another at once.
BANDS, ROWS, GROUP = 32, 4, 512
_XOR, _TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), "u8") | np.uint64(1)


def masks(radius: int, level: int = 0) -> list[int]:
    """The 2^(radius+1)-1 masks over 64 bits; levels are independent families."""
    size = 1 << (radius + 1)
    rng = random.Random(1000 * radius + level)
    vectors: list[int] = []
    while len(vectors) < 64:
        vectors += rng.sample(range(1, size), size - 1)
    vectors = vectors[:64]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashes(text: bytes | None, shingle: int, distinct: bool) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the A-Z-lower-cased words; fewer words: the whole sequence; none: empty."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    out = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    return np.unique(out) if distinct else out


def simhash(values: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint as one '<u8'; a bit is 1 if over half of the hashes have it."""
    counts = np.zeros(64, "i8")
    for i in range(0, len(values), CHUNK):
        counts += np.unpackbits(values[i : i + CHUNK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return np.packbits(2 * counts > len(values), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, shingle: int = 3, distinct: bool = False) -> DataFrame:
    """(doc_id, fp long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(hashes(text, shingle, distinct)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps or [np.empty(0, "<u8")]).view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the rows of a bucket: each to the smallest id of its component, which is a spanning forest."""
    n = len(fps)
    if n == 2:
        if np.bitwise_count(fps[0] ^ fps[1]) <= radius:
            return ids[:1], ids[1:]
        return ids[:0], ids[:0]
    order = np.argsort(ids, kind="stable")
    fps, ids = fps[order], ids[order]
    far = np.empty((n, n), "u1")
    for i in range(0, n, 512):
        np.bitwise_count(fps[i : i + 512, None] ^ fps[None, :], out=far[i : i + 512])
    label = np.arange(n)
    link = far <= radius
    for root in range(n):
        if label[root] != root:
            continue
        front = np.array([root])
        seen = np.zeros(n, bool)
        seen[root] = True
        while len(front):
            reach = link[front].any(axis=0) & ~seen
            seen |= reach
            front = np.flatnonzero(reach)
        label[seen] = root
    rows = np.flatnonzero(label != np.arange(n))
    return ids[rows], ids[label[rows]]


def linker(radius: int):
    """For rows (key, fp, id) sorted by key, of buckets of `BUCKET` rows at most: edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, "i8")] * 3

        def groups(rows: list[np.ndarray], last: bool):
            nonlocal held
            key = rows[0]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, "i8")
            ends = np.append(starts[1:], len(key))
            held = [v[:0] for v in rows]
            if not last and len(starts):
                held = [v[starts[-1] :] for v in rows]
                starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            pair = starts[sizes == 2]
            fps = rows[1].view("u8")
            close = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= radius]
            edges = [(rows[2][close], rows[2][close + 1])]
            for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                edges.append(forest(fps[a:b], rows[2][a:b], radius))
            a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
            pairs = np.unique(np.stack((a, b), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype("i8")) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            yield groups([np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)], False)
        yield groups(held, True)

    return run


def links(space: Workspace, reps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) among reps(fp, rep): a spanning forest of the links. Buckets are counted, combined before the
    shuffle, before any is dealt to a task; those over `BUCKET` rows go to the next family unseen."""
    found = None
    rows = reps.select(F.lit(0).cast("long").alias("within"), "fp", "rep")
    level = 0
    while rows is not None:
        of = F.transform(F.array(*[F.lit(signed(m)) for m in masks(radius, level)]), lambda m, i: F.xxhash64(F.col("within"), i, F.col("fp").bitwiseAND(m)))
        dealt = rows.select(F.explode(of).alias("key"), "fp", "rep")
        large = space.save(dealt.groupBy("key").count().where(F.col("count") > BUCKET).select(F.col("key").alias("within")), "large")
        some = not large.isEmpty()
        small = dealt.join(large, dealt.key == large.within, "left_anti") if some else dealt
        edges = space.save(small.repartition("key").sortWithinPartitions("key").mapInArrow(linker(radius), "a long, b long"), "links")
        found = edges if found is None else found.union(edges)
        rows = space.save(dealt.join(large, dealt.key == large.within).select("within", "fp", "rep").distinct(), "over") if some else None
        level += 1
    return found.distinct()


def classes(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 3, name: str = "simhash") -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fp long, component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint 0. Repeated rows stay. Different texts with one doc_id that is the smallest
    of their fingerprints are joined through it, as ids are what links join. Rows whose doc_id is null get the
    component of their fingerprint, or null where no row with a doc_id shares it. Other columns of docs don't matter.
    """
    tune(spark)
    space = Workspace(spark, name)
    fps = space.save(fingerprints(docs, shingle), "fingerprints")
    reps = space.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    found = components(space, links(space, reps.where("rep is not null"), radius))
    of = reps.join(found, reps.rep == found.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def signature(values: np.ndarray) -> np.ndarray:
    """The keys of the `BANDS` bands of a set of hashes, each of `ROWS` minima; an empty set has no key."""
    if not len(values):
        return np.empty(0, "u8")
    low = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    for i in range(0, len(values), CHUNK >> 5):
        np.minimum(low, ((values[i : i + (CHUNK >> 5)] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1), out=low)
    out = np.arange(BANDS, dtype="u8")
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, body, bands) per row: a digest of the set of shingles, and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashes(text, shingle, True) for text in batch.column(1).to_pylist()]
            bands = [signature(s) for s in sets]
            ends = np.cumsum([0, *map(len, bands)]).astype("i4")
            keys = np.concatenate([np.empty(0, "u8"), *bands]).view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], ["doc_id", "body", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, body binary, bands array<long>")


def joined(sets: list[np.ndarray], ids: list[int], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, over rows with different labels, of the pairs whose sets are that similar. Every pair that
    nothing has joined yet is tested; an edge joins the labels of both."""
    edges = []
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flag = np.zeros(len(code), "i4")
    for i in range(len(sets)):
        left = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        left = left[np.minimum(sizes[left], sizes[i]) >= similarity * np.maximum(sizes[left], sizes[i]) - 1e-9]
        if not len(left):
            continue
        flag[code[bounds[i] : bounds[i + 1]]] = 1
        both = np.array([flag[code[bounds[j] : bounds[j + 1]]].sum() for j in left.tolist()])
        flag[code[bounds[i] : bounds[i + 1]]] = 0
        for j in left[both >= similarity * (sizes[left] + sizes[i] - both) - 1e-9].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((ids[i], ids[j]))
    return edges


def confirmed(groups: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) that join the rows of each key of groups(key, rep, label), by the sets of shingles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            label = np.unique(np.array([h[1] for h in held]), return_inverse=True)[1]
            return joined([h[2] for h in held], [h[0] for h in held], label, similarity)

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            edges: list[tuple[int, int]] = []
            for key, rep, label, text in zip(*batch.columns, strict=True):
                key = key.as_py()
                if key != now:
                    edges += close()
                    held, now = [], key
                values = hashes(text.as_py(), shingle, True)
                if len(values):
                    held.append((rep.as_py(), label.as_py(), values))
            yield batch_of(edges)
        yield batch_of(close())

    rows = groups.join(texts, "rep").select("key", "rep", "label", "text")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def similar_groups(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3, name: str = "near-dedup") -> DataFrame:
    """(doc_id, component_id) by near-duplicate groups: `similarity` is the Jaccard similarity of the sets of
    five-word shingles.

    Candidates are of one class of classes(), as their fingerprints are linked by `radius` bits through the covering
    masks, or share one of `BANDS` bands of `ROWS` minima of the set: fingerprints alone miss near copies in which a
    passage is put in or cut, and a pair at 0.8 shares no band with a chance of 5e-8, wherever the texts differ. First each row is compared with the smallest row of the buckets that it shares
    most often with one; then every pair of a bucket that isn't in one component yet is compared, in blocks of
    `GROUP` rows where the bucket is larger. All comparisons are of the sets themselves, and each gives a spanning
    forest. Texts without a word, and texts that are equal word by word, are one group each.
    """
    tune(spark)
    space = Workspace(spark, name)
    marks = space.save(signatures(docs, shingle), "signatures")
    same = space.save(marks.where("doc_id is not null").groupBy("body").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "representatives")
    linked = classes(spark, docs, radius=radius, name=f"{name}-fingerprints").where("doc_id is not null")
    linked = linked.select(F.xxhash64(F.lit("simhash"), "component_id").alias("key"), F.col("doc_id").alias("rep")).distinct()
    linked = space.save(linked.join(same, "rep", "left_semi").select("key", "rep"), "classes")
    rows = same.select(F.explode("bands").alias("key"), "rep").union(linked)
    sizes = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared = space.save(rows.join(sizes.select("key", "low"), "key"), "buckets")
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(wanted, "doc_id", "left_semi")
    texts = space.save(whole.withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("rep"), "text"), "texts")

    most = shared.where("rep <> low").groupBy("rep", "low").count().groupBy("rep").agg(F.max(F.struct("count", "low")).alias("m")).select("rep", F.col("m.low").alias("low"))
    blocks = F.ceil(F.col("n") / GROUP).cast("long").alias("blocks")
    stars = most.join(most.groupBy("low").agg(F.count("*").alias("n")).select("low", blocks), "low").select("low", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "rep")
    stars = stars.union(stars.select("low", "block", "low").distinct())
    edges = space.save(confirmed(stars.select(F.xxhash64("low", "block").alias("key"), "rep", F.col("rep").alias("label")), texts, shingle, similarity), "stars")

    known = components(space, edges)
    labelled = space.save(shared.join(known, shared.rep == known.id, "left").select("key", "rep", F.coalesce("component", "rep").alias("label")), "labelled")
    members = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.shiftright(F.xxhash64("rep", F.lit(1)), 32)).alias("y"))
    mixed = members.where("least < most").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", blocks)
    block = F.pmod(F.xxhash64("rep"), "blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.xxhash64("key", F.least(block, i), F.greatest(block, i)))
    rest = confirmed(labelled.join(mixed, "key").select(F.explode(pairs).alias("key"), "rep", "label"), texts, shingle, similarity)
    found = components(space, edges.union(space.save(rest, "rest")))
    of = same.join(found, same.rep == found.id, "left").select("body", F.coalesce("component", "rep").alias("component_id"))
    return marks.join(of, "body", "left").select("doc_id", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classes() of documents by 3-word shingles and 3 bits: doc_id, fingerprint (hex), component_id for each row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(spark, docs, 3, 3, "op6").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
