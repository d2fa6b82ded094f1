"""Mixing sources to target weights, by blocks.

The words of each source are packed, document after document, into blocks of a fixed length: `BLOCK` words, or fewer
where a source's target is under `FINE` such blocks, so that rounding to whole blocks stays below one part in `FINE`.
Every output shard draws a multinomial count of blocks from each source's quota that is left, so shards are random and
the totals are exact. A source's slot j maps to block perm(j mod n) of epoch j div n, where perm is a pseudorandom
permutation of its n blocks (a Feistel network with cycle walking); slots are joined to blocks by (source, index).

Scale: sources are packed by running sums within buckets of documents, and the buckets' own sums, so that a hot
source isn't one task. Slots are made in pieces of `SLOTS`, counted by block before the join, and the join's keys are
spread evenly by design. Only the list of sources reaches the driver, `SOURCES` rows at most, with a vector of counts
for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, Workspace, tune

BLOCK = 64
FINE = 128
SHARDS = 64
SLOTS = 1 << 16
SOURCES = 100_000
BUCKET, BUCKETS = 20_000, 512
CYCLE = (5, 2, 1)
REPEATS = 3
SEED = 7


def targets(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; a share over `most` times its size stops there, and the excess is shared again."""
    size, weight = np.array(sizes, "f8"), np.array(weights, "f8")
    out, free, left = np.zeros(len(sizes)), size > 0, float(sum(sizes))
    while free.any():
        share = left * weight / weight[free].sum()
        full = free & (share > most * size)
        if not full.any():
            out[free] = share[free]
            break
        out[full] = most * size[full]
        left -= float(out[full].sum())
        free &= ~full
    return out.tolist()


def draws(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """counts[shard, source]: a multinomial draw for each shard by what is left of each quota; the sums are the quotas."""
    rng, left, out = np.random.default_rng(seed), np.array(quotas, "i8"), []
    for shard in range(shards):
        total = int(left.sum())
        size = total // (shards - shard)
        counts = np.minimum(rng.multinomial(size, left / total), left) if total else left * 0
        while shard < shards - 1 and (short := size - int(counts.sum())):  # a draw over what was left is drawn again
            rest = left - counts
            counts = np.minimum(counts + rng.multinomial(short, rest / rest.sum()), left)
        counts = left.copy() if shard == shards - 1 else counts
        left -= counts
        out.append(counts)
    return np.array(out)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at these indexes: four Feistel rounds, walked on until below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    low = np.uint64((1 << half) - 1)
    out = index.astype("u8")
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for turn in range(4):
            mixed = (right + np.uint64(xxhash.xxh64_intdigest(f"{key}/{turn}") >> 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype("i8")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, blocks, first, count) to (source, block, used): slots first .. first + count, by the permutation of their epoch."""
    for batch in batches:
        for source, blocks, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slots = np.arange(first, first + count)
            index = np.concatenate([permute(slots[slots // blocks == epoch] % blocks, blocks, xxhash.xxh64_intdigest(f"{SEED}/{source}/{epoch}")) for epoch in np.unique(slots // blocks).tolist()] or [slots])
            index, used = np.unique(index, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), source, "i4")), pa.array(index), pa.array(used)], ["source_no", "block", "used"])


def mix(spark: SparkSession, docs: DataFrame, name: str = "mix", block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source).

    A null text has no words. A null source is a source of its own, the last. Rows with equal doc_id are separate
    documents. Sources without a word have target 0. Reruns agree: nothing depends on partitions or on time. Rows
    equal in doc_id and text are interchangeable. A text longer than a block is in several. Other columns of docs don't
    matter. Over `SOURCES` sources are an error.
    """
    tune(spark)
    space = Workspace(spark, name)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = space.save(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("hash")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(sums) > SOURCES:
        raise ValueError(f"source has over {SOURCES} values")
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sums]
    weights = [float(CYCLE[i % len(CYCLE)]) for i in range(len(sums))]
    wanted = targets(sizes, weights)
    lengths = [max(1, min(block, int(t) // FINE)) for t in wanted]
    blocks = [-(-n // b) for n, b in zip(sizes, lengths, strict=True)]
    quotas = [min(REPEATS * b, round(t * b / n)) if n else 0 for t, b, n in zip(wanted, blocks, sizes, strict=True)]
    known = spark.createDataFrame([(i, r["source"], n, t, b, max(BUCKETS, -(-r["n"] // BUCKET))) for i, (r, n, t, b) in enumerate(zip(sums, sizes, wanted, lengths, strict=True))], "source_no int, source string, source_size long, target double, length int, buckets int")
    rows = rows.join(F.broadcast(known), rows.source.eqNullSafe(known.source)).drop(known.source)  # SOURCES rows at most
    rows = rows.withColumn("bucket", F.pmod("hash", "buckets").cast("int"))
    order = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "hash")
    rows = rows.withColumns({"nr": F.row_number().over(order), "inner": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    rows = space.save(rows, "rows")
    base = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("sum")).withColumn("base", F.sum("sum").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("sum")).drop("sum")
    placed = rows.where("size > 0").join(base, ["source_no", "bucket"]).withColumn("at", F.col("base") + F.col("inner"))
    length = F.col("length")
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("size") - 1) / length)
    parts = placed.select("source_no", "bucket", "nr", "at", "size", "length", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * length) - F.greatest(F.col("at"), F.col("block") * length)
    parts = parts.select("source_no", "bucket", "nr", "block", words.alias("words"))
    counts = draws(quotas, shards)
    drawn = pa.table({"source_no": pa.array(range(len(sums)), pa.int32()), "blocks": pa.array(blocks, pa.int64()), "counts": pa.array(list(counts.T.astype("i8")), pa.list_(pa.int64())), "before": pa.array(list((np.cumsum(counts, axis=0) - counts).T.astype("i8")), pa.list_(pa.int64()))})
    shard = F.inline(F.arrays_zip("counts", "before"))
    runs = spark.createDataFrame(drawn).select("source_no", "blocks", shard).where("counts > 0")
    runs_df = runs.select("source_no", "blocks", F.col("before").alias("first"), F.col("counts").alias("count"))
    pieces = runs_df.select("source_no", "blocks", "first", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(SLOTS).cast("long"))).alias("skip"))
    pieces = pieces.select("source_no", "blocks", (F.col("first") + F.col("skip")).alias("first"), F.least(F.col("count") - F.col("skip"), F.lit(SLOTS)).cast("long").alias("count"))
    used = pieces.repartition("source_no", "first").mapInArrow(_slots, "source_no int, block long, used long").groupBy("source_no", "block").agg(F.sum("used").alias("used"))
    # used comes from a small local table, so its estimate is small and it would be broadcast
    taken = parts.join(used.hint("merge"), ["source_no", "block"]).groupBy("source_no", "bucket", "nr").agg(F.sum(F.col("words") * F.col("used")).alias("taken"))
    out = rows.join(taken, ["source_no", "bucket", "nr"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of documents: doc_id, size, source_size, target, taken for each row."""
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "op10")
