"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label are one node. The nodes of a (label, dimension) are dealt to shards of about `SHARD` rows by
a hash, and each shard's graph is built once and saved. Every block of queries of that label visits every shard. A
search widens its beam (`ef`) while a recall audit against brute force on a sample of the block fails, and past the
last width it scans the shard. Within the threshold a search isn't limited by its beam, so large groups are found
whole. Links are verified by cosine in double precision and counted in the task; what leaves a task is one row for
each node and a spanning forest of its links, whose union gives the components.

Scale: a task holds one shard and one block of queries, both of bounded size, whatever the label's share of the rows.
Queries times shards is the method's cost; `SHARD` trades it against a task's memory.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace, components, tune

THRESHOLD = 0.93
SHARD, BLOCK = 20_000, 20_000
DEGREE, BUILD, BEAM = 12, 48, 32
AUDIT, RECALL = 256, 0.995


class Graph:
    """vectors are unit vectors in double precision; links[level] is an array of neighbours, -1 where there is none."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0) -> None:
        self.ids, self.counts, self.vectors, self.entry = ids, counts, vectors, entry
        self.seen, self.turn = np.zeros(len(ids) + 1, "i8"), 0
        self.links = links if links is not None else []
        self.both: tuple[np.ndarray, np.ndarray] | None = None
        if links is None:
            self.build()
        else:
            self.close()

    def close(self) -> None:
        """For searches, the lowest level's links lead both ways: a node that all its neighbours have dropped for
        nearer ones stays within reach."""
        n, links = len(self.ids), self.links[0]
        a, b = np.repeat(np.arange(n), links.shape[1]), links.reshape(-1).astype("i8")
        a, b = a[b >= 0], b[b >= 0]
        pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
        self.both = np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n

    def build(self) -> None:
        rng = np.random.default_rng(0)
        n = len(self.ids)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(DEGREE)).astype(int), 8)
        self.links = [np.full((n, DEGREE * (2 if level == 0 else 1)), -1, "i4") for level in range(int(levels.max(initial=0)) + 1)]
        self.fill = [np.zeros(n, "i4") for _ in self.links]
        top = int(levels[0]) if n else 0
        for i in range(1, n):
            q, near = self.vectors[i], [self.entry]
            for level in range(top, -1, -1):
                if level > levels[i]:
                    near = [self.search(q, near, 1, level)[0][1]]
                    continue
                found = self.search(q, near, BUILD, level)
                chosen = self.choose(found, self.links[level].shape[1] // (2 if level == 0 else 1))
                self.links[level][i, : len(chosen)] = chosen
                self.fill[level][i] = len(chosen)
                for c in chosen:
                    self.connect(c, i, level)
                near = [x for _, x in found]
            if levels[i] > top:
                top, self.entry = int(levels[i]), i

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Spread neighbours: one is taken if no taken one is nearer to it than the query; the nearest others fill up."""
        nodes = np.array([x for _, x in found])
        if len(nodes) <= 1:
            return nodes.tolist()
        between = self.vectors[nodes] @ self.vectors[nodes].T
        taken: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(taken) < most and (not taken or between[k, taken].max() < s):
                taken.append(k)
        rest = set(taken)
        taken += [k for k in range(len(nodes)) if k not in rest][: most - len(taken)]
        return nodes[taken].tolist()

    def connect(self, c: int, i: int, level: int) -> None:
        links, fill = self.links[level], self.fill[level]
        if fill[c] < links.shape[1]:
            links[c, fill[c]] = i
            fill[c] += 1
            return
        nodes = np.append(links[c], i)
        near = self.vectors[nodes] @ self.vectors[c]
        order = np.argsort(-near, kind="stable")
        chosen = self.choose(list(zip(near[order].tolist(), nodes[order].tolist(), strict=True)), links.shape[1])
        links[c, : len(chosen)] = chosen
        fill[c] = len(chosen)

    def search(self, q: np.ndarray, starts: list[int], beam: int, level: int, within: float = 2.0) -> list[tuple[float, int]]:
        """The nearest `beam` nodes and, as far as links lead, all whose similarity is `within` or more; nearest first."""
        self.turn += 1
        seen, turn, vectors, links = self.seen, self.turn, self.vectors, self.links[level]
        both = self.both if level == 0 else None
        seen[starts] = turn
        sims = (vectors[starts] @ q).tolist()
        todo = [(-s, x) for s, x in zip(sims, starts, strict=True)]
        heapq.heapify(todo)
        best = [(s, x) for s, x in zip(sims, starts, strict=True)]
        heapq.heapify(best)
        extra: list[tuple[float, int]] = []
        while todo:
            s, x = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= beam and -s < within:
                break
            if both is None:
                near = links[x]
                near = near[near >= 0]
            else:
                near = both[1][both[0][x] : both[0][x + 1]]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            low = best[0][0] if len(best) >= beam else -2.0
            for s, y in zip((vectors[near] @ q).tolist(), near.tolist(), strict=True):
                if s > low or len(best) < beam or s >= within:
                    heapq.heappush(todo, (-s, y))
                    if len(best) < beam:
                        heapq.heappush(best, (s, y))
                    else:
                        out = heapq.heappushpop(best, (s, y))
                        if out[0] >= within:
                            extra.append(out)
                        low = best[0][0]
        return sorted(best + extra, reverse=True)

    def near(self, q: np.ndarray, beam: int, threshold: float) -> np.ndarray:
        """Nodes with a cosine of `threshold` or more."""
        at = [self.entry]
        for level in range(len(self.links) - 1, 0, -1):
            at = [self.search(q, at, 1, level)[0][1]]
        found = np.array([x for s, x in self.search(q, at, beam, 0, threshold - 1e-9) if s >= threshold - 1e-9], "i8")
        return found[self.vectors[found] @ q >= threshold]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, counts=self.counts, vectors=self.vectors, entry=self.entry, **{f"links{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Graph:
        x = np.load(io.BytesIO(data))
        return Graph(x["ids"], x["counts"], x["vectors"], [x[f"links{i}"] for i in range(sum(k.startswith("links") for k in x.files))], int(x["entry"]))


def search_block(graph: Graph, queries: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The nodes linked to each query; the beam is widened until the audit of the block passes, over all links of the
    sample and in the mean of its queries, so that large groups don't hide what small ones lose."""
    n, beam = len(graph.ids), BEAM
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    truth = np.maximum((queries[sample] @ graph.vectors.T >= threshold).sum(axis=1), 1)
    while beam < n:
        found = np.array([min(max(len(graph.near(queries[i], beam, threshold)), 1), int(t)) for i, t in zip(sample.tolist(), truth, strict=True)])
        if found.sum() >= RECALL * truth.sum() and (found / truth).mean() >= RECALL:
            return [graph.near(q, beam, threshold) for q in queries]
        beam *= 2
    out = []
    for i in range(0, len(queries), 256):
        out += [np.flatnonzero(row) for row in queries[i : i + 256] @ graph.vectors.T >= threshold]
    return out


def _unit(values: pd.Series) -> np.ndarray:
    out = np.stack([np.asarray(v, "f8") for v in values])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    graph = Graph(rows["id"].to_numpy("i8"), rows["n"].to_numpy("i8"), _unit(rows["embedding"]))
    return pd.DataFrame({"label": [rows["label"].iloc[0]], "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "graph": [graph.dump()]})


def _linker(threshold: float):
    def link(shards: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """(kind 0, id, links) and edges (kind 1, a, b) of one block of queries with one shard."""
        if shards.empty or rows.empty:
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        graph = Graph.load(shards["graph"].iloc[0])
        ids = rows["id"].to_numpy("i8")
        found = search_block(graph, _unit(rows["embedding"]), threshold)
        label, touched = np.arange(len(graph.ids)), np.zeros(len(graph.ids), bool)
        links, outer = np.zeros(len(ids), "i8"), []
        place = {x: i for i, x in enumerate(graph.ids.tolist())}
        for k, (x, near) in enumerate(zip(ids.tolist(), found, strict=True)):
            near = near[graph.ids[near] != x]
            if not len(near):
                continue
            links[k] = graph.counts[near].sum()
            own = place.get(x)
            if own is not None:
                near = np.append(near, own)
            else:
                outer.append((x, near[0]))
            touched[near] = True
            labels = np.unique(label[near])
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
        some = links > 0
        rows_at = np.flatnonzero(touched)
        a = np.concatenate((ids[some], graph.ids[rows_at], np.array([x for x, _ in outer], "i8")))
        b = np.concatenate((links[some], graph.ids[label[rows_at]], np.array([graph.ids[label[y]] for _, y in outer], "i8")))
        kind = np.concatenate((np.zeros(some.sum(), "i8"), np.ones(len(a) - some.sum(), "i8")))
        keep = (kind == 0) | (a != b)
        return pd.DataFrame({"kind": kind[keep], "a": a[keep], "b": b[keep]})

    return link


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, name: str = "hnsw", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label).

    Vectors that are null, empty or zero, or have null or non-finite components, and rows whose vec_id or label is null
    link with nothing: no links, a component of their own (null for a null vec_id, which isn't kept). Vectors of
    different length don't link. Repeated rows are vectors of their own, linked as equal ones; n_links counts rows.
    """
    tune(spark)
    space = Workspace(spark, name)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("embedding"))
    nodes = space.save(nodes, "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumns({"shard": F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"), "block": F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")})
    dealt = space.save(dealt, "dealt")
    graphs = space.save(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, "label string, dim int, shard int, graph binary"), "graphs")
    visits = graphs.join(sizes, ["label", "dim"]).select("label", "dim", "shard", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = dealt.select("label", "dim", "id", "embedding", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    key = ["label", "dim", "shard", "block"]
    found = visits.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_linker(threshold), "kind long, a long, b long")
    found = space.save(found, "links")
    joined = components(space, found.where("kind = 1").select("a", "b"))
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    of = nodes.join(counts, nodes.id == counts.a, "left").join(joined.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    of = of.select(F.col("label").alias("of_label"), F.col("embedding").alias("of_embedding"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = F.col("vec_id").isNotNull() & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_embedding"))
    out = rows.join(of, linked, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of embeddings: vec_id, n_links, component_id, kept for each row."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), THRESHOLD, "op1")


ORACLE = f"""
    with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
    link as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    reach as (select vec_id as i, vec_id as j from v union select r.i, l.j from reach r join link l on l.i = r.j),
    low as (select i, min(j) as component_id from reach group by i),
    n as (select i, count(*) as n_links from link group by i)
    select v.vec_id, coalesce(n_links, 0) as n_links, component_id, v.vec_id = component_id as kept from v join low on low.i = v.vec_id left join n on n.i = v.vec_id"""
