from __future__ import annotations

import glob
import gzip

import numpy as np
import pyarrow as pa
import pyarrow.fs

from sparkloupe.llm import hnsw, warc
from sparkloupe.llm._shared import Workspace

from .helpers import WEIRD, documents


def cluster_rows(seed=0, n=900, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(n):
        v = centres[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 3.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    return rows + [(n + i, rows[0][1], rows[0][2]) for i in range(5)]


def brute(rows):
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([r[1] for r in rows], "f4").astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    component = ids.copy()
    while True:
        new = np.array([min(component[i], *component[link[i]]) if link[i].any() else component[i] for i in range(len(ids))])
        if (new == component).all():
            return {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), component, strict=True)}
        component = new


def test_embeddings_against_brute_force(spark):
    rows = cluster_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    for shard, block in ((20_000, 20_000), (90, 120)):
        got = {r[0]: tuple(r[1:]) for r in hnsw.near_duplicates(spark, df, shard=shard, block=block).collect()}
        links, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
        assert found <= links and found >= 0.99 * links
        assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.99 * len(want)


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(np.arange(1500), np.ones(1500, "i8"), x)
    g.close()
    g = hnsw.Graph.load(g.dump())
    truth = x @ x.T >= 0.8
    found = sum(truth[i, g.near(x[i], 64, 0.8)].sum() for i in range(1500))
    assert found >= 0.95 * truth.sum()


def test_embeddings_weird_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, [0.0, 0.0], 1, "a"), (4, None, 1, "a"), (5, [nan, 1.0], 1, "a"), (6, [inf, 1.0], 1, "a"), (7, [None, 1.0], 1, "a"), (8, [1.0, 0.0], None, "a"), (None, [1.0, 0.0], 1, "a"), (9, [1.0, 0.0], 1, "a"), (9, [1.0, 0.0], 1, "a"), (10, [1.0, 0.0, 0.0], 1, "a"), (11, [], 1, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = sorted((tuple(r) for r in hnsw.near_duplicates(spark, df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [(1, 3, 1, True), (2, 3, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)], (9, 3, 1, False), (9, 3, 1, False), (10, 0, 10, True), (11, 0, 11, True), (None, 0, None, False)]
    assert hnsw.near_duplicates(spark, df.where("false")).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 5000
    rows = [(3, "http://a/3", long), (1, "http://a/1\nx", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "y" * 100), (8, "u", "y" * 100)]
    path = Workspace(spark, "t").path("archive")
    warc.write_archive(spark, pages(spark, rows), path)
    got = spark.read.format("warc").load(path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["record_id"], []).append(r)
    assert by["<urn:page:1>"][0]["record_type"] == "response" and by["<urn:page:1>"][0]["payload"].decode() == long
    assert {by[f"<urn:page:{i}>"][0]["refers_to"] for i in (2, 3, "none")} == {"<urn:page:1>"}
    assert [r["record_type"] for i in (4, 5, 6, 7, 8) for r in by[f"<urn:page:{i}>"]] == ["response"] * 6
    assert by["<urn:page:3>"][0]["payload_length"] == len(long.encode()) and by["<urn:page:6>"][0]["payload"] == b""
    assert by["<urn:page:1>"][0]["target_uri"] == "http://a/1%0Ax"
    plain = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file://") + "/*.gz"))
    assert plain.count(b"WARC/1.1\r\n") == len(rows)
    empty = Workspace(spark, "t").path("none")
    warc.write_archive(spark, pages(spark, []), empty)
    assert spark.read.format("warc").load(empty).count() == 0


def test_warc_pushdown_skips_payloads(spark, tmp_path):
    data = b"".join(warc.member(warc.record("response", f"<urn:page:{i}>", "http://u", b"z%d" % i * 200_000, "0" * 64, None, 400_000)) for i in range(6))
    (tmp_path / "a.warc.gz").write_bytes(data)
    reader = warc.Reader({"path": str(tmp_path), "header:WARC-Record-ID": "<urn:page:4>"}, None)
    assert [r["record_id"] for b in reader.read(warc.Files([str(tmp_path / "a.warc.gz")])) for r in b.to_pylist()] == ["<urn:page:4>"]
    with pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")) as f:
        members = warc.Members(f)
        assert sum(1 for _ in members) == 6 and members.inflated <= 6 * warc.HEAD
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}").where("record_type = 'revisit'")
    assert df.count() == 0


def test_warc_reads_archives_without_lengths_and_plain_ones(tmp_path):
    records = [warc.record("response", f"<urn:page:{i}>", None, b"abc" * i, "0" * 64, None, 3 * i) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    for name in ("a.warc.gz", "b.warc"):
        for payload in ("true", "false"):
            reader = warc.Reader({"path": str(tmp_path), "payload": payload}, None)
            got = [r for b in reader.read(warc.Files([str(tmp_path / name)])) for r in b.to_pylist()]
            assert [r["record_id"] for r in got] == [f"<urn:page:{i}>" for i in range(5)]
            assert payload == "false" or [r["payload"] for r in got] == [b"abc" * i for i in range(5)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, WEIRD)
    bench = spark.createDataFrame([(1, "What is the name of the largest river that flows through this old city")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        assert out.count() <= len(WEIRD)


def test_pipeline_against_brute_force_of_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, sf)
    rows = {r["doc_id"]: r for r in kept.collect()}
    source = {r["doc_id"]: r for r in docs.collect()}
    items = [r["text"].lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [r["text"] for r in rows.values()]
    assert len(set(texts)) == len(texts)
    assert not any(i in t.lower() for i in items for t in texts)
    assert not any('token = "' in t for t in texts)
    shingles = {d: {tuple(r["text"].lower().split()[i : i + 5]) for i in range(max(1, len(r["text"].split()) - 4))} for d, r in source.items() if r["text"]}
    for d, r in source.items():
        if d not in rows and r["text"] and len(r["text"]) > 100:
            leak = any(i in r["text"].lower() for i in items)
            near = any(e != d and len(shingles[d] & shingles[e]) >= 0.7 * len(shingles[d] | shingles[e]) for e in shingles)
            assert leak or near, d
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(rows)
