"""Archives, shards, graphs, mixes and the pipeline against plain versions."""

import hashlib
import itertools

import corpus_pipeline
import numpy as np
import plain
import pytest
import zstandard
from pyspark.sql import functions as F

from recapspark.llm import hnsw, mixing, queries, secrets, sharding, simhash, toxicity, warc
from recapspark.llm.components import connected_components
from recapspark.operators.storage import new_folder

SMALL = "/root/testdata/sf0.001"


def _pages(spark):
    long, other = "ä" * 600, "b" * 1000
    rows = [(1, "u", long), (5, None, long), (3, "x\ny", long), (2, "", "b" * 999), (4, "", "b" * 999),
            (7, "v", other), (6, "v", other), (8, None, None), (9, "w", ""), (10, "z", "line\r\n\r\nWARC/1.1\r\n" * 3),
            (11, "y", "c" * 2000), (11, "y", "c" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("_raw", "_digest", "_bytes", "_keep", "record_type", "_n")})


def test_archive_round_trip(spark):
    for pages in (_pages(spark), plain.table(spark, "pages")):
        rows = pages.collect()
        last = {}
        for r in rows:
            last[r["html"] or ""] = max(last.get(r["html"] or "", r["page_id"]), r["page_id"])
        want = []
        for r in rows:
            body = (r["html"] or "").encode()
            keep = last[r["html"] or ""]
            again = len(body) >= 1000 and keep != r["page_id"]
            want.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keep if again else -1))
        got = [(*r[:4], -1 if r[4] is None else r[4]) for r in warc.round_trip(pages).collect()]
        assert sorted(got) == sorted(want)


def test_bundles_are_seekable(spark, monkeypatch):
    pages = plain.table(spark, "pages").select("page_id", "url", "html")
    path = new_folder(spark, "warc")
    warc.write(pages, path)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    bundles = {r["path"]: bytes(r["content"]) for r in warc.files(spark, path).collect()}
    index = warc.read_index(spark, path).collect()
    assert len(index) == len(html)
    for r in index:
        data = bundles[r["path"]]
        frame = zstandard.ZstdDecompressor().decompress(data[r["start"] : r["start"] + r["size"]], 1 << 26)
        head, body, _ = warc.parse(frame, r["offset"])
        assert head["WARC-Record-ID"] == f"<urn:page:{r['record_id']}>"
        assert head["WARC-Type"] == "revisit" or body.decode() == html[r["record_id"]]
    for data in bundles.values():  # any Zstandard reader reads the whole file
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") >= len(warc.index_of(data))


def test_many_frames():
    bundle = warc.Bundle()
    for i in range(50):
        body = bytes([65 + i % 26]) * 40_000
        bundle.add(i, warc.record(i, "u", body, hashlib.sha1(body).hexdigest()))
    data = bundle.close()
    index = warc.index_of(data)
    assert len({f for _, f, _ in index}) > 3
    for i, frame, offset in index:
        head, body, _ = warc.parse(warc.frame_bytes(data, frame), offset)
        assert body == bytes([65 + i % 26]) * 40_000


def test_frequent_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 2)
    test_archive_round_trip(spark)


@pytest.mark.parametrize("ranges,sample", [(4096, 200_000), (64, 50), (16, 1000)])
def test_shards(spark, ranges, sample):
    for docs in (plain.table(spark, "documents", "/root/testdata/sf0.01"), plain.odd_docs(spark)):
        rows = sharding.shard(docs, ranges=ranges, sample_rows=sample).collect()
        sizes = sorted(len((r["text"] or "").encode()) + 1 for r in docs.collect())
        assert sorted(r["size"] for r in rows) == sizes
        by_shard = {}
        for r in rows:
            by_shard.setdefault(r["shard"], []).append(r)
        for own in by_shard.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        if len(rows) >= 1000 and ranges >= 4096:
            weights = [sum(r["size"] for r in own) for own in by_shard.values()]
            assert len(by_shard) == 16 and max(weights) < 1.25 * min(weights)


def test_shards_of_one_hot_text(spark):
    rows = [(i, "same text " * 20) for i in range(4000)] + [(10_000 + i, f"text {i} " * 20) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r["n"] for r in got]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_splitters_follow_the_sizes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), i, int(n)) for i, (k, n) in enumerate(zip(rng.integers(-(2**62), 2**62, 3000), rng.pareto(1.2, 3000) * 50 + 1))]
    rows += [(7, 10_000 + i, 40) for i in range(1500)]
    sizes = spark.createDataFrame(rows, "key long, id long, size long")
    total = sum(r[2] for r in rows)
    got = sharding._splitters(sizes, total, 16, 10**9)  # every row is drawn and counts by its size
    weight = {}
    for k, _, n in rows:
        weight[k] = weight.get(k, 0) + n
    want, before, part = [], 0, 0
    for k in sorted(weight):
        now = -(-before * 16 // total)
        if now > part:
            want.append(k)
            part = now
        before += weight[k]
    assert got == want
    few = sharding._splitters(sizes, total, 16, 500)
    edges = np.array([-(2**63), *few, 2**63 - 1], float)
    share = np.histogram([r[0] for r in rows], edges, weights=[r[2] for r in rows])[0] / total
    hot = 60_000 / total
    assert len(few) >= 8 and sorted(share)[-2] < max(3 / 16, hot)


@pytest.mark.parametrize("named", [True, False])
def test_a_third_of_empty_texts(spark, named):
    rows = [(i if named else None, "" if i % 2 else None) for i in range(5000)] + [(10_000 + i, f"some text {i} " * 20) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(docs, ranges=256)
    by_shard = got.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("slot").alias("last")).collect()
    assert len(by_shard) == 16 and all(r["last"] == r["rows"] - 1 for r in by_shard)
    sizes = [r["bytes"] for r in by_shard]
    assert max(sizes) < 1.1 * min(sizes)
    windows = [r[0] for r in sharding.placed(docs, 256)[0].groupBy("range", "part").count().select("count").collect()]
    assert max(windows) <= 3 * 15_000 / 256


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 500} " * 20) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, ranges=64).groupBy("crc32").agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0]
    assert got == 1


def test_fit_lengths():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 30, 6))
        counts = rng.integers(0, 5, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 5))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take <= counts).all() and int((lengths * take).sum()) == best
    lengths, counts = np.arange(1, 3000), rng.integers(1, 10**6, 2999)
    budget = int((lengths * counts).sum() * 0.37)
    take = mixing.fit_lengths(lengths, counts, budget)
    assert (take <= counts).all() and (take >= 0).all() and int((lengths * take).sum()) == budget


def test_fit_lengths_nearest():
    def fit(lengths, counts, budget):
        take = mixing.fit_lengths(lengths, counts, budget, above=True)
        assert (take <= counts).all() and (take >= 0).all()
        return int((lengths * take).sum())

    assert fit(np.array([1000]), np.array([3]), 2900) == 3000
    assert fit(np.array([1000]), np.array([3]), 2400) == 2000
    assert fit(np.array([100_000]), np.array([3]), 290_000) == 300_000
    rng = np.random.default_rng(8)
    for _ in range(200):
        lengths = np.unique(rng.integers(0, 60, 4))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        assert abs(fit(lengths, counts, budget) - budget) == min(abs(s - budget) for s in sums)


def test_mix_reaches_past_the_target(spark):
    rows = [(i, "w " * 1000, "en", "s", 2000) for i in range(3)]
    docs = spark.createDataFrame(rows, plain.DOCS)
    got = mixing.mix(docs, share=2.9 / 3).collect()
    assert sum(r["_times"] for r in got) == 3


def _plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        unit = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / unit for s in sizes}
        above = {s for s in sizes if s not in full and target[s] >= 2 * sizes[s]}
        if not above:
            return target
        full |= above
        if len(full) == len(sizes):
            return {s: 2.0 * sizes[s] for s in sizes}


def test_mix(spark, monkeypatch):
    for docs, buckets in itertools.product((plain.table(spark, "documents", "/root/testdata/sf0.01"), plain.odd_docs(spark)), (2000, 1)):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", buckets)
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        sizes = {}
        for r in docs.collect():
            sizes[r["source"]] = sizes.get(r["source"], 0) + len(plain.words(r["text"]))
        target = _plain_targets(sizes)
        taken = dict.fromkeys(sizes, 0)
        for r in rows:
            assert r["_size"] == len(plain.words(r["text"])) and r["_source_size"] == sizes[r["source"]]
            assert abs(r["_target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
            assert 0 <= r["_times"] <= 2
            taken[r["source"]] += r["_times"] * r["_size"]
        if docs.count() > 100:
            assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
            again = {r["doc_id"]: r["_times"] for r in mixing.mix(docs.repartition(5)).collect()}
            assert again == {r["doc_id"]: r["_times"] for r in rows}
    assert mixing.mix(docs.limit(0)).count() == 0


def _plain_links(rows):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in good]
    edges = [(a, b) for a in range(len(unit)) for b in range(a) if len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.95]
    links = [0] * len(unit)
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    part = plain.components({i for i, _ in unit}, [(unit[a][0], unit[b][0]) for a, b in edges])
    return {i: (links[k], part[i]) for k, (i, _) in enumerate(unit)}


def test_graphs(spark):
    vectors = plain.table(spark, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    rng = np.random.default_rng(7)
    center = rng.normal(size=64)
    n = len(rows)
    rows += [(10_000 + i, (center + rng.normal(size=64) * 0.08).astype(np.float32).tolist()) for i in range(150)]
    rows += [(20_000 + i, [1.0] * 64) for i in range(30)]
    rows += [(30_000, None), (30_001, [0.0] * 64), (30_002, [float("nan")] * 64), (30_003, [1.0, None]), (30_004, []),
             (30_005, [1.0, 2.0]), (30_006, [2.0, 4.0]), (30_007, [float("inf")] + [1.0] * 63), (None, [1.0] * 64), (30_008, [1e-30] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    want = _plain_links([(i, np.float32(v).tolist() if v and None not in v else v) for i, v in rows])
    got = {r["id"]: (r["n_links"], r["component"]) for r in hnsw.near_duplicates(frame).collect()}
    assert len(got) == len(rows) and n < len(rows)
    true = sum(x[0] for x in want.values())
    found = sum(x[0] for i, x in got.items() if i in want)
    assert 0.97 * true <= found <= true
    for i, x in got.items():
        assert x == (0, i) if i not in want else x[0] <= want[i][0]
    same = sum(got[i][1] == want[i][1] for i in want)
    assert same >= 0.99 * len(want)
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_recall_on_a_larger_shard():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 32)) * 0.15
    x = hnsw.unit(x).astype(np.float32)
    graph = hnsw.Graph(x)
    beam, recall, scan = graph.audited_beam(0.95)
    assert not scan
    q, node = graph.links_of(x, beam, 0.95)
    truth = (x @ x.T >= 0.95).sum()
    assert recall >= hnsw.RECALL and len(q) >= 0.97 * truth


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_given_vectors_go_through_the_graph(spark, folder):
    vectors = plain.table(spark, "embeddings", f"/root/testdata/{folder}")
    x = hnsw.unit(np.array([r[0] for r in vectors.select("embedding").distinct().collect()]))
    shards = max(1, min(hnsw.SHARDS, len(x) // hnsw.LEAST_ROWS))
    graph = hnsw.Graph(x[: len(x) // shards].astype(np.float32))
    beam, recall, scan = graph.audited_beam(0.95)
    assert beam < len(graph.x) and recall >= hnsw.RECALL and not scan
    q, node = graph.links_of(x.astype(np.float32), beam, 0.95)
    assert graph.searches >= len(x) and len(q) >= 0.98 * (x @ graph.x.T >= 0.95).sum()
    told = hnsw.near_duplicates(vectors).select("recall", "beam", "scanned").distinct().collect()
    assert all(r["recall"] >= hnsw.RECALL and not r["scanned"] for r in told)


def test_a_failed_audit_is_told(monkeypatch):
    rng = np.random.default_rng(4)
    graph = hnsw.Graph(hnsw.unit(rng.normal(size=(600, 16))).astype(np.float32))
    graph.layers[-1][:] = -1  # a graph without links finds nothing
    beam, recall, scan = graph.audited_beam(0.95)
    assert scan and recall < hnsw.RECALL
    q, _ = graph.links_of(graph.x, beam, 0.95, scan)
    assert len(set(q.tolist())) == 600 and graph.searches == 0


def test_vectors_in_double_precision(spark):
    rows = [(1, [1e-46, 0.0, 0.0, 0.0]), (2, [1e300, 0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0, 0.0]), (5, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component"]) for r in hnsw.near_duplicates(frame).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_components(spark):
    rng = np.random.default_rng(2)
    for edges in ([(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 300)],
                  [tuple(map(int, e)) for e in rng.integers(0, 400, (300, 2))], [(5, 5)], []):
        frame = spark.createDataFrame(edges, "a long, b long")
        got = {r["node"]: r["root"] for r in connected_components(frame).collect()}
        nodes = {n for e in edges for n in e if e[0] != e[1]}
        assert got == plain.components(nodes, [e for e in edges if e[0] != e[1]])


def test_pipeline(spark):
    SMALL = "/root/testdata/sf0.01"
    docs = queries.table(spark, SMALL, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        steps[name] = docs
    given = queries.table(spark, SMALL, "documents")
    for name in list(steps)[:-1]:
        assert steps[name].columns == given.columns, name
    kept = steps["toxicity"].collect()
    assert 0 < len(kept) < given.count()
    fps = [plain.fingerprint(r["text"]) for r in kept]
    part = plain.components([r["doc_id"] for r in kept], [(kept[a]["doc_id"], kept[b]["doc_id"]) for a, b in plain.close_pairs(fps)])
    assert {r["doc_id"] for r in steps["simhash_near_dedup"].collect()} == set(part.values())
    clean = {r["doc_id"]: r for r in steps["secret_scan"].collect()}
    assert set(clean) == set(part.values())
    for r in kept:
        if r["doc_id"] in clean:
            changed = clean[r["doc_id"]]["text"] != r["text"]
            assert changed or not plain.base_spans(r["text"])
            assert not plain.base_spans(clean[r["doc_id"]]["text"])
            assert clean[r["doc_id"]]["n_chars"] == len(clean[r["doc_id"]]["text"])
    mixed = [r["doc_id"] for r in steps["source_mixing"].collect()]
    assert set(mixed) <= set(clean) and max(mixed.count(i) for i in set(mixed)) <= 2
    assert sorted(r["doc_id"] for r in steps["bpe"].collect()) == sorted(mixed)
    assert corpus_pipeline.run(spark, SMALL).count() == len(mixed)


def test_pipeline_on_odd_rows(spark):
    names = ("_score", "_spans", "_base", "_size", "_hash", "_copy", "_times", "others", "_clean", "row", "size", "id")
    plain_docs = plain.odd_docs(spark)
    docs = plain_docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        plain_docs = stage(spark, plain_docs, SMALL)
        assert docs.columns == columns, name
        rows, given = docs.collect(), {r["doc_id"] for r in before.collect()}
        assert {r["doc_id"] for r in rows} <= given
        for r in rows:
            assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for n in names), name
        same = [c for c in columns if c not in names]
        assert sorted(map(str, docs.select(*same).collect())) == sorted(map(str, plain_docs.collect())), name
    ended = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert ended.count() == docs.count() > 5
    empty = plain.odd_docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0, name


def test_near_copies_under_a_repeated_smallest_id(spark):
    one, two, three = (" ".join(f"{c}{i * i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (7, one), (1, two), (9, two), (20, three), (1, one)]
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in rows], plain.DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, one), (1, two), (20, three)]


@pytest.mark.parametrize("name", ["op4_warc", "op6_sharding", "op7_hnsw", "op8_mixing", "pipeline"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings"):
        plain.table(spark, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert run(spark, str(tmp_path)).count() == 0
    assert secrets and simhash and toxicity


def test_graphs_hold_vectors_once_and_queries_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 300)
    monkeypatch.setattr(hnsw, "PAIR_ROWS", 50)
    monkeypatch.setattr(hnsw, "SPREAD_ROWS", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(800, 16))
    x = np.concatenate([x, x[:400] + 0.05 * rng.normal(size=(400, 16))]).astype(np.float32)
    frame = spark.createDataFrame(
        [(i, v.tolist(), 1, 16, 0) for i, v in enumerate(x)],
        "node long, embedding array<float>, n long, width int, shard int",
    )
    graphs = hnsw.build(frame, 0.95).localCheckpoint()
    # a float vector, its links, id and count; no second vector in doubles, no empty upper layers
    assert len(graphs.first()["graph"]) < len(x) * (4 * 16 + 8 * hnsw.LINKS + 64)
    found = hnsw.query(graphs, frame, 1, 1, 0.95).collect()
    unit = hnsw.unit(x)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["a"]: r["links"] for r in found if r["b"] is None}
    want = {i: int(n) for i, n in enumerate(near.sum(1)) if n}
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(n <= want[i] for i, n in got.items())
    ends = {r["a"] for r in found if r["b"] is not None} | {r["b"] for r in found if r["b"] is not None}
    assert ends == set(got)


def test_small_tables_make_few_files(spark):
    from recapspark.llm.components import connected_components

    reached = connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    # one file a table, but for the first edges, whose number was not known
    files = [f for f in reached.inputFiles() if "/step-" in f]
    assert files and len(files) == len({f.rsplit("/", 1)[0] for f in files})
    assert {tuple(r) for r in reached.collect()} == {(1, 1), (2, 1), (3, 1)}
