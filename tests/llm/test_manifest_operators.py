"""Decontamination, whitening and manifest against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from recapspark.llm import decontaminate, merkle, queries, whitening

LARGER = "/root/testdata/sf0.01"


def key(row):
    return tuple(map(str, row))


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- decontamination -------------------------------------------------------------


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text))


def plain_hits(docs, items):
    known = {}
    for i, text in items:
        w = bench_words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, names = bench_words(text), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    names |= known[tuple(w[k : k + n])]
        out.append((i, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=key)


def odd_items(spark):
    rows = [(1, "the same line here"), (1, "One TWO"), (None, "word " * 12), (2, None), (3, ""), (4, "!!"),
            (5, " ".join(f"w{i}" for i in range(1, 13))), (6, "a"), (7, "x" * 3000), (8, "CÖDÉ text")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    return items.withColumns({c: F.lit("x") for c in ("window", "n", "item", "w", "part")})


def clashing(docs):
    names = ("_text", "n_words", "hits", "items", "mark", "id", "window", "tree", "pos", "node", "seen", "key")
    return docs.withColumns({c: F.lit(c) for c in names})


def found(docs, items):
    rows = decontaminate.contamination(docs, items).collect()
    return sorted([(r["id"], r["n_words"], [h["word"] for h in r["hits"]], list(r["items"])) for r in rows], key=key)


def test_contamination(spark):
    docs, items = plain.table(spark, "documents", LARGER), plain.table(spark, "benchmark", LARGER)
    for d, b in ((docs, items), (clashing(plain.odd_docs(spark)), odd_items(spark))):
        want = plain_hits(
            [(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect()]
        )
        assert found(d, b) == want
        assert any(x[2] for x in want) and not all(x[2] for x in want)


def test_contamination_by_blocks(spark, monkeypatch):
    docs, items = plain.odd_docs(spark), odd_items(spark)
    whole = found(docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 5)
    assert found(docs, items) == whole


def test_windows_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.choice(np.frombuffer(b"ab\0", np.uint8), 5000)
    raw[1000:1900] = 97  # longer than a piece
    whole = decontaminate.word_hashes(raw)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 300)
    decontaminate._kept().pop("powers")
    pieces = decontaminate.word_hashes(raw)
    decontaminate._kept().pop("powers")
    for a, b in zip(whole, pieces):
        assert (a == b).all()
    words = [bytes(raw[a:b]) for a, b in zip(*whole[:2])]
    assert words == [w for w in raw.tobytes().split(b"\0") if w]
    assert len(set(zip(words, whole[2].tolist()))) == len(set(words))


def test_spans_are_removed(spark):
    rows = [(1, "keep this. The same, line HERE! and that"), (2, "clean"), (3, None), (4, "the same line here"),
            (5, "é the same line here the same line here ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "the same line here")], "item_id long, text string")
    hits = decontaminate.contamination(docs, items)
    got = {r["id"]: r["text"] for r in decontaminate.removed(hits).collect()}
    assert got == {1: "keep this. ! and that", 2: "clean", 3: None, 4: "", 5: "é ü"}
    assert {r["id"] for r in decontaminate.removed(hits, whole=True).collect()} == {2, 3}


# --- whitening -------------------------------------------------------------------


def basis(seed, n):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 100, 40),
        np.logspace(-6, 6, 40),
        np.r_[[5] * 10, 5 + 1e-9 * np.arange(10), 5 + 1e-13 * np.arange(10), np.logspace(-6, 3, 10)],
        np.r_[np.linspace(1, 1 + 1e-7, 20), np.linspace(2, 2 + 1e-5, 20)],
        np.r_[[1.0] * 39, 1e9],
        np.r_[[1e-12] * 20, [1.0] * 20],
    ],
)
def test_eigenvectors(values):
    q = basis(3, len(values)).astype(np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-15 * np.abs(a).max()
    assert (np.diff(got) <= 1e-18 * got[0]).all()
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-14 * values.max()


def test_small_matrices():
    for a in (np.zeros((3, 3)), np.eye(4), np.array([[2.0]]), np.array([[2.0, 1], [1, 2]])):
        values, x = whitening.eigen(a.astype(np.longdouble))
        assert np.abs(a @ x - x * values).max() < 1e-17 and np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for reach in (2**10, 2**25, 2**45, 2**61):
        x = rng.integers(-reach, reach, (5000, 4))
        o = x.astype(object)
        assert (whitening.products(x, reach) == o.T @ o).all()
        assert (whitening.products(o, reach) == o.T @ o).all()


def plain_whitening(rows, k=32):
    good = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    n, x = len(good), np.array([x for _, x in good], object)
    d = x * n - x.sum(axis=0)
    v = (d.T @ d).astype(np.float64) / float(n) ** 3
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    z = (d / n).astype(float) @ q[:, :k] / np.sqrt(e[:k])
    return [i for i, _ in good], [int(s) for s in (d * d).sum(axis=1)], z, e[:k] / np.trace(v)


def test_whitening(spark):
    vectors = plain.table(spark, "embeddings", LARGER)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    rows += [(90_001, None), (90_002, [float("nan")] * 64), (90_003, [None] + [1.0] * 63), (90_004, []), (90_005, [1.0]),
             (90_006, [float("inf")] + [1.0] * 63)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame = frame.withColumns({c: F.lit("c") for c in ("x", "z", "_v", "n", "id")}).repartition(5)
    got = whitening.whiten(frame).toPandas()
    ids, deviation, z, explained = plain_whitening([r for r in rows if r[0] != 90_005])
    assert len(got) == 32 * len(ids) and (got["n"] == len(ids)).all()
    w = got.pivot(index="id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(w * np.sign((w * z).sum(axis=0)) - z).max() < 1e-10
    first = got[got["component"] == 1].set_index("id").loc[ids]
    assert first["deviation"].tolist() == deviation
    share = got[got["id"] == ids[0]].sort_values("component")["explained"].to_numpy()
    assert np.abs(share / explained - 1).max() < 1e-9
    cov = np.cov(w.T, bias=True)
    assert np.abs(cov - np.eye(32)).max() < 1e-12 and got["identity_error"].nunique() == 1
    assert got["identity_error"].iloc[0] < 1e-12


def test_whitening_of_far_values(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1e15]), (3, [1e300, 1.0]), (4, [5.0, 5.0]), (4, [5.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["id"] for r in got} == {1, 2, 4} and all(r["deviation"] is None for r in got)
    assert abs(max(r["whitened"] ** 2 for r in got) - 3) < 1e-9
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_whitening_without_variance(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(frame).count() == 0 and whitening.whiten(frame.limit(0)).count() == 0
    frame = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(frame).collect()} == {1}


# --- manifest --------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in under[a + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            above.append(digest(*run))
            below.append(sum(under[a : a + 16], []))
        nodes, under = above, below
    return nodes[0], paths


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    by = {}
    for r in rows:
        i, text = r["doc_id"], r["text"]
        head = [field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")]
        leaf = now = digest(*head, field(text))
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            now = digest(*head, field(text if text is None else small(text)))
        by.setdefault(r["source"], []).append(((i is not None, i or 0), leaf, now))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[1] for x in sorted(by[s])]) for s in names]
    if not names:
        return []
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (some, leaf, now), path in zip(sorted(by[name]), paths):
            for before, after in path + top:
                now = digest(*before, now, *after)
            proof = digest(*[d for a, b in path + top for d in a + b])
            out.append((some[1] if some[0] else None, leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=key)


def many(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 300}" if i % 3 else "hot", 3) for i in range(2500)]
    return spark.createDataFrame(rows, plain.DOCS)


@pytest.mark.parametrize("name", ["odd", "given", "many", "one", "none"])
def test_manifest(spark, name):
    docs = {
        "odd": clashing(plain.odd_docs(spark)),
        "given": plain.table(spark, "documents", LARGER),
        "many": many(spark),
        "one": many(spark).filter("doc_id = 7"),
        "none": many(spark).limit(0),
    }[name]
    got = sorted([tuple(r) for r in merkle.documents_manifest(docs).collect()], key=key)
    assert got == plain_manifest(docs.collect())


def test_manifest_of_more_tiers(spark, monkeypatch):
    docs = many(spark)
    want = sorted([tuple(r) for r in merkle.documents_manifest(docs).collect()], key=key)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    assert sorted([tuple(r) for r in merkle.documents_manifest(docs).collect()], key=key) == want


def test_appender():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300):
        nodes = [digest(str(i)) for i in range(n)]
        root, paths = merkle.grow(nodes, True)
        want, plain_paths = plain_tree(nodes)
        assert root == want
        for path, steps in zip(paths, plain_paths):
            assert [r for _, r in path] == ["".join(a + b) for a, b in steps]
        assert all(merkle.fold(d, p) == root for d, p in zip(nodes, paths))
        if n > 1:
            assert merkle.fold(nodes[1], paths[0]) != root


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_whitening", "op13_manifest"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "benchmark", "embeddings"):
        plain.table(spark, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
