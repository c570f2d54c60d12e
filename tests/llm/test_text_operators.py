"""Secrets, tokens, quality, toxicity, fingerprints and repeats against plain versions."""

import hashlib
import random

import numpy as np
import plain
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recapspark.llm import bpe, quality, queries, secrets, simhash, suffixes, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=["odd", "small"])
def docs(request, spark):
    return plain.odd_docs(spark) if request.param == "odd" else plain.table(spark, "documents")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_tokens_of_any_text(text):
    if not hasattr(test_tokens_of_any_text, "both"):
        test_tokens_of_any_text.both = bpe.Codec(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)
    codec, library = test_tokens_of_any_text.both
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_never_inside_a_token(codec):
    for token in list(codec.vocab)[::37]:
        symbols = codec._symbols(token)
        assert all(pair in codec.joined for pair in zip(symbols, symbols[1:]))


def test_tokens(spark, docs, library):
    vocabulary = bpe.read_vocabulary(PATH)
    got = {}
    for r in bpe.digests(docs, vocabulary).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    want = {}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.setdefault(r["doc_id"], []).append((len(ids), sha, hashlib.sha256(text.encode()).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_secrets(spark, docs):
    scanned = secrets.scan(docs, secrets.fit(docs))
    rows = scanned.withColumn("listed", secrets.listed(F.col("_spans"))).withColumn(
        "clean", secrets.redact(F.col("text"), F.col("_spans"))
    ).collect()
    assert len(rows) == docs.count()
    found = 0
    for r in rows:
        spans = [(s["start"], s["kind"], s["end"]) for s in r["_spans"]]
        base = plain.base_spans(r["text"])
        assert [s for s in spans if s[1] < 3] == base
        assert plain.listed(spans) == r["listed"] and spans == sorted(spans)
        added = [s for s in spans if s[1] == 3]
        assert not any(a < e and s < b for a, _, b in added for s, _, e in base)
        covered = set()
        for a, _, b in spans:
            covered |= set(range(a, b))
        text = r["text"]
        if text is None or not spans:
            assert r["clean"] == text
        else:
            kept = "".join(c for i, c in enumerate(text) if i not in covered)
            assert r["clean"].replace("<secret>", "") == kept
        found += len(spans)
    assert found > 0


def test_markov_models_tell_random_from_ordinary(spark):
    docs = plain.table(spark, "documents", "/root/testdata/sf0.01")
    ratios = secrets.fit(docs)
    random.seed(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strange = ["".join(random.choices(letters, k=32)) for _ in range(200)]
    words = [w for r in docs.filter("doc_id % 7 = 0 and lang = 'en'").collect() for w in plain.words(r["text"]) if w.isalpha()]
    usual = ["_".join(words[i : i + 4]) for i in range(0, 1600, 4)]
    rows = [(s, 1) for s in strange] + [(s, 0) for s in usual if len(s) >= 20 and s.isascii()]
    frame = spark.createDataFrame(rows, "s string, random int")
    got = frame.select("random", (secrets.log_ratio(F.col("s"), ratios) >= secrets.THRESHOLD).alias("hit"))
    rate = {r["random"]: r["rate"] for r in got.groupBy("random").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.95 and rate[0] < 0.01


def test_secrets_within_longer_runs(spark):
    docs = plain.table(spark, "documents", "/root/testdata/sf0.01")
    random.seed(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    one, two = ("".join(random.choices(letters, k=40)) for _ in range(2))
    path = "home/people/documents/letters/summer/holiday/pictures/mountain/valley/river"
    far = "/".join([path] * 3)
    texts = [
        f"see 0123456789abcdef0/{one} here",
        f"see {path}/{one}/{path} here",
        f"see {far}/{one}/{far}/{two}/{far} here",
        f"see the_long_name_of_some_ordinary_parameter_value_in_another_place={one} here",
        f"see {one}/{path}-0123456789abcdef0-{two}",
        f"see {path} here",
    ]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    scanned = secrets.scan(spark.createDataFrame(rows, plain.DOCS), secrets.fit(docs))
    clean = scanned.select(
        "doc_id", secrets.redact(F.col("text"), F.col("_spans")).alias("c")
    )
    got = {r["doc_id"]: r["c"] for r in clean.collect()}
    assert not any(s in c for c in got.values() for s in (one, two))
    assert got[1] == f"see {path}/<secret>/{path} here"
    assert got[2] == f"see {far}/<secret>/{far}/<secret>/{far} here"
    assert got[5] == texts[5]


def test_markov_spans_equal_a_plain_scorer(spark):
    ratios = secrets.fit(plain.table(spark, "documents", "/root/testdata/sf0.01"))
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = "home people documents letters summer value parameter ordinary name X9 2024".split()

    def part():
        if rng.random() < 0.4:
            return "".join(rng.choices(letters, k=rng.choice([3, 8, 11, 12, 13, 15, 19, 20, 33])))
        return rng.choice(names)

    def run():
        return "".join(part() + rng.choice("/_=-+") for _ in range(rng.randrange(6))) + part()

    texts = [" ".join(run() for _ in range(6)) + rng.choice(["", " é token=abcdefghijkl/0123456789abcdef"]) for _ in range(150)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    scanned = secrets.scan(spark.createDataFrame(rows, plain.DOCS), ratios).select("doc_id", "_spans")
    short = 0
    for r in scanned.collect():
        got = [(s["start"], s["kind"], s["end"]) for s in r["_spans"] if s["kind"] == 3]
        assert got == plain.markov_spans(texts[r["doc_id"]], ratios)
        short += sum(b - a < 20 for a, _, b in got)
    assert short > 10


def test_many_spans_in_one_text(spark):
    """Fifty thousand spans: places, counts and redaction without a growing array per span."""
    rng = random.Random(2)
    words = ["%032x" % rng.getrandbits(128) for _ in range(50_000)]
    text = "é " + " ".join(words)
    rows = [(1, text, "en", "s", len(text))]
    ratios = [0.0] * (68 * 68)
    scanned = secrets.scan(spark.createDataFrame(rows, plain.DOCS), ratios)
    row = scanned.select("_spans", secrets.redact(F.col("text"), F.col("_spans")).alias("c")).first()
    assert [(s["start"], s["kind"], s["end"]) for s in row["_spans"]] == [(2 + 33 * i, 2, 34 + 33 * i) for i in range(50_000)]
    assert row["c"] == "é " + " ".join(["<secret>"] * 50_000)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, size):
    numbers = [(i * 37) % 11 for i in range(size)]
    frame = spark.createDataFrame([(numbers,)], "n array<int>")
    got = frame.select(secrets._before(F.col("n"), lambda a, b: a + b).alias("s")).first()["s"]
    assert got == [sum(numbers[:i]) for i in range(size + 1)]


def test_short_terms_match_with_an_edit():
    model = toxicity.Model({"idiot": 1.0, "trash": 1.0, "scum": 1.0, "moron": 0.5}, frozenset(["crash"]))
    scorer = toxicity.Scorer(model)
    for word, term in [("id1ot", "idiot"), ("tr4sh", "trash"), ("scumm", "scum"), ("morron", "moron")]:
        assert scorer._hit(word) == (term, 1)
    assert scorer._hit("crash") is None and scorer._hit("idiot") == ("idiot", 0)


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([], "id long, good boolean")
    got = sorted(
        ((r["id"] is None, r["id"] or 0), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in quality.judge(docs, labels).collect()
    )
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), *plain.quality(r["text"])) for r in docs.collect())
    assert got == want


def test_quality_risk(spark):
    """Of good documents no more are lost than allowed; a rule that finds bad ones is used."""
    good = np.zeros(quality.BINS + 1, int)
    good[0] = 5000
    bad = np.zeros_like(good)
    bad[150] = 100
    assert quality.choose_cutoff(good, good, bad, 0.01, 0.001) is not None
    assert quality.choose_cutoff(good, good, np.zeros_like(bad), 0.01, 0.001) is None
    few = good // 100
    assert quality.choose_cutoff(few, few, bad, 0.01, 0.001) is None
    assert abs(quality.binomial_upper(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9
    assert quality.binomial_upper(5, 5, 0.05) == 1.0

    text = "fine words stand here in some number " * 1
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + text, "en") for i in range(6000)]
    rows += [(10_000 + i, " ".join(f"#{i}$%&x{j}" for j in range(60)), "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") < 10_000).alias("good"))
    kept = quality.judge(docs, labels).groupBy(F.col("id") < 10_000).agg(F.avg(F.col("kept").cast("int"))).collect()
    assert dict(map(tuple, kept)) == {True: 1.0, False: 0.0}


def test_automaton():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    random.seed(5)
    terms = ["moron", "idiots", "worthless", "clowns", "abcabc", "abcabd", "bcabcab"]
    automaton = toxicity.TermAutomaton(terms)
    for _ in range(4000):
        w = list(random.choice(terms))
        for _ in range(random.randint(0, 2)):
            i = random.randrange(len(w) + 1)
            w[i : i + random.randint(0, 1)] = random.choice(["", "a", "b", "z", "s"])
        w = "".join(w)
        want = min(((d, t) for t in terms if (d := edits(w, t)) == 0 or (d == 1 and len(t) >= toxicity.MIN_FUZZY)), default=None)
        got = automaton.match(w)
        assert (got and (got[1], got[0])) == want, w


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op9_toxicity(spark, folder)
    labels = plain.table(spark, "labels", folder)
    rows = scored.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n[1, 1] > 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) < 0.01 * n[0, 0]


def test_toxicity_odd_rows(spark):
    docs = plain.odd_docs(spark).withColumn("score", F.lit(1))
    for labels in ([], [(1, None), (None, 1), (2, 0)], [(2, 0), (3, 1), (3, 0), (4, 0), (6, 1)]):
        labels = spark.createDataFrame(labels, "id long, toxic int")
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r["_score"] <= 1 for r in rows)


def test_every_term_over_the_odds_is_in_the_lexicon(spark):
    """More terms than any cap would leave, terms of any length, and only words near a term exempt."""
    rng = random.Random(6)
    marked = ["".join(rng.choices("bcdfgkmprtz", k=9)) for _ in range(2_500)] + ["q" * 60]
    usual = ["".join(rng.choices("aeioulns", k=7)) for _ in range(300)]
    docs, labels = [], []
    for i in range(240):
        toxic = i % 2
        words = rng.choices(usual, k=40) + (marked if toxic else [marked[0][:-1] + "y"] * 3)
        docs.append((i, " ".join([f"x{i}", *words])))
        labels.append((i, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "id long, toxic int"))
    assert set(marked) <= set(model.terms) and not set(usual) & set(model.terms)
    assert marked[0][:-1] + "y" in model.common and len(model.common) < 20


def test_quoted_hits_weigh_less():
    model = toxicity.Model({"worthless": 1.0}, frozenset())
    scorer = toxicity.Scorer(model)
    plainly = scorer.features("you are worthless today")
    quoted = scorer.features('the sign read "worthless" today')
    assert plainly[0] > 0 and plainly[1] == 0 and plainly[4] > 0
    assert quoted[0] == 0 and quoted[1] > 0 and quoted[5] < plainly[5]
    assert scorer.features("so w0rthless")[2] > 0


def _by_key(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("crowded", [4096, 2])
def test_near_duplicates(spark, docs, crowded):
    rows = docs.collect()
    fps = [plain.fingerprint(r["text"]) for r in rows]
    part = plain.components(range(len(rows)), plain.close_pairs(fps))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[part[i]] = min(least.get(part[i], r["doc_id"]), r["doc_id"])
    want = _by_key((r["doc_id"], fps[i], least.get(part[i])) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs, crowded=crowded).collect()
    assert _by_key((r["id"], r["fp"] % 2**64, r["component"]) for r in got) == want


def test_crowded_blocks(spark):
    """A dense cloud of fingerprints: the meeting points give the components of all pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 4)
    fps = {int(b) ^ sum(1 << int(i) for i in rng.integers(0, 64, rng.integers(0, 7))) for b in base for _ in range(60)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = plain.components(range(len(fps)), plain.close_pairs(fps))
    for crowded in (1, 4096):
        edges = simhash.near_pairs(frame, crowded=crowded).collect()
        place = {f: i for i, f in enumerate(fps)}
        edges = [(place[r["a"] % 2**64], place[r["b"] % 2**64]) for r in edges]
        assert plain.components(range(len(fps)), edges) == want


@pytest.mark.parametrize(
    "options", [{}, {"crowded": 1}, {"heavy": 2, "sample": 1}, {"heavy": 3, "sample": 2, "crowded": 1}]
)
def test_repeats(spark, docs, options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = _by_key((i, *x) for (i, _), x in zip(rows, plain.repeats(rows)))
    got = suffixes.repeats(docs, **options).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert _by_key(got) == want


def test_heavy_anchor_is_spread(spark):
    """One phrase in every document, each time between other words, and one passage in many."""
    rng = np.random.default_rng(12)
    phrase = "a phrase shared by all of them, long, yet shorter than what counts as a repeat"
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(3000)]
    passage = " ".join(words[:20])
    rows = []
    for i in range(400):
        some = [words[j] for j in rng.integers(20, 3000, 24)]
        text = " ".join([*some[:12], phrase, *some[12:]])
        rows.append((i, f"{text} {passage}" if i % 3 == 0 else text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = docs.select(
        F.col("doc_id").alias("doc"), F.lit(0).alias("tag"), F.col("text").cast("binary").alias("text")
    )
    anchors = suffixes._heavy_anchors(keyed, suffixes.LENGTH, 150, 1)
    assert anchors.count() > 0
    marked = suffixes._spread_heavy(suffixes._all_runs(keyed, suffixes.LENGTH), anchors).cache()
    open_, spread = (marked.filter(F.col("kind") == k) for k in (suffixes._OPEN, suffixes._SPREAD))
    assert open_.join(anchors, "key").count() == 0
    assert spread.join(anchors, "key", "left_anti").count() == 0 and spread.count() >= 150
    want = _by_key((i, *x) for (i, _), x in zip(rows, plain.repeats(rows)))
    for options in ({}, {"heavy": 150, "sample": 1}, {"heavy": 150, "sample": 1, "crowded": 50}):
        got = suffixes.repeats(docs, **options).collect()
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
        assert _by_key(got) == want


def test_bounded_prefixes():
    rng = np.random.default_rng(8)
    for size, letters in ((300, 2), (500, 3), (400, 20)):
        text = rng.integers(97, 97 + letters, size).astype(np.uint8)
        text[100:160] = text[10:70]
        text[-1] = 255
        order = suffixes.sorted_suffixes(text, 32)
        raw = text.tobytes()
        assert [raw[i : i + 32] for i in order] == sorted(raw[i : i + 32] for i in range(size))
        for length in (1, 5, 20):
            got = suffixes.bounded_prefixes(text, order, length)
            keys = [raw[i : i + length] for i in order]
            want = [i == 0 or keys[i] != keys[i - 1] for i in range(size)]
            short = np.array([len(k) < length for k in keys])
            assert (got == want)[~short].all()


def test_transform_sees_only_what_may_repeat():
    """Runs of one anchor: few share a window of 100 bytes; the others need no transform."""
    rng = np.random.default_rng(21)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    phrase, left, right = letters(40), letters(200), letters(200)
    texts = [letters(150) + phrase + letters(150) for _ in range(300)]
    for i in range(40):  # shared: some bytes to the left and to the right, often too few
        a, b = (int(x) for x in rng.integers(0, 90, 2))
        texts.append(letters(150) + left[200 - a :] + phrase + right[:b] + letters(150))
    found = [], [], [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        key, _, begin, stop = suffixes.runs(data, np.array([len(data)]), suffixes._Powers())
        for out, x in zip(found, (key, np.full(len(key), i), begin, [text[a:b] for a, b in zip(begin, stop)])):
            out.extend(x)
    cuts = found[3] + [found[3][0][:100]] * 2  # windows on their own, under a key that is no anchor
    anchor = np.array([*found[0], 5, 5], np.uint64)
    doc, start = np.array([*found[1], 900, 901]), np.array([*found[2], 0, 0])

    def windows(cuts, anchor, doc, start):
        out = set()
        for key in np.unique(anchor):
            own = np.flatnonzero(anchor == key)
            piece, offset = suffixes.repeated_windows([cuts[i] for i in own], doc[own], start[own])
            out |= set(zip(doc[own][piece].tolist(), (start[own][piece] + offset).tolist()))
        return out

    which, begin, stop = suffixes.may_repeat(cuts, anchor)
    less = [cuts[i][a:b] for i, a, b in zip(which, begin, stop)]
    want = windows(cuts, anchor, doc, start)
    assert len(want) > 100 and (901, 0) in want
    assert windows(less, anchor[which], doc[which], start[which] + begin) == want
    assert len(cuts) > 2000 and sum(map(len, less)) < 0.1 * sum(map(len, cuts))


def test_least_places():
    rng = np.random.default_rng(22)
    for kinds, size, width in [(1, 300, 77), (2, 400, 77), (3, 90, 7), (50, 500, 77), (10**9, 500, 77), (4, 77, 77), (5, 60, 1)]:
        for values in (rng.integers(0, kinds, size), np.resize(rng.integers(0, kinds, 5), size)):
            first, place = suffixes.least_places(values.astype(np.uint64), width)
            got = np.repeat(place, np.diff(first, append=size - width + 1))
            assert got.tolist() == [i + int(values[i : i + width].argmin()) for i in range(size - width + 1)]


def test_merged_stretches():
    row, start, size = np.array([0, 0, 2, 0, 2, 3]), np.array([5, 0, 0, 12, 4, 0]), np.array([3, 5, 9, 2, 2, 1])
    got = [x.tolist() for x in suffixes.merged(row, start, size, np.array([14, 0, 9, 8]))]
    assert got == [[0, 0, 2, 3], [0, 12, 0, 0], [8, 14, 9, 1]]
    assert all(len(x) == 0 for x in suffixes.merged(row[:0], start[:0], size[:0], np.array([3])))


@pytest.mark.parametrize("name", ["op1_secrets", "op2_bpe", "op3_quality_rules", "op5_suffix_array", "op9_toxicity", "op10_simhash"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels"):
        plain.table(spark, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
    assert SMALL


def test_binomial_tail_at_any_size():
    from math import comb

    for total in (1, 5, 40, 200):
        for rejected in range(0, total, max(1, total // 7)):
            for rate in (0.001, 0.05, 0.3, 0.9):
                want = sum(comb(total, k) * rate**k * (1 - rate) ** (total - k) for k in range(rejected + 1))
                assert quality.at_most(rejected, total, rate) == pytest.approx(want, rel=1e-9, abs=1e-13)
    assert quality.at_most(10**7 // 20, 10**7, 0.05) == pytest.approx(0.5, abs=1e-3)


def plain_cutoff(holdout, tune_good, tune_bad, risk, error):
    best, gain = None, 0.0
    for cut in range(quality.BINS, 0, -1):
        n, total = int(sum(holdout[cut:])), int(sum(holdout))
        if not total or n / total > risk or quality.binomial_upper(n, total, error) > risk:
            break
        found = sum(tune_bad[cut:]) / max(1, sum(tune_bad)) - sum(tune_good[cut:]) / max(1, sum(tune_good))
        if found > gain:
            best, gain = cut, found
    return best


def test_cutoffs_of_many_labels():
    rng = np.random.default_rng(8)
    for size in (0, 30, 1000, 10**7):
        for _ in range(4):
            shape = 0.5 ** np.arange(quality.BINS + 1)
            counts = [rng.multinomial(size, s / s.sum()) for s in (shape, shape, shape[::-1] + 0.01)]
            assert quality.choose_cutoff(*counts, 0.01, 0.001) == plain_cutoff(*counts, 0.01, 0.001)


def test_kept_is_what_a_plain_chooser_says(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = plain.table(spark, "documents", folder), plain.table(spark, "labels", folder)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0"))  # copies must not vote again
    marks = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"))
    got = {r["id"]: r["kept"] for r in quality.judge(docs, marks).collect()}
    rows = quality.features(docs).select("id", "stratum", "mark", "n_words", "n_repeat_words", *quality._bins(),
                                         F.pmod(F.xxhash64("mark"), F.lit(2)).alias("half")).collect()
    good = {r["id"]: r["good"] for r in marks.collect()}
    strata, votes = {r["stratum"] for r in rows if r["id"] in good}, {}
    for r in rows:
        if r["id"] in good:
            key = r["stratum"], r["mark"]
            votes[key] = (votes.get(key, (True, r))[0] and good[r["id"]], r)
    level = 0.05 / (max(1, len(strata)) * len(quality.RULES))
    cut = {}
    for s in strata:
        for rule in quality.RULES:
            count = lambda half, is_good: np.bincount([int(r[rule]) for g, r in votes.values() if r["stratum"] == s and r["half"] == half and g == is_good], minlength=quality.BINS + 1)
            cut[s, rule] = plain_cutoff(count(1, True), count(0, True), count(0, False), 0.05 / len(quality.RULES), level)
    for r in rows:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        failed = [q for q in quality.RULES if cut.get((r["stratum"], q)) is not None and r[q] >= cut[r["stratum"], q]]
        assert got[r["id"]] == (not base and not failed)
