"""Toxicity: a lexicon learnt from labels, Levenshtein automata, context windows.

The lexicon holds the words, and beginnings of words, that mark labelled toxic texts. Its trie and the Levenshtein
automaton of at most one edit are run together as one deterministic automaton whose states
are built when first met, so a word costs a few steps until no term can match any more.
Every hit is weighed by its surroundings: a hit between quotation marks or beside words
of reporting counts as quotation, one beside words of address as abuse. A logistic model
over those counts gives the score. NULL and empty texts have no hits and
get the score of a text without hits; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapspark.operators.storage import stored

#: Bound of the labelled sample that lexicon and model are fitted on (documents, by hash of id).
MAX_TRAIN = 20_000
THRESHOLD = 0.7
MIN_ODDS = 8.0  # lower bound of a term's odds ratio
MIN_FUZZY = 4  # shorter terms match only as they are
STEMS = (6, 5, 4)  # lengths of word beginnings that can be terms, written with a star
REMEMBERED = 100_000  # words whose match a scorer remembers; then it starts anew
WINDOW = 5  # words to either side

# Words that mark reported speech or address.
REPORTING = frozenset(
    "said says called calls quote quoted word words wrote term nannte sagte wort zitat "
    "dit mot appelé cité dijo llamó palabra cita".split()
)
ADDRESS = frozenset("you your you're u du dich dein ihr euch tu te toi vous votre tú usted".split())
QUOTES = "\"“”„«»‹›"

_WORD = re.compile(r"\w+(?:[*@$]\w+)*")
_FEATURES = 7


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class TermAutomaton:
    """Matches words against all terms at once, with at most one edit for longer terms."""

    #: States kept before the automaton is built anew.
    MAX_STATES = 100_000

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.depth = [0]
        self.longest = [0]  # longest term below each node: decides if an edit may pay
        for term in terms:
            node = 0
            for c in term:
                self.longest[node] = max(self.longest[node], len(term))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.longest.append(0)
                node = self.children[node][c]
            self.longest[node] = max(self.longest[node], len(term))
            self.term[node] = term
        self._reset()

    def _reset(self):
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, pairs):
        """Add what is reached by leaving out a letter of the term."""
        out = set(pairs)
        for node, edits in pairs:
            if edits == 0:
                out.update(
                    (child, 1)
                    for child in self.children[node].values()
                    if self.longest[child] >= MIN_FUZZY
                )
        # a node without edits makes the same node with one superfluous only for its own term
        return frozenset(p for p in out if p[1] == 0 or (p[0], 0) not in out)

    def _number(self, state) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return found

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, edits))
            if edits == 0 and self.longest[node] >= MIN_FUZZY:
                out.add((node, 1))  # a letter too many
                out.update((x, 1) for x in self.children[node].values())  # another letter
        number = self._number(self._closed(out)) if out else -1
        self.steps[state][c] = number
        return number

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, 0 or 1; the smallest term of equals."""
        if len(self.states) > self.MAX_STATES:
            self._reset()
        state = self.start
        for c in word:
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if state < 0:
                return None
        best = None
        for node, edits in self.states[state]:
            term = self.term[node]
            if term is None or (edits and len(term) < MIN_FUZZY):
                continue
            if best is None or (edits, term) < best:
                best = (edits, term)
        return (best[1], best[0]) if best else None


@dataclass
class Model:
    """What scoring needs: terms with their weights, common words, logistic weights."""

    terms: dict[str, float]
    common: frozenset
    weights: np.ndarray | None = None


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = TermAutomaton(sorted(t for t in model.terms if not t.endswith("*")))
        self.hits: dict[str, tuple[str, int] | None] = {}

    def _hit(self, word: str):
        found = self.automaton.match(word)
        if found and not found[1]:
            return found
        for n in STEMS:
            if len(word) > n and word[:n] + "*" in self.model.terms:
                return word[:n] + "*", 0
        # an ordinary word may happen to be near a term
        return None if word in self.model.common else found

    def features(self, text: str | None) -> list[float]:
        """Weights of the different terms hit, by kind of hit; see the module."""
        kinds: list[dict[str, float]] = [{} for _ in range(5)]
        strongest = 0.0
        text = text or ""
        words = words_of(text)
        if len(self.hits) > REMEMBERED:
            self.hits.clear()
        hits, found = self.hits, set()
        for word in set(words):
            if word not in hits:
                hits[word] = self._hit(word)
            if hits[word]:
                found.add(word)
        if found:
            quoted = self._quoted(text, found)
            for i, word in enumerate(words):
                if word not in found:
                    continue
                edits = hits[word][1]
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                report = any(w in REPORTING for w in near)
                is_quoted = report or (word in quoted and next(quoted[word], False))
                term = hits[word][0]
                weight = self.model.terms[term]
                kinds[2 * edits + is_quoted][term] = weight
                if any(w in ADDRESS for w in near):
                    kinds[4][term] = weight
                strongest = max(strongest, weight * (0.5 if is_quoted else 1.0) / (1 + edits))
        sums = [math.log1p(sum(k.values())) for k in kinds]
        return [*sums, strongest, min(1.0, 20 * len(found) / (len(words) + 50))]

    @staticmethod
    def _quoted(text: str, found) -> dict:
        """For words with a quotation mark in the text: is each occurrence inside a pair?"""
        if not any(q in text for q in QUOTES):
            return {}
        out: dict[str, list[bool]] = {}
        for line in text.lower().split("\n"):
            marks = [i for i, c in enumerate(line) if c in QUOTES]
            before = 0
            for m in _WORD.finditer(line):
                while before < len(marks) and marks[before] < m.start():
                    before += 1
                if m.group() in found:
                    inside = before % 2 == 1 and before < len(marks)
                    out.setdefault(m.group(), []).append(inside)
        return {w: iter(x) for w, x in out.items()}

    def score(self, text: str | None) -> float:
        if self.model.weights is None:
            return 0.0
        z = float(np.dot(self.model.weights, [1.0, *self.features(text)]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column of ``x`` is constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        size = np.abs(change).max()
        w += change * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def held_out(id_column: Column) -> Column:
    """True for rows that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = MAX_TRAIN,
) -> Model:
    """Lexicon and model from at most ``max_train`` labelled documents that are not held out.

    ``labels`` has ``(id, toxic)``; a document with several labels is toxic if one says so.
    Words are counted once per different text. Every word or beginning whose odds ratio is
    above ``MIN_ODDS`` with confidence is a term, however many there are. A common word that an
    edit of a term would take for it is exempt; only such words leave Spark, with the terms
    and seven numbers per training document. The logistic model is fitted on hits of terms learnt
    from the other half of the texts, so it learns how far terms can be trusted on texts
    they were not learnt from.
    """
    marks = (
        labels.filter(F.col("id").isNotNull() & F.col("toxic").isNotNull())
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)
    )
    train = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(marks), "id")
        .groupBy(F.sha2("text", 256).alias("sha"))
        .agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    )

    def tokens(batches):
        for batch in batches:
            words, row = [], []
            for i, text in enumerate(batch.column(0)):
                own = {w for w in words_of(text.as_py() or "") if len(w) >= 3}
                own |= {w[:n] + "*" for w in own for n in STEMS if len(w) > n}
                words += own
                row += [i] * len(own)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), batch.column(1).take(row), batch.column(2).take(row)],
                names=["word", "toxic", "fold"],
            )

    fold = F.pmod(F.xxhash64("sha"), F.lit(2))
    train = stored(train.withColumn("fold", fold.cast("int")), "train")
    totals = {
        (r["fold"], r["toxic"]): r["n"]
        for r in train.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()
    }
    n_toxic, n_clean = (sum(n for (_, t), n in totals.items() if t == mark) for mark in (1, 0))
    if not n_toxic or not n_clean:
        return Model({}, frozenset())

    def count(toxic, part):
        return F.sum(((F.col("toxic") == toxic) & (F.col("fold") == part)).cast("long"))

    table = (
        train.select("text", "toxic", "fold")
        .mapInArrow(tokens, "word string, toxic int, fold int")
        .groupBy("word")
        .agg(*[count(t, f).alias(f"n{t}{f}") for t in (0, 1) for f in (0, 1)])
        .withColumn("bad", F.col("n10") + F.col("n11"))
        .withColumn("fine", F.col("n00") + F.col("n01"))
    )
    table = stored(table, "words")
    marked = F.col("bad") * n_clean > 4 * F.col("fine") * n_toxic
    usual = (F.col("fine") >= 2) & ~marked

    def lexicon(folds) -> Model:
        b = sum((F.col(f"n1{f}") for f in folds), F.lit(0))
        c = sum((F.col(f"n0{f}") for f in folds), F.lit(0))
        bad = sum(totals.get((f, 1), 0) for f in folds)
        fine = sum(totals.get((f, 0), 0) for f in folds)
        odds = F.log((b + 0.5) / (bad + 1)) - F.log((c + 0.5) / (fine + 1))
        sure = odds - 1.64 * F.sqrt(1 / F.greatest(b, F.lit(1)) + 1 / (c + 1))
        found = (
            table.filter((F.col("bad") >= 2) & marked & (b > 0))
            .select("word", sure.alias("sure"))
            .filter(F.col("sure") > math.log(MIN_ODDS))
            .collect()
        )
        most = max((r["sure"] for r in found), default=1.0)
        terms = {r["word"]: r["sure"] / most for r in sorted(found)}

        def near(batches):
            automaton = Scorer(Model(terms, frozenset())).automaton
            for batch in batches:
                words = batch.column(0).to_pylist()
                met = [w for w in words if (found := automaton.match(w)) and found[1]]
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.string())], names=["word"])

        whole = table.filter(usual & ~F.endswith("word", F.lit("*"))).select("word")
        exempt = whole.mapInArrow(near, "word string").collect()
        return Model(terms, frozenset(r["word"] for r in exempt))

    apart = {0: lexicon([1]), 1: lexicon([0])}

    def measure(batches):
        scorers = {f: Scorer(m) for f, m in apart.items()}
        for batch in batches:
            parts = batch.column(2).to_pylist()
            rows = [scorers[f].features(t.as_py()) for f, t in zip(parts, batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"]
            )

    rows = (
        train.select("text", "toxic", "fold")
        .mapInArrow(measure, "x array<double>, toxic int")
        .collect()
    )
    x = np.array([[1.0, *r["x"]] for r in rows])
    model = lexicon([0, 1])
    model.weights = logistic(x, np.array([r["toxic"] for r in rows], float))
    return model


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` and ``_score``, the probability of being toxic."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"]
            )

    return docs.mapInArrow(run, schema)
