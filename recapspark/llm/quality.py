"""Quality rules with risk-controlled cutoffs.

Words are runs of characters other than space and 0x09-0x0D. A NULL or empty text has no
words and fails the base rules. On top of them every rule of ``RULES`` (a share between 0
and 1 that is high in bad texts) gets a cutoff per stratum, chosen on labelled documents:

* the labelled documents are halved by a hash of their id;
* on the holdout half the false rejection rate of a cutoff, the share of good documents that it
  rejects, must be below ``risk / rules`` by an exact binomial (Clopper-Pearson) upper bound.
  Cutoffs are tested from lax to strict and the test stops at the first failure, which needs
  no correction along the cutoffs; over strata and rules the error level is divided
  (Bonferroni). So with probability ``1 - error`` all rules together reject at most ``risk`` of
  the good documents of every stratum;
* among the certified cutoffs the other half picks the one that rejects most bad beyond good
  documents, the laxest of equals. A rule that rejects no more bad than good ones stays off.

A stratum with too few labels certifies nothing and only the base rules act there. A
document with several labels counts as bad if one of them says so; NULL labels do not count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapspark.operators.storage import stored

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "shouts", "capitals", "dup_lines", "repeat_words", "long_words")
BINS = 200
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_EXTRA = ("n_shouts", "n_capitals", "n_letters")
_SCHEMA = ", ".join(f"{c} long" for c in (*_COUNTS, *_EXTRA))


def _repeated(words: list[bytes]) -> int:
    """Number of words inside 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    window = pair[:-1] * len(number) + ids[2:]
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``_COUNTS`` and ``_EXTRA`` for one text."""
    if not text:
        return (0,) * (len(_COUNTS) + len(_EXTRA))
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at space and 0x09-0x0D alone
    blanks = sum(raw.count(b) for b in b" \t\n\x0b\x0c\r")
    symbols = sum(raw.count(s) for s in SYMBOLS.encode())
    lines = [x for x in raw.split(b"\n") if x.split()]
    if text.isascii():
        capitals = len(text) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        letters = len(text) - len(
            raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        )
    else:
        capitals = sum(map(str.isupper, text))
        letters = sum(map(str.isalpha, text))
    return (
        len(words),
        len(text) - blanks,
        symbols,
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        raw.count(b"!"),
        capitals,
        letters,
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             stratum_col: str = "lang") -> DataFrame:
    """``(id, stratum, mark, counts...)``, one row per row of ``docs``; ``mark`` tells texts apart."""

    def run(batches):
        for batch in batches:
            rows = np.array([counts(t.as_py()) for t in batch.column(2)], np.int64)
            columns = [pa.array(c) for c in rows.reshape(len(batch), -1).T]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), *columns],
                names=["id", "stratum", "mark", *_COUNTS, *_EXTRA],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(stratum_col).cast("string").alias("stratum"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
    ).mapInArrow(run, f"id {kind}, stratum string, mark long, {_SCHEMA}")


def _bins() -> list:
    """Bin 0..BINS of every rule's share."""

    def share(part, whole):
        return F.floor(F.least(F.col(part) * BINS / F.greatest(F.col(whole), F.lit(1)), F.lit(BINS)))

    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return [
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_shouts", "word_chars").alias("shouts"),
        share("n_capitals", "n_letters").alias("capitals"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeat_words"),
        F.floor(F.least(mean * BINS / 50, F.lit(BINS))).alias("long_words"),
    ]


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100 + 20 * int(math.sqrt(max(a, b)))):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 + term * d, 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) * value / a


def at_most(rejected: int, total: int, rate: float) -> float:
    """Probability that at most ``rejected`` of ``total`` are, each with probability ``rate``."""
    return 1.0 if rejected >= total else _beta_share(1 - rate, total - rejected, rejected + 1)


def binomial_upper(rejected: int, total: int, error: float) -> float:
    """Largest rate under which ``rejected`` or fewer of ``total`` has probability >= ``error``."""
    if rejected >= total:
        return 1.0
    low, high = rejected / total, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if middle <= 0 or at_most(rejected, total, middle) >= error:
            low = middle
        else:
            high = middle
    return high


def choose_cutoff(holdout_good, tune_good, tune_bad, risk: float, error: float) -> int | None:
    """The first rejected bin, or None. Arguments: counts per bin 0..BINS; see the module."""
    total = int(sum(holdout_good))
    best, gain = None, 0.0
    good, bad = max(1, sum(tune_good)), max(1, sum(tune_bad))
    # rejected of the holdout at each cutoff; the bound grows with it, so halving finds the last
    rejected = np.cumsum(np.asarray(holdout_good, np.int64)[::-1])[::-1]

    def certified(cut):
        n = int(rejected[cut])
        return total > 0 and n <= risk * total and n < total and at_most(n, total, risk) < error

    low, high = 1, BINS + 1  # certified from ``high`` on
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if certified(middle) else (middle + 1, high)
    tail_good = tail_bad = 0
    for cut in range(BINS, high - 1, -1):
        tail_good += tune_good[cut]
        tail_bad += tune_bad[cut]
        found = tail_bad / bad - tail_good / good
        if found > gain:
            best, gain = cut, found
    return best


def cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05
) -> DataFrame:
    """``(stratum, <rule>...)``: the first rejected bin of every rule, NULL where off.

    ``measured`` is :func:`features`, ``labels`` has ``(id, good)``. A text votes once per stratum,
    however many rows have it, good only if no label says otherwise: copies aren't independent
    trials. Equal texts fall into the same half. Labels are counted per
    stratum, rule and bin before they meet, so a task gets at most a few thousand counts.
    """
    marks = (
        labels.filter(F.col("id").isNotNull() & F.col("good").isNotNull())
        .groupBy("id")
        .agg(F.min(F.col("good").cast("int")).alias("good"))
    )
    half = F.pmod(F.xxhash64("mark"), F.lit(2)).alias("half")
    votes = measured.join(marks, "id").groupBy("stratum", "mark").agg(
        F.min("good").alias("good"), *[F.first(c).alias(c) for c in (*_COUNTS, *_EXTRA)]
    )
    stack = ", ".join(f"'{r}', {r}" for r in RULES)
    table = (
        votes.select("stratum", half, "good", *_bins())
        .select("stratum", "half", "good", F.expr(f"stack({len(RULES)}, {stack}) as (rule, bin)"))
        .groupBy("stratum", "half", "good", "rule", "bin")
        .count()
    )
    table = stored(table, "label-counts")
    strata = max(1, table.select("stratum").distinct().count())
    level = error / (strata * len(RULES))

    def choose(frame):
        first = frame.iloc[0]
        parts = {}
        for half, good in ((0, 1), (0, 0), (1, 1)):
            own = frame[(frame["half"] == half) & (frame["good"] == good)]
            parts[half, good] = np.bincount(
                own["bin"], weights=own["count"], minlength=BINS + 1
            ).astype(int)
        cut = choose_cutoff(parts[1, 1], parts[0, 1], parts[0, 0], risk / len(RULES), level)
        return frame.iloc[:1][["stratum", "rule"]].assign(cut=-1 if cut is None else cut)

    chosen = table.groupBy("stratum", "rule").applyInPandas(
        choose, "stratum string, rule string, cut int"
    )
    return (
        chosen.groupBy("stratum")
        .pivot("rule", list(RULES))
        .agg(F.first("cut"))
        .select("stratum", *[F.when(F.col(r) >= 0, F.col(r)).alias(r) for r in RULES])
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = 0.05,
    error: float = 0.05,
) -> DataFrame:
    """``(id, counts..., base_failed, failed_rules, kept)`` for every row of ``docs``.

    ``labels`` has ``(id, good)``. No documents in, no rows out; without labels only the
    base rules act.
    """
    measured = stored(features(docs, id_col, text_col, stratum_col), "features")
    chosen = cutoffs(measured, labels, risk, error).select(
        F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES]
    )
    rows = measured.select("*", *_bins()).join(
        chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left"
    )
    failed = F.array_compact(
        F.array(*[F.when(F.col(r) >= F.col(f"_{r}"), F.lit(r)) for r in RULES])
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return rows.select("id", *_COUNTS, base.alias("base_failed"), failed.alias("failed_rules")).select(
        "*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept")
    )
