"""Secret scans: fixed patterns, and character Markov models of random strings.

Everything is DataFrame expressions. ``spans`` of a text lists what was found as
``kind:start:end``, in code points and end exclusive, by start and then by kind:

* ``assign``, ``access`` and ``hex`` are matches of the patterns in ``BASE`` (whole match),
  leftmost and non-overlapping per kind; a match whose value is too short is dropped and what
  it covers is not searched again for that kind;
* ``markov`` are runs of ``CANDIDATE``, cut at base spans, that a Markov model of random strings
  explains better than one of ordinary identifiers; of other runs, the stretches between ``/``,
  ``_``, ``=`` and ``-`` of at least ``LEAST`` characters that do.

Both Markov models are first-order over characters, trained on labelled samples
(a string and whether it is random). The score of a string is the mean log-likelihood ratio
per transition; the shorter the string, the higher the score it needs (``bar``). NULL and empty
texts have no spans. Rows are independent of each other, so repeated rows and other columns do
not matter. Places come from sums of piece lengths, so the work of a text grows with its length
and its number of spans.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
#: kind: pattern, group that holds the value, least number of characters of the value.
BASE = {
    "assign": (
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
# The same matches as above where a shorter one can only be dropped: maximal runs.
_LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Shortest runs and stretches that the Markov models look at.
LEAST = 12
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
#: Documents (by hash of id) that ordinary words are learnt from, and generated random strings.
MAX_SAMPLE_DOCS = 500
RANDOM_SAMPLES = 3_000
#: Least mean log-likelihood ratio per transition of a string of at least so many characters;
#: the shorter a string is, the higher it must be.
THRESHOLD = 0.5
SURE = 20
#: A stretch ends before a part that lowers its sum over the threshold by more than this.
DROP = 5.0

_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CUT = _SYMBOLS.index("/")  # this and the symbols after it part the words of a run
_START = len(_SYMBOLS)  # row of the first character
_STATES = len(_SYMBOLS) + 1
_CHUNK = 1024  # characters of a text that are looked through for one place
_BLOCK = 256  # numbers that are summed in one go


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _before(numbers: Column, join, zero: int = 0) -> Column:
    """``zero`` joined with all numbers before each of an array, and last with all of them.

    Block by block, so that the growing arrays stay short.
    """

    def within(block, first):
        begin = F.array(first)
        return F.aggregate(
            block, begin, lambda acc, n: F.concat(acc, F.array(join(F.element_at(acc, -1), n)))
        )

    def whole(block):
        return F.aggregate(block, F.lit(zero), join)

    def over(blocks):
        firsts = within(F.transform(blocks, whole), F.lit(zero))
        return _let(
            firsts,
            lambda first: F.concat(
                F.flatten(
                    F.transform(
                        blocks,
                        lambda b, i: F.slice(within(b, F.get(first, i)), 1, F.size(b)),
                    )
                ),
                F.array(F.element_at(first, -1)),
            ),
        )

    last = F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(numbers, b * _BLOCK + 1, _BLOCK)
    )
    return F.when(F.size(numbers) > 0, _let(blocks, over)).otherwise(F.array(F.lit(zero)))


def _between(chunks: Column, start: Column, stop: Column) -> Column:
    """Characters ``start`` to ``stop`` of a text given in chunks of ``_CHUNK`` characters."""
    first = F.floor(start / _CHUNK).cast("int")
    last = F.floor((stop - 1) / _CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(stop > start, F.substr(near, start % _CHUNK + 1, stop - start)).otherwise("")


def _rewritten(text: Column, spans: Column, piece) -> Column:
    """The text with spans (sorted by start) replaced.

    ``piece(chunks, span, at)`` is what stands for the text from ``at``, the furthest end of all
    spans before, to the end of the span.
    """

    def pieces(chunks):
        ends = F.transform(spans, lambda s: s["end"])
        return _let(
            _before(ends, lambda a, b: F.greatest(a, b)),
            lambda at: F.concat(
                F.zip_with(
                    spans,
                    F.slice(at, 1, F.size(spans)),
                    lambda s, a: piece(chunks, s, a),
                ),
                F.array(F.substr(text, F.element_at(at, -1) + 1)),
            ),
        )

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(_let(chunks, pieces), "")).otherwise(text)


def bar(length: Column) -> Column:
    """Least score of a string of so many characters."""
    short = F.greatest(F.lit(1.0), F.lit(float(SURE)) / F.greatest(length, F.lit(1)))
    return short * short * short * THRESHOLD


def _code(character: Column) -> Column:
    """Number of a character of ``_SYMBOLS``, counted from 0."""
    return F.instr(F.lit(_SYMBOLS), character) - 1


def transitions(samples: DataFrame) -> DataFrame:
    """``(random, a, b, n)``: how often ``b`` follows ``a`` in samples of either label."""
    steps = F.transform(
        F.sequence(F.lit(1), F.length("sample")),
        lambda i: F.struct(
            F.when(i == 1, F.lit(_START))
            .otherwise(F.instr(F.lit(_SYMBOLS), F.substr("sample", i - 1, F.lit(1))) - 1)
            .alias("a"),
            (F.instr(F.lit(_SYMBOLS), F.substr("sample", i, F.lit(1))) - 1).alias("b"),
        ),
    )
    return (
        samples.filter(F.length("sample") > 0)
        .select("random", F.explode(steps).alias("s"))
        .filter((F.col("s.a") >= 0) & (F.col("s.b") >= 0))
        .groupBy("random", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) by ``a * states + b``, add-half smoothed.

    ``samples`` has ``(sample string, random boolean)``. The driver gets one count per pair
    of symbols and label, under ten thousand numbers whatever the samples are.
    """
    counts = {True: {}, False: {}}
    for row in transitions(samples).collect():
        counts[row["random"]][row["a"], row["b"]] = row["n"]
    table = []
    for a in range(_STATES):
        total = {
            label: sum(own.get((a, b), 0) for b in range(_START)) for label, own in counts.items()
        }
        for b in range(_START):
            rate = {
                label: (own.get((a, b), 0) + 0.5) / (total[label] + 0.5 * _START)
                for label, own in counts.items()
            }
            table.append(round(math.log(rate[True] / rate[False]), 6))
        table.append(0.0)
    return table


def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """Random strings of the usual alphabets: hexadecimal, base64, letters and digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.unhex(digest)
    base64 = F.base64(raw)
    kinds = [
        F.substr(digest, F.lit(1), F.lit(32)),
        F.upper(F.substr(digest, F.lit(1), F.lit(32))),
        base64,
        F.translate(base64, "+/=", "-_"),
        F.regexp_replace(base64, "[+/=]", ""),
        F.upper(F.regexp_replace(base64, "[+/=]", "")),
        F.lower(F.regexp_replace(base64, "[+/=]", "")),
    ]
    which = (F.col("id") % len(kinds) + 1).cast("int")
    return spark.range(n).select(
        F.element_at(F.array(*kinds), which).alias("sample"), F.lit(True).alias("random")
    )


def ordinary_samples(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = MAX_SAMPLE_DOCS
) -> DataFrame:
    """Words of at most ``n`` documents, and two or three in a row put together as identifiers.

    Words with digits are left out: they may be what is looked for.
    """
    chosen = (
        docs.select(F.col(id_col).alias("id"))
        .filter(F.col("id").isNotNull())
        .orderBy(F.xxhash64("id"), "id")
        .limit(n)
        .distinct()
    )
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = text.join(F.broadcast(chosen), "id").select(
        F.regexp_extract_all(
            "text", F.lit(r"(?<!\w)[A-Za-z]{2,30}(?!\w)"), F.lit(0)
        ).alias("w")
    )
    joined = F.transform(
        F.sequence(F.lit(1), F.size("w") - 2),
        lambda i: F.element_at(
            F.array(
                F.concat_ws("_", F.slice("w", i, 3)),
                F.concat_ws("-", F.slice("w", i, 2)),
                F.concat_ws("/", F.slice("w", i, 3)),
                F.array_join(F.transform(F.slice("w", i, 3), F.initcap), ""),
                F.upper(F.concat_ws("_", F.slice("w", i, 2))),
                F.element_at("w", i),
            ),
            i % 6 + 1,
        ),
    )
    return words.filter(F.size("w") > 2).select(
        F.explode(joined).alias("sample"), F.lit(False).alias("random")
    )


def log_ratio(string: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a string of ``_SYMBOLS``."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    characters = F.filter(F.split(string, ""), lambda c: c != "")
    codes = F.filter(F.transform(characters, _code), lambda c: c >= 0)
    begin = F.struct(F.lit(_START).alias("a"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        codes,
        begin,
        lambda acc, c: F.struct(
            c.cast("int").alias("a"),
            (acc["sum"] + F.get(ratios, (acc["a"] * _STATES + c).cast("int"))).alias("sum"),
        ),
        lambda acc: acc["sum"] / F.greatest(F.size(codes), F.lit(1)),
    )


def stretches(run: Column, table: list[float]) -> Column:
    """``(start, end)`` of the random parts of a run: the whole, or stretches between cuts.

    One pass over the characters sums the log-likelihood ratio above the threshold. At a cut
    the stretch so far may end; it starts anew where the sum is not above zero, and where it
    fell by more than ``DROP`` from its best end.
    """
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    characters = F.filter(F.split(run, ""), lambda c: c != "")
    codes = F.concat(F.transform(characters, _code), F.array(F.lit(-1)))  # -1: end of the run
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(
        F.lit(0).alias("at"),
        F.lit(_START).alias("a"),
        F.lit(0).alias("start"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"),
        F.lit(0).alias("end"),
        none.alias("out"),
    )

    def add(acc, c):
        cut = (c < 0) | (c >= _CUT)
        size = acc["at"] - acc["start"]
        enough = acc["sum"] + size * THRESHOLD >= bar(size) * size
        better = cut & (size >= LEAST) & enough & (acc["sum"] >= acc["best"])
        best = F.when(better, acc["sum"]).otherwise(acc["best"])
        end = F.when(better, acc["at"]).otherwise(acc["end"])
        fell = (end > 0) & (best - acc["sum"] > DROP)
        close = cut & ((c < 0) | (acc["sum"] <= 0) | fell)
        span = F.struct(acc["start"].alias("start"), end.alias("end"))
        out = F.when(close & (end > 0), F.concat(acc["out"], F.array(span)))
        gain = F.get(ratios, (acc["a"] * _STATES + c).cast("int")) - THRESHOLD
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(close, F.lit(_START)).otherwise(c).alias("a"),
            F.when(close, acc["at"] + 1).otherwise(acc["start"]).alias("start"),
            F.when(close, F.lit(0.0)).otherwise(acc["sum"] + gain).alias("sum"),
            F.when(close, F.lit(0.0)).otherwise(best).alias("best"),
            F.when(close, F.lit(0)).otherwise(end).alias("end"),
            out.otherwise(acc["out"]).alias("out"),
        )

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(run).alias("end")))
    parts = F.aggregate(codes, begin, add, lambda acc: acc["out"])
    return (
        F.when(log_ratio(run, table) >= bar(F.length(run)), whole)
        .when(run.rlike("[/+_=-]"), parts)
        .otherwise(none)
    )


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the characters of spans (sorted by start)."""

    def piece(chunks, s, at):
        begin = F.greatest(at, s["start"])
        blanks = F.repeat(F.lit(" "), F.greatest(s["end"] - begin, F.lit(0)))
        return F.concat(_between(chunks, at, begin), blanks)

    return _rewritten(text, spans, piece)


def _placed(kind: str, found: str, gaps: str, keep) -> Column:
    """Spans of the matches in column ``found``, given the texts between them."""
    matches = F.zip_with(
        F.col(found),
        F.slice(F.col(gaps), 1, F.size(found)),
        lambda m, g: F.struct(
            F.length(g).alias("gap"), F.length(m).alias("size"), keep(m).alias("keep")
        ),
    )

    def spans(pairs):
        sizes = F.transform(pairs, lambda p: p["gap"] + p["size"])
        placed = F.zip_with(
            pairs,
            F.slice(_before(sizes, lambda a, b: a + b), 1, F.size(pairs)),
            lambda p, at: F.struct(
                (at + p["gap"]).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (at + p["gap"] + p["size"]).alias("end"),
                p["keep"].alias("keep"),
            ),
        )
        return F.transform(
            F.filter(placed, lambda s: s["keep"]),
            lambda s: F.struct(s["start"], s["kind"], s["end"]),
        )

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(found) > 0, _let(matches, spans)).otherwise(none)


def _value_length(kind: str):
    pattern, group, least = BASE[kind]
    if group == 0:
        return lambda match: F.length(match) >= least
    return lambda match: F.length(F.regexp_extract(match, pattern, group)) >= least


def scan(docs: DataFrame, table: list[float], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_spans``: an array of (start, kind number, end).

    Each pattern passes over a text once; where it matched, the text is split at the
    matches, and the lengths of the pieces give the places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _matched(docs, text, {k: _LONG.get(k, BASE[k][0]) for k in BASE})
    base = F.concat(*[_placed(k, f"_m_{k}", f"_g_{k}", _value_length(k)) for k in BASE])
    rows = rows.select(*docs.columns, F.array_sort(base).alias("_base"))
    rows = rows.withColumn("_rest", _blanked(text, F.col("_base")))
    rows = _matched(rows, F.col("_rest"), {"markov": CANDIDATE})
    runs = _placed("markov", "_m_markov", "_g_markov", lambda m: F.lit(True))
    parts = F.transform("_m_markov", lambda m: stretches(m, table))

    def moved(run, found):
        return F.transform(
            found,
            lambda s: F.struct(
                (run["start"] + s["start"]).cast("int").alias("start"),
                run["kind"].alias("kind"),
                (run["start"] + s["end"]).cast("int").alias("end"),
            ),
        )

    random = F.flatten(F.zip_with(runs, parts, moved))
    return rows.select(*docs.columns, F.array_sort(F.concat("_base", random)).alias("_spans"))


def _matched(rows: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """All columns and, per kind, the matches in the text and the texts between them."""
    found = rows.select(
        "*",
        *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()],
    )
    none = F.array().cast("array<string>")
    return found.select(
        "*",
        *[
            F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"_g_{k}")
            for k, p in patterns.items()
        ],
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every stretch covered by spans (sorted by start) replaced by ``mark``."""

    def piece(chunks, s, at):
        new = F.concat(_between(chunks, at, s["start"]), F.lit(mark))
        return F.when(s["start"] >= at, new).otherwise("")

    return _rewritten(text, spans, piece)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Ratios trained on generated random strings and on ordinary words of ``docs``."""
    return train(random_samples(docs.sparkSession).union(ordinary_samples(docs, id_col, text_col)))
