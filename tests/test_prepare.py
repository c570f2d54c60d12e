import datetime as dt
import re

import pytest
from fixture import FISH, prepared, raw_captures
from pyspark.sql import functions as F

from recapspark.functions import predicates, scalar
from recapspark.operators import dedup, levels, prepare


def one(spark, expr, **values):
    names = list(values)
    schema = ", ".join(
        f"{n} {'string' if isinstance(v, str) or v is None else 'double'}"
        for n, v in values.items()
    )
    df = spark.createDataFrame([tuple(values[n] for n in names)], schema)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("10-06-2020", dt.date(2020, 6, 10)),
        ("1/6/2020", dt.date(2020, 6, 1)),
        ("10.JUN.2020", dt.date(2020, 6, 10)),
        ("10 june 2020", dt.date(2020, 6, 10)),
        ("10Jun20", dt.date(2020, 6, 10)),
        ("10062020", dt.date(2020, 6, 10)),
        ("10-06-69", dt.date(1969, 6, 10)),
        ("31-02-2020", None),
        ("10-06-+12020", None),
        ("10-06--2020", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_day(spark, text, expected):
    assert one(spark, scalar.parse_day(F.col("a")), a=text) == expected


@pytest.mark.parametrize(
    "text,hours", [("09:05:00", 9 + 5 / 60), ("25:00:00", 25), ("x", None), (None, None)]
)
def test_parse_clock(spark, text, hours):
    got = one(spark, scalar.parse_clock(F.col("a")), a=text)
    assert (got is None) if hours is None else got == dt.timedelta(hours=hours)


def test_null_length_and_river_stay_null(spark):
    assert one(spark, scalar.size_state(F.col("a").cast("double")), a=None) is None
    assert one(spark, scalar.main_or_trib(F.col("a")), a=None) is None
    assert one(spark, scalar.main_or_trib_number(F.col("a")), a=None) is None


@pytest.mark.parametrize("length,state", [(229.9, 1), (230.0, 2), (379.9, 2), (380.0, 3)])
def test_size_cutoffs_are_less_than(spark, length, state):
    assert one(spark, scalar.size_state(F.col("a")), a=length) == state


def test_logit_inverts(spark):
    assert one(spark, scalar.ilogit(scalar.logit(F.col("a"))), a=0.3) == pytest.approx(0.3)


def test_monthly_survival(spark):
    phi, m = F.lit(0.64), F.lit(2.0)
    assert one(spark, scalar.monthly_survival(phi, m), a=1.0) == pytest.approx(0.4096)
    assert one(spark, scalar.monthly_survival(phi, m, True), a=1.0) == pytest.approx(0.8)


def test_predicates(spark):
    df = spark.createDataFrame(
        [(1, "x"), (2, "y"), (3, None)], "k int, w string"
    )

    def keys(*spec):
        return {r["k"] for r in df.filter(predicates.all_of(*zip(*spec))).collect()}

    assert {r["k"] for r in df.filter(predicates.all_of([], [], [])).collect()} == {1, 2, 3}
    assert keys(("w", "%in%", ["x"])) == {1}
    assert keys(("w", "%notin%", ["x"])) == {2, 3}  # a missing value is not in the set
    assert keys(("w", "%notin%", ["x", None])) == {2}
    assert keys(("w", "%in%", [None])) == {3}
    assert keys(("w", "!=", "x"), ("k", "<=", 2)) == {2}
    with pytest.raises(ValueError):
        predicates.all_of(["w"], ["like"], ["x"])


def test_union_requires_known_columns(spark):
    raw = raw_captures(spark)
    assert prepare.union_captures(raw, raw.drop("Wild")).count() == 2 * len(FISH)
    with pytest.raises(ValueError):
        prepare.union_captures(raw.drop("Wild"), raw)


def test_untagged_are_removed(spark):
    rows = [("", "10-06-2020", 9, 1, "M", 328), ("AD", "10-06-2020", 9, 1, "M", 328),
            (None, "10-06-2020", 9, 1, "M", 328), ("Z9", "10-06-2020", 9, 1, "M", 1)]
    d = prepare.remove_untagged(prepare.derive_captures(raw_captures(spark, rows)))
    assert [(r["tag"], r["species"]) for r in d.collect()] == [("z9", None)]
    assert prepare.remove_uncaptured(d).count() == 1


def test_month_intervals(spark):
    rows = {r["dateYM"]: r for r in prepare.month_intervals(
        prepare.remove_untagged(prepare.derive_captures(raw_captures(spark)))).collect()}
    assert {m: r["occ"] for m, r in rows.items()} == {
        "2020-06": 1, "2020-07": 2, "2020-09": 3}
    day = (dt.date(2020, 6, 11) - dt.date(1970, 1, 1)).days
    assert rows["2020-06"]["dateMedian"] == day
    assert rows["2020-09"]["dateMedian"] % 1 == 0.5
    assert rows["2020-06"]["dateMedianDiff"] == 27
    assert rows["2020-06"]["dateMedianDiffMonth"] == pytest.approx(0.8852459016)
    assert rows["2020-07"]["dateMedianDiff"] == 56.5
    assert rows["2020-07"]["dateMedianDiffMonth"] == pytest.approx(1.8524590164)
    assert rows["2020-09"]["dateMedianDiff"] is None


def test_first_last_and_states(spark):
    d = prepared(spark)
    seen = {(r["tag"], r["firstObserved"], r["lastObserved"]) for r in d.collect()}
    assert seen == {("a1", 1, 2), ("b2", 1, 3), ("c3", 2, 2), ("d4", 2, 2),
                    ("e5", 3, 3), ("f6", 1, 2)}
    d4 = d.filter("tag = 'd4' and Length = 229").first()
    assert (d4["mainTrib"], d4["sizeState"], d4["state"]) == (None, 1, None)
    assert {r["riverN"] for r in d.filter("Water = 'T2'").collect()} == {2}
    assert d.filter("riverN is null").count() == 1


def test_undated_captures_have_no_occasion(spark):
    d = prepared(spark, FISH + [("z9", None, 9, 300, "M", 328)])
    z = d.filter("tag = 'z9'").first()
    assert z["occ"] is None and z["firstObserved"] is None and z["isFirstObserved"] is None


def test_same_day(spark):
    d = prepared(spark)
    assert [r["tag"] for r in dedup.gt_once_per_day_tags(d).collect()] == ["c3"]
    assert [tuple(r) for r in dedup.gt_one_capture(d).collect()] == [
        (dt.date(2020, 7, 5), "c3", 2)]
    assert dedup.remove_same_day(d).count() == 12
    assert prepared(spark, drop_same_day=True).count() == 12
    assert prepared(spark, first_last=False, drop_same_day=True).count() == 12


@pytest.mark.parametrize("third,stays", [("05-07-2020", False), ("06-07-2020", True)])
def test_double_on_unknown_date(spark, third, stays):
    rows = FISH + [("g7", None, 9, 1, "M", 328), ("g7", None, 9, 2, "M", 328),
                   ("g7", third, 9, 3, "M", 328)]
    tags = {r["tag"] for r in prepared(spark, rows, drop_same_day=True).collect()}
    assert ("g7" in tags) is stays


@pytest.mark.parametrize("hot_keys", [1, 2, 1000])
def test_frequent_keys_change_nothing(spark, hot_keys):
    """However many keys are served by broadcast, the result is the same."""
    rows = FISH + [("h8", f"{1 + i % 28:02d}-07-2020", 9, i, "M", 328) for i in range(200)]
    key = ["tag", "FishNum", "firstObserved", "lastObserved", "isLastObserved"]
    d = prepared(spark, rows, hot_keys=hot_keys, min_rows=1, salts=4)
    got = sorted(map(tuple, d.select(*key).collect()))
    want = {}
    for r in d.collect():
        want.setdefault(r["tag"], []).append(r["occ"])
    assert len(got) == len(rows)
    for tag, _, first, last, _ in got:
        assert (first, last) == (min(want[tag]), max(want[tag]))
    kept = prepared(spark, rows, drop_same_day=True, hot_keys=hot_keys, min_rows=1, salts=4)
    assert kept.count() == 12


def test_numbering_many_levels(spark):
    values = [f"r{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values + [None] + values], "Water string")
    small, is_small = levels.number_levels(df, "Water", "riverN")
    large, is_large_small = levels.number_levels(df, "Water", "riverN", limit=10)
    assert is_small and not is_large_small
    want = {v: i + 1 for i, v in enumerate(values)}
    assert {r["Water"]: r["riverN"] for r in small.collect()} == want
    assert {r["Water"]: r["riverN"] for r in large.collect()} == want


def test_river_numbers_beyond_broadcast(spark, monkeypatch):
    real = levels.number_levels
    monkeypatch.setattr(
        prepare, "number_levels", lambda df, c, n: real(df, c, n, limit=1)
    )
    got = {(r["Water"], r["riverN"]) for r in prepared(spark).collect()}
    assert {n for _, n in got} == {None, 1, 2, 3}
    assert (None, None) in got and ("T1", 1) in got and ("T2", 2) in got


def test_scatter_column_is_a_join_key(spark):
    """A constant there would be folded away and frequent keys would not scatter."""
    plan = prepared(spark)._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"Join \[[^\]]*_bucket", plan)
