import pytest
from conftest import SMALL
from fixture import FISH, prepared, raw_captures
from pyspark.sql import functions as F

from recapspark.operators import dedup, growth, histories, tables
from recapspark.operators.prepare import month_intervals
from recapspark.plans import flows, registry
from recapspark.sources import files, standin

MAIN = (["mainTrib"], ["%in%"], [["main"]])
TRIB = (["mainTrib"], ["%in%"], [["trib"]])


def dense(spark, *subset, rows=FISH):
    d = prepared(spark, rows)
    caught = histories.caught_months(
        d, *subset, drop=dedup.gt_once_per_day_tags(d), intervals=month_intervals(d)
    )
    return histories.encounter_histories(caught)


def by_tag(df, column):
    return {r["tag"]: r[column] for r in df.collect()}


def target(spark, rows=FISH):
    return prepared(spark, rows, drop_same_day=True)


def test_first_on_last_occasion(spark):
    d = target(spark)
    assert [r["tag"] for r in histories.first_on_last_occasion(d).collect()] == ["e5"]
    undated = target(spark, FISH + [("z9", None, 9, 300, "M", 328)])
    assert histories.first_on_last_occasion(undated).count() == 0
    assert histories.never_captured(d).count() == 0


def test_never_captured_counts_missing_as_zero(spark):
    d = spark.createDataFrame([("a", 0), ("a", None), ("b", 1)], "tag string, enc int")
    assert [r["tag"] for r in histories.never_captured(d).collect()] == ["a"]


def test_gt1_per_occasion(spark):
    got = {tuple(r) for r in histories.gt1_obs_per_occasion(target(spark)).collect()}
    assert got == {("a1", "2020-07", 2), ("d4", "2020-07", 3), ("f6", "2020-07", 2)}


def days(df):
    return sorted((r["tag"], r["dateC"][:5]) for r in df.collect())


def test_thin_occasions(spark):
    d = target(spark).filter("tag <> 'e5'")
    want = [("a1", "05-07"), ("a1", "10-06"), ("b2", "02-09"), ("b2", "11-06"),
            ("d4", "01-07"), ("d4", "08-07"), ("f6", "21-07")]
    assert days(histories.thin_occasions(d)) == want
    assert days(histories.thin_occasions(d, hot_keys=1, min_rows=1, salts=2)) == want
    assert days(histories.history_rows(target(spark))) == want
    raw = prepared(spark)
    fused = histories.history_rows(raw, same_day=dedup.same_day_facts(raw))
    assert days(fused) == want


def test_thin_occasions_first_mode(spark):
    d = target(spark).filter("tag in ('a1', 'd4', 'f6')")
    assert days(histories.thin_occasions(d, mode="first")) == [
        ("a1", "05-07"), ("a1", "10-06"), ("d4", "01-07"), ("f6", "12-06"), ("f6", "21-07")]
    with pytest.raises(ValueError):
        histories.thin_occasions(d, mode="last")


def test_wide_all(spark):
    h = dense(spark)
    assert by_tag(h, "y_enc") == {
        "a1": [1, 1, 0], "b2": [1, 0, 1], "d4": [0, 1, 0], "f6": [0, 1, 0]}
    assert by_tag(h, "y_sizeState") == {
        "a1": [1, 2, 0], "b2": [3, 0, 3], "d4": [0, 1, 0], "f6": [0, 2, 0]}
    assert by_tag(h, "y_state") == {
        "a1": [1, 2, 0], "b2": [6, 0, 6], "d4": [0, None, 0], "f6": [0, 5, 0]}
    assert by_tag(h, "first") == {"a1": 1, "b2": 1, "d4": 2, "f6": 2}
    assert set(by_tag(h, "last").values()) == {3}
    assert by_tag(h, "y_Water")["b2"] == ["T1", None, "T1"]
    assert by_tag(h, "y_dateMedianDiffMonth")["a1"] == pytest.approx(
        [27 / 30.5, 56.5 / 30.5, None])
    wide = histories.history_wide(h)
    assert wide.columns == ["tag", "date_2020-06", "date_2020-07", "date_2020-09"]
    assert tuple(wide.filter("tag = 'b2'").first()) == ("b2", 1, 0, 1)


def test_main_subset_keeps_captured_missing_state(spark):
    h = dense(spark, *MAIN)
    assert by_tag(h, "months")["a1"] == ["2020-06", "2020-07"]
    assert by_tag(h, "y_enc") == {"a1": [1, 1], "d4": [0, 1]}
    assert by_tag(h, "y_sizeState") == {"a1": [1, 2], "d4": [0, None]}
    observed = histories.observation_codes(h)
    assert tuple(histories.incomplete_count(observed).first()) == (1, 2)
    assert by_tag(histories.complete_histories(observed), "y") == {"a1": [2, 3]}


def test_trib_subset(spark):
    h = dense(spark, *TRIB)
    assert by_tag(h, "months")["b2"] == ["2020-06", "2020-07", "2020-09"]
    assert by_tag(h, "y_enc") == {"b2": [1, 0, 1], "f6": [0, 1, 0]}


def test_undated_captures_form_the_last_column(spark):
    rows = FISH + [("z9", None, None, 300, "M", 328)]
    h = dense(spark, rows=rows)
    assert by_tag(h, "months")["z9"][-1] is None
    assert by_tag(h, "y_enc")["z9"] == [0, 0, 0, 1]
    # an undated capture leaves the last occasion unknown, so e5 stays
    assert by_tag(h, "y_enc")["e5"] == [0, 0, 1, 0]
    assert histories.history_wide(h).columns[-1] == "date_NA"


def test_state_tables(spark):
    d = prepared(spark)
    caught = histories.caught_months(d, drop=dedup.gt_once_per_day_tags(d))
    share = {r["state"]: r["proportion"] for r in histories.state_proportions(caught).collect()}
    assert share == pytest.approx({1: 0.2, 2: 0.2, 5: 0.2, 6: 0.4})
    got = {r["trajectory"]: r["n"] for r in histories.state_trajectories(caught).collect()}
    assert got == {"12": 1, "66": 1, "": 1, "5": 1}
    h = histories.encounter_histories(caught)
    pairs = {r["firstLast"]: r["n"] for r in histories.first_last_frequencies(h).collect()}
    assert pairs == {"1_3": 2, "2_3": 2}
    assert {r["n"] for r in histories.collapse_histories(
        histories.complete_histories(histories.observation_codes(h))).collect()} == {1}


def test_initial_proportions(spark):
    d = prepared(spark)
    caught = histories.caught_months(d, drop=dedup.gt_once_per_day_tags(d))
    assert histories.initial_proportions(caught, [4, 5, 6]) == pytest.approx([0, 0.2, 0.4])


def test_bundle(spark):
    raw = raw_captures(spark)
    bundle = flows.history_bundle(raw.filter("FishNum < 6"), raw.filter("FishNum >= 6"))
    assert bundle["eh"].columns == ["tag", "date_2020-06", "date_2020-07", "date_2020-09"]
    wide = {r["tag"]: tuple(r)[1:] for r in bundle["sizeStateMatrix"].collect()}
    assert wide == {"a1": (1, 2, 0), "b2": (3, 0, 3), "d4": (0, 1, 0), "f6": (0, 2, 0)}
    assert sorted(tuple(r) for r in bundle["firstLast"].collect()) == [
        ("a1", 1, 3), ("b2", 1, 3), ("d4", 2, 3), ("f6", 2, 3)]
    gaps = {r["dateYM"]: r[histories.INTERVAL] for r in bundle["dateMedian"].collect()}
    vector = bundle["dateMedianDiffMonthVector"].collect()
    assert gaps == {r["dateYM"]: r[histories.INTERVAL] for r in vector}
    assert gaps["2020-06"] == pytest.approx(27 / 30.5)
    assert bundle["data"].count() == 7 and bundle["tags"].count() == 4
    assert bundle["riverMatrix"].columns == bundle["riverNMatrix"].columns
    assert bundle["stateMatrix"].count() == 4


def test_rows_and_cells_agree(spark):
    """The folded histories equal the earliest kept row of each month."""
    rows = [(f"t{i % 7}", f"{1 + i * 5 % 28:02d}-{1 + i % 9:02d}-2020",
             None if i % 11 == 0 else i % 24, 100 + i * 7 % 400,
             ["M", "T1", None][i % 3], 328 if i % 4 else 326) for i in range(160)]
    d = prepared(spark, rows, drop_same_day=False)
    for subset in ((), MAIN, TRIB):
        kept = histories.history_rows(d, *subset).filter("species = 'brown trout'")
        first = kept.groupBy("tag", "dateYM").agg(
            F.min(F.struct(F.coalesce("dateTime", F.lit("9999-12-31").cast("timestamp_ntz")),
                           "FishNum", "sizeState")).alias("c"))
        want = {(r["tag"], r["dateYM"], r["c"]["sizeState"]) for r in first.collect()}
        cells = histories.history_cells(histories.caught_months(d, *subset))
        got = {(r["tag"], r["dateYM"], r["sizeState"]) for r in cells.collect()}
        assert got == want and want


def test_pivot_captures_fills_absent_cells_only(spark):
    d = target(spark).filter("tag in ('a1', 'd4')")
    wide = histories.pivot_captures(d, "state", ["2020-06", "2020-07"])
    assert {tuple(r) for r in wide.collect()} == {("a1", 1, 2), ("d4", 0, None)}


@pytest.mark.parametrize("given,want", [
    ([0, 1, 0, 1, 0], [0, 1, 1, 1, None]), ([1, 0, 0], [1, None, None]),
    ([0, 0, 1], [0, 0, 1]), ([0, 0], [None, None])])
def test_known_state(spark, given, want):
    df = spark.createDataFrame([("a", ["m"] * len(given), given)],
                               "tag string, months array<string>, y_enc array<int>")
    known = histories.known_state(df)
    assert known.first()["known"] == want
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Generate", "Window", "Exchange"))


def test_declared_months(spark):
    h = dense(spark)
    months = ["2020-05", "2020-06", "2020-07", "2020-09", None]
    wide = histories.history_wide(h, "sizeState", months)
    assert wide.columns[1:] == ["date_2020-05", "date_2020-06", "date_2020-07", "date_2020-09", "date_NA"]
    got = {tuple(r) for r in wide.collect()}
    assert got == {("a1", 0, 1, 2, 0, 0), ("b2", 0, 3, 0, 3, 0), ("d4", 0, 0, 1, 0, 0), ("f6", 0, 0, 2, 0, 0)}
    with pytest.raises(Exception, match="declared months: b2 2020-09"):
        histories.history_wide(h, "sizeState", months[:3]).collect()
    undated = dense(spark, rows=FISH + [("z9", None, None, 300, "M", 328)])
    assert {r["date_NA"] for r in histories.history_wide(undated, "enc", months).collect()} == {0, 1}
    with pytest.raises(Exception, match="declared months: z9"):
        histories.history_wide(undated, "enc", months[:4]).collect()


def test_stored_fold_needs_no_shuffle(spark, tmp_path):
    first, second = standin.capture_files(spark, SMALL)
    store = files.ResultStore(spark, str(tmp_path))
    flows.store_months(store, first, second, "months")
    for subset in ("main", "all"):
        caught = flows.stored_histories(store, "months", subset)
        want = flows.caught_months(first, second, subset, True, True)
        columns = [c for c in caught.columns if c != "cells"]
        assert sorted(map(str, caught.select(*columns).collect())) == sorted(
            map(str, want.select(*columns).collect()))
        assert caught.select("cells.state").count() == want.count()
    months = store.read("months")
    plan = months.groupBy("tag").count().join(months, "tag")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    # by name, from another session, and the latest version
    other = files.ResultStore(spark.newSession(), str(tmp_path))
    assert other.read("months").count() == months.count() > 0
    store.save(months.limit(1), "months", by="tag", buckets=2)
    assert other.read("months").count() == 1 and store.manifest().count() == 3
    with pytest.raises(KeyError):
        store.read("nothing")


def test_growth_on_fixture(spark):
    rows = growth.growth_rows(target(spark)).orderBy("tag", "date").collect()
    got = {}
    for r in rows:
        got.setdefault(r["tag"], []).append(r["growth"])
    assert got == {
        "a1": [None, pytest.approx(40 / 25), pytest.approx(10 / 15)],
        "b2": [None, pytest.approx(10 / 83)],
        "d4": [None, None, None],
        "e5": [None],
        "f6": [None, pytest.approx(30 / 27), pytest.approx(5 / 12)],
    }


def test_growth_of_undated_captures(spark):
    rows = FISH + [("b2", None, 9, 410 + i, "T1", 328) for i in range(3)]
    got = growth.growth_rows(prepared(spark, rows), ranges=4).filter("tag = 'b2'")
    got = [(r["Length"], r["LengthLag"], r["dateLag"] is not None, r["growth"])
           for r in got.orderBy(F.asc_nulls_last("date"), "FishNum").collect()]
    assert [g[:3] for g in got] == [
        (390, None, False), (400, 390, True), (410, 400, True), (411, 410, False),
        (412, 411, False)]
    assert got[2][3] is None


def test_undated_captures_of_one_fish_spread_over_ranges(spark):
    n = 20_000
    d = prepared(spark, FISH).limit(1)
    many = d.crossJoin(spark.range(n)).withColumns(
        {
            "tag": F.lit("big"),
            "date": F.lit(None).cast("date"),
            "dateYM": F.lit(None).cast("string"),
            "FishNum": F.lit(None).cast(d.schema["FishNum"].dataType),
            "Length": F.col("id").cast("double"),
        }
    )
    got = growth.growth_rows(many, ranges=8)
    wrong = got.filter(~F.col("LengthLag").eqNullSafe(F.when(F.col("id") > 0, F.col("Length") - 1)))
    assert wrong.count() == 0 and got.count() == n
    sizes = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < n / 2


def test_folded_growth_and_counts_equal_those_of_the_remaining_rows(spark):
    rows = FISH + [
        ("u1", None, 9, 300, "T1", 328), ("u1", None, 9, 310, "T1", 328),  # no shared date
        ("u1", "01-02-2019", 9, 290, "M", 328),
        ("u2", None, 9, 300, "T1", 328), ("u2", None, 9, 310, "T1", 328),  # a shared date
        ("u2", "03-02-2019", 9, 290, "M", 328),
        ("x1", "03-02-2019", 9, 200, "M", 328), ("x1", "03-02-2019", 10, 201, None, 328),
        ("n1", "05-02-2019", 9, None, None, 328), ("n1", "07-02-2019", 9, 250, None, 326),
    ]
    d = prepared(spark, rows)
    left = dedup.remove_same_day(d)
    names = ["tag", "date", "year", "month", "mainTrib", "sizeState", "Length", "LengthLag",
             "dateLag", "growth"]

    def listed(df):
        return sorted(map(str, df.collect()))

    want = growth.growth_rows(left).filter("date is not null").select(*names)
    assert listed(growth.dated_growth(d).select(*names)) == listed(want)
    assert listed(growth.dated_growth(left).select(*names)) == listed(want)
    for by in ([], ["Water"], ["date"], ["mainTrib", "species"]):
        counted = left.groupBy("tag", *by).agg(F.count(F.lit(1)).alias("n"))
        assert listed(dedup.kept_counts(d, *by)) == listed(counted)


@pytest.mark.parametrize(
    "fold",
    [
        growth.growth_by_month,
        lambda d: tables.most_first(dedup.kept_counts(d, "Water"), "Water"),
        lambda d: tables.counts(dedup.kept_counts(d, "date"), "date", weight="n"),
        lambda d: tables.n_unique_tags(dedup.kept_counts(d).filter("n > 0")),
    ],
)
def test_folds_read_the_captures_once(spark, tmp_path, fold):
    prepared(spark, FISH).write.parquet(str(tmp_path / "captures"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = fold(spark.read.parquet(str(tmp_path / "captures")))
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("FileScan") == 1


def test_growth_on_the_same_day_is_missing_not_an_error(spark):
    rows = [("a1", "10-06-2020", 9, 200, "M", 328), ("a1", "10-06-2020", 10, 210, "M", 328)]
    got = growth.growth_rows(prepared(spark, rows)).orderBy("FishNum").collect()
    assert [r["growth"] for r in got] == [None, None]


def test_wide_query_holds_every_cell(spark):
    wide = registry.QUERIES["eh_wide_main"](spark, SMALL)
    cells = registry.QUERIES["eh_cells_main"](spark, SMALL).collect()
    declared = [f"date_{m or 'NA'}" for m in registry.WIDE_MONTHS]
    assert wide.columns == ["tag", *declared] and declared[-1] == "date_NA"
    assert {f"date_{r['dateYM'] or 'NA'}" for r in cells} <= set(declared)
    got = [
        (r["tag"], c, r[c]) for r in wide.collect() for c in wide.columns[1:] if r[c]
    ]
    want = [
        (r["tag"], f"date_{r['dateYM'] or 'NA'}", r["sizeState"])
        for r in cells
        if r["sizeState"] is not None
    ]
    assert want and sorted(got) == sorted(want)


def test_wide_table_lists_cells_of_other_months(spark):
    df = spark.createDataFrame(
        [("a", ["1980-01", "1990-05", "2003-01", None], [1, 0, 1, 1], [2, 0, None, 3]),
         ("b", ["1980-01", "1990-05", "2003-01", None], [0, 1, 0, 0], [0, 1, 0, 0])],
        "tag string, months array<string>, y_enc array<int>, y_sizeState array<int>",
    )
    wide = histories.history_wide(df, "sizeState", ["1990-05", histories.OTHER, None])
    assert wide.columns == ["tag", "date_1990-05", "date_other", "date_NA"]
    assert {tuple(r) for r in wide.collect()} == {("a", 0, "1980-01:2,2003-01:NA", 3), ("b", 1, None, 0)}
    assert {f"{y}-{m:02}" for y in range(1992, 2002) for m in range(1, 13)} < set(registry.WIDE_MONTHS)
    assert histories.OTHER in registry.WIDE_MONTHS


def test_known_state_does_not_work_per_cell(spark):
    df = spark.createDataFrame(
        [("a", [], [0, 1, 0, 1, 0]), ("b", [], [0, 0]), ("c", [], [1]), ("d", [], [None, 1, None]), ("e", [], [])],
        "tag string, months array<string>, y_enc array<int>",
    )
    known = histories.known_state(df)
    assert {r["tag"]: r["known"] for r in known.collect()} == {
        "a": [0, 1, 1, 1, None], "b": [None, None], "c": [1], "d": [0, 1, None], "e": [],
    }
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") == 1 and "aggregate(" not in plan
