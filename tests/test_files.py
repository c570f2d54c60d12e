import pytest
from fixture import prepared, raw_captures

from recapspark.operators import prepare
from recapspark.sources import files


def test_csv_scan(spark, tmp_path):
    header = ("Longitude,Latitude,Date,Time,SiteLen,Discharge,WaterTemp,GearType,TimeFish,"
              "FishNum,SpeciesCd,Length,Weight,Wild,Stage,MarkAppCd,Mark PreCd,Water,"
              "tblSL_SL_ID,Rep")
    line = '-75.1,41.9, 10-06-2020 ,09:05:00,NA,,12.5,boat,NA,7,328,200,,W,"",NA,AB12,"T, 1",5,1'
    path = tmp_path / "captures.csv"
    path.write_text(header + "\n" + line + "\n")
    r = files.read_captures(spark, str(path)).first()
    assert r["Date"] == "10-06-2020" and r["Length"] == 200.0 and r["Water"] == "T, 1"
    assert r["SiteLen"] is None and r["Discharge"] is None and r["Weight"] is None
    assert r["Stage"] is None and r["MarkAppCd"] is None and r["Mark PreCd"] == "AB12"
    d = prepare.derive_captures(files.read_captures(spark, [str(path), str(path)]))
    assert d.count() == 2 and d.first()["tag"] == "ab12"


def test_columns_are_found_by_name(spark, tmp_path):
    """Extra, reordered and missing columns, and unlike files in one scan."""
    (tmp_path / "a.csv").write_text("Extra,Water,FishNum,Date\nx, R1 ,7,10-06-2020\ny,NA,oops,\n")
    (tmp_path / "b.csv").write_text("Date,Length,Water\n11-06-2020,200.5,R2\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    both = files.read_captures(spark, paths)
    assert both.schema == files.CAPTURE_FILE
    rows = {(r["Date"], r["Water"], r["FishNum"], r["Length"], r["Rep"]) for r in both.collect()}
    want = {("10-06-2020", "R1", 7, None, None), (None, None, None, None, None),
            ("11-06-2020", "R2", None, 200.5, None)}
    assert rows == want
    assert {r[0] for r in both.select("Water").collect()} == {"R1", "R2", None}
    assert {r[0] for r in files.read_captures(spark, str(tmp_path)).select("FishNum").collect()} == {7, None}


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "clean")
    d = prepared(spark)
    files.write_table(d, path)
    back = files.read_table(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, d.collect()))
    files.write_table(d.limit(1), path)  # replaces
    assert files.read_table(spark, path).count() == 1


def test_model_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = "chain int, iter int, name string, s_from int, s_to int, t int, value double"

    def draws(v):
        return spark.createDataFrame([(1, 1, "betaPhi", 1, None, 1, v)], schema)

    files.save_model_run(draws(0.1), path, "main", "2022-07-26 09")
    files.save_model_run(draws(0.2), path, "main", "2022-07-27 10")
    files.save_model_run(draws(0.3), path, "trib", "2022-07-27 10")
    files.save_model_run(draws(0.4), path, "main", "2022-07-27 10")  # same hour
    assert files.read_model_run(spark, path, "main").first()["value"] == 0.4
    assert files.read_model_run(spark, path, "trib").first()["value"] == 0.3
    old = files.read_model_run(spark, path, "main", "2022-07-26 09")
    assert old.count() == 1 and old.first()["value"] == 0.1
    assert len(files.run_stamp()) == 13


def test_locations_and_intervals(spark, tmp_path):
    d = prepare.derive_captures(raw_captures(spark))
    out = str(tmp_path / "locations")
    files.write_csv(files.locations(d), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == files.LOCATION_COLUMNS and back.count() == 14
    months = prepare.month_intervals(prepare.remove_untagged(d))
    path = str(tmp_path / "months")
    files.write_csv(months, path)
    again = files.read_month_intervals(spark, path)
    joined = prepare.join_month_intervals(prepare.remove_untagged(d), again)
    want = prepare.join_month_intervals(prepare.remove_untagged(d))
    key = ["tag", "FishNum", "occ", "dateMedianDiff"]
    assert sorted(map(str, joined.select(*key).collect())) == sorted(
        map(str, want.select(*key).collect()))


def test_interval_table_needs_its_columns(spark):
    with pytest.raises(Exception):
        prepare.join_month_intervals(prepared(spark), spark.range(1))


def test_problems_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Extra,Water,FishNum,Date,Length\nx, R1 ,7,10-06-2020,1\n\ny,NA,oops,,2,more\nz,R2\n"
                                    "z,R2,8,,long\n")
    (tmp_path / "b.csv").write_text("Date,Length,Water\n11-06-2020,,R2\n")
    got = files.read_captures(spark, str(tmp_path), rescued="bad").collect()
    assert len(got) == 5
    bad = {}
    for r in got:
        if r["bad"]:
            bad[r["bad"]["file"].rsplit("/", 1)[1], r["bad"]["line"]] = (
                r["bad"]["row"], [tuple(p) for p in r["bad"]["problems"]])
    assert bad == {
        ("a.csv", 4): ("y,NA,oops,,2,more", [(None, None, "5 fields"), ("FishNum", "oops", "bigint")]),
        ("a.csv", 5): ("z,R2", [(None, None, "5 fields")]),
        ("a.csv", 6): ("z,R2,8,,long", [("Length", "long", "double")]),
    }
    plain = files.read_captures(spark, str(tmp_path))
    assert sorted(map(str, plain.collect())) == sorted(map(str, [tuple(r)[:-1] for r in got])) or plain.count() == 5


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    lines = ["FishNum,Date"] + [f"{i if i % 10 else 'x'},d" for i in range(2, 3002)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.read_captures(spark, str(tmp_path), rescued="bad")
        assert got.rdd.getNumPartitions() > 1
        found = {r["bad"]["line"] for r in got.filter("bad IS NOT NULL").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {i for i in range(2, 3002) if i % 10 == 0}
