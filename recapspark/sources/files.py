"""Reading and writing captures, intermediate tables and model runs."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapspark.config import UNTAGGED_MARKS
from recapspark.sources.schema import CAPTURE_FILE, MONTH_INTERVALS


def read_captures(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType = CAPTURE_FILE,
    rescued: str | None = None,
) -> DataFrame:
    """Scan capture CSV files: header row, trimmed fields, empty and ``NA`` are NULL.

    Columns are found by name in the header of each file, in any order; other columns are
    ignored, absent ones are NULL, and so are fields that don't fit their type. Files
    with the same header are read together.

    ``rescued`` names a further column for what did not parse, NULL where all did: file, line
    (from 1, the header counts), the whole row, and per problem the column, the text and what was
    expected. A row with more or fewer fields than the header is a problem of no column. A
    field can't hold a line break.
    """
    listed = spark.read.format("binaryFile").load(paths).select("path")
    by_header: dict[tuple, list[str]] = {}
    for row in listed.orderBy("path").toLocalIterator():
        # names as the header gives them; nothing but the first line decides
        first = _csv(spark).option("header", False).csv(row["path"]).first()
        by_header.setdefault(tuple(first or ()), []).append(row["path"])
    read = _read_alike if rescued is None else _read_rescued
    parts = [
        read(spark, files, header, schema, *([rescued] if rescued else []))
        for header, files in by_header.items()
    ]
    if not parts:
        empty = spark.createDataFrame([], schema)
        return empty if rescued is None else empty.withColumn(rescued, F.lit(None).cast(_RESCUED))
    return reduce(DataFrame.unionByName, parts)


_RESCUED = (
    "struct<file:string,line:bigint,row:string,"
    "problems:array<struct<column:string,value:string,expected:string>>>"
)


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, line, value)``: the lines of text files with their numbers from 1.

    A large file is read in splits; lines are numbered in each of them, and the splits of a file
    add up in the order of their positions.
    """
    place = ["file", "split"]
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    # one row per split: a split's lines lie next to each other in one task
    counts = lines.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("split"))
    starts = counts.select(*place, "low", (upto - F.col("n")).alias("before"))
    line = F.col("before") + F.col("id") - F.col("low") + 1
    return lines.join(starts, place).select("file", line.alias("line"), "value")


def _read_rescued(spark, files: list[str], header: tuple, schema: T.StructType, rescued: str):
    """Like :func:`_read_alike`, line by line, with what did not parse."""
    place = {name: i for i, name in reversed(list(enumerate(header)))}
    texts = ", ".join(f"_c{i} string" for i in range(len(header)))
    options = {
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
        "nullValue": "NA",
        "columnNameOfCorruptRecord": "_corrupt",
    }
    lines = numbered_lines(spark, files).filter((F.col("line") > 1) & (F.trim("value") != ""))
    raw = lines.withColumn("c", F.from_csv("value", F.lit(f"{texts}, _corrupt string"), options))

    def text(field):
        return F.nullif(F.col(f"c._c{place[field.name]}"), F.lit(""))

    known = [f for f in schema.fields if f.name in place]
    columns = [
        (text(f).try_cast(f.dataType) if f.name in place else F.lit(None).cast(f.dataType)).alias(
            f.name
        )
        for f in schema.fields
    ]

    def problem(column, value, expected):
        return F.struct(
            F.lit(column).cast("string").alias("column"),
            value.cast("string").alias("value"),
            F.lit(expected).alias("expected"),
        )

    wrong = [
        F.when(
            text(f).isNotNull() & text(f).try_cast(f.dataType).isNull(),
            problem(f.name, text(f), f.dataType.simpleString()),
        )
        for f in known
        if not isinstance(f.dataType, T.StringType)
    ]
    fields = F.when(
        F.col("c._corrupt").isNotNull(), problem(None, F.lit(None), f"{len(header)} fields")
    )
    problems = F.array_compact(F.array(fields, *wrong))
    found = F.struct("file", "line", F.col("value").alias("row"), problems.alias("problems"))
    return raw.select(*columns, F.when(F.size(problems) > 0, found).cast(_RESCUED).alias(rescued))


def _csv(spark: SparkSession):
    return (
        spark.read.option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", "NA")
    )


def _read_alike(spark, files: list[str], header: tuple, schema: T.StructType) -> DataFrame:
    """Files that share a header; every field is text first, so pruning changes nothing."""
    place = {name: i for i, name in reversed(list(enumerate(header)))}
    texts = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])
    raw = _csv(spark).schema(texts).option("header", True).option("enforceSchema", True).csv(files)

    def column(field):
        if field.name not in place:
            return F.lit(None).cast(field.dataType).alias(field.name)
        # a quoted empty field arrives as '' although it means "missing" as well
        text = F.nullif(F.col(f"_c{place[field.name]}"), F.lit(""))
        return text.try_cast(field.dataType).alias(field.name)

    return raw.select(*[column(f) for f in schema.fields])


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Persist an intermediate result by name (Parquet, replacing an earlier one)."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored intermediate result."""
    return spark.read.parquet(path)


class ResultStore:
    """Named results in one folder, with a manifest that says where and how each is laid out.

    A result may be bucketed by a key: rows of a key share a file and are sorted by it, so
    joins, groupings and windows by that key start without a shuffle. Saving a name again
    adds a version; readers get the latest, and what is being read stays. Any session that
    knows the folder can read by name.
    """

    ENTRY = (
        "name string, path string, schema string, by string, buckets int, rows long,"
        " saved timestamp"
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """One row per saved version."""
        path = f"{self.folder}/manifest"
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(target):
            return self.spark.createDataFrame([], self.ENTRY)
        return self.spark.read.schema(self.ENTRY).parquet(path)

    def save(
        self, df: DataFrame, name: str, by: str | None = None, buckets: int | None = None
    ) -> None:
        """Store ``df`` under ``name``; ``by`` buckets it, one file per bucket."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(path)
        else:
            buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            table = self._table(path)
            writer = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
            writer.option("path", path).format("parquet").saveAsTable(table)
        rows = self.spark.read.parquet(path).count()
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        now = datetime.now(timezone.utc)
        entry = [(name, path, kinds, by, buckets if by else None, rows, now)]
        self.spark.createDataFrame(entry, self.ENTRY).coalesce(1).write.mode("append").parquet(
            f"{self.folder}/manifest"
        )

    def read(self, name: str) -> DataFrame:
        """The latest version of a named result, in its layout."""
        entry = self.manifest().filter(F.col("name") == name).orderBy(F.desc("saved")).first()
        if entry is None:
            raise KeyError(name)
        if entry["by"] is None:
            return self.spark.read.schema(entry["schema"]).parquet(entry["path"])
        table = self._table(entry["path"])
        by = f"`{entry['by']}`"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({entry['schema']}) USING parquet"
            f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {entry['buckets']} BUCKETS"
            f" LOCATION '{entry['path']}'"
        )
        return self.spark.table(table)

    @staticmethod
    def _table(path: str) -> str:
        """The name of a version in the session's catalog."""
        return "stored_" + path.rsplit("-", 1)[1]


def run_stamp(now: datetime | None = None) -> str:
    """Hour stamp that names a model run, e.g. ``2022-07-27 14``."""
    return (now or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H")


def save_model_run(
    draws: DataFrame, path: str, model: str, run_id: str | None = None
) -> str:
    """Store posterior draws under ``model=<name>/run_id=<hour>``; returns the run id.

    A second run of the same model within the same hour replaces the first, other
    runs in the folder stay.
    """
    run_id = run_id or run_stamp()
    (
        draws.withColumn("model", F.lit(model))
        .withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "run_id")
        .parquet(path)
    )
    return run_id


def read_model_run(
    spark: SparkSession, path: str, model: str, run_id: str | None = None
) -> DataFrame:
    """Read the draws of one run (default: the latest); other runs are never opened."""
    runs = spark.read.parquet(path).filter(F.col("model") == model)
    runs = runs.withColumn("run_id", F.col("run_id").cast("string"))
    if run_id is None:
        run_id = runs.agg(F.max("run_id")).first()[0]
    return runs.filter(F.col("run_id") == run_id).drop("model", "run_id")


#: Columns of the location export.
LOCATION_COLUMNS = [
    "Latitude",
    "Longitude",
    "tag",
    "dateTime",
    "species",
    "Length",
    "Weight",
]


def locations(captures: DataFrame) -> DataFrame:
    """Where and when each tagged fish was caught."""
    return captures.select(*LOCATION_COLUMNS).filter(
        ~F.col("tag").isin(*UNTAGGED_MARKS)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV part files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_month_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Read month medians and intervals written by :func:`write_csv`."""
    return spark.read.schema(MONTH_INTERVALS).option("header", True).csv(path)
