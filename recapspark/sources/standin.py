"""Capture-shaped view of the ``orders`` test table.

A customer plays a fish, an order a capture; some orders are a fish caught once. The same text runs on Spark and on
DuckDB, so both sides of a comparison start from equal rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURES_SQL = """
SELECT
  CASE WHEN o_orderkey % 61 = 0 THEN NULL
       ELSE CAST(o_orderkey % 1000 AS double) / 1024 - 75 END AS Longitude,
  CASE WHEN o_orderkey % 61 = 0 THEN NULL
       ELSE CAST(o_orderkey % 500 AS double) / 512 + 41 END AS Latitude,
  CASE WHEN o_orderkey % 997 = 0 THEN NULL
       ELSE substr(ds,9,2) || '-' || substr(ds,6,2) || '-' || substr(ds,1,4) END AS Date,
  CASE WHEN o_orderkey % 991 = 0 THEN NULL ELSE
    lpad(CAST(CAST(floor(sec/3600) AS int) AS string),2,'0') || ':' ||
    lpad(CAST(CAST(floor((sec%3600)/60) AS int) AS string),2,'0') || ':' ||
    lpad(CAST(CAST(sec%60 AS int) AS string),2,'0') END AS Time,
  CAST(o_orderkey % 100 AS double) AS SiteLen,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 300 AS double) / 4 END AS Discharge,
  CAST(o_orderkey % 80 AS double) / 4 AS WaterTemp,
  CASE WHEN o_orderkey % 2 = 0 THEN 'boat' ELSE 'wading' END AS GearType,
  CAST(o_orderkey % 7 AS double) / 2 AS TimeFish,
  o_orderkey AS FishNum,
  CASE WHEN o_orderkey % 89 = 0 THEN 999 WHEN o_orderstatus = 'F' THEN 326
       WHEN o_orderstatus = 'O' THEN 328 ELSE 329 END AS SpeciesCd,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice / 1000 END AS Length,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE CAST(o_orderkey % 5000 AS double) / 16 END AS Weight,
  CASE WHEN o_orderkey % 5 = 0 THEN 'no' ELSE 'yes' END AS Wild,
  CASE WHEN o_orderkey % 3 = 0 THEN 'adult' ELSE NULL END AS Stage,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       WHEN o_orderkey % 7 = 0 THEN 'S' || CAST(o_orderkey AS string) ELSE 'T' || CAST(o_custkey AS string) END AS MarkAppCd,
  CASE WHEN o_orderkey % 77 = 0 THEN 'AD' WHEN o_orderkey % 121 = 0 THEN NULL
       ELSE 'T' || CAST(o_custkey AS string) END AS MarkPreCd,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT'
       THEN 'West Br Delaware River' ELSE o_orderpriority END AS Water,
  CAST(o_orderkey % 64 AS bigint) AS tblSL_SL_ID, CAST(o_orderkey % 3 AS int) AS Rep,
  o_orderdate < TIMESTAMP '2000-01-01' AS early
FROM (SELECT *, CAST(CAST(o_orderdate AS date) AS string) AS ds,
             (o_orderkey * 7919) % 86400 AS sec FROM {orders}) o
"""


def capture_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two "files" of captures: up to 1999 and from 2000 on."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = spark.sql(CAPTURES_SQL.format(orders="{orders}"), orders=orders)
    rows = rows.withColumnRenamed("MarkPreCd", "Mark PreCd")
    return (
        rows.filter(F.col("early")).drop("early"),
        rows.filter(~F.col("early")).drop("early"),
    )


#: Fifteen model parameters, picked by ``event_id % 15``; both chains cover each of them.
DRAWS_SQL = """
SELECT CAST({idiv} % 2 + 1 AS int) AS chain,
       CAST({idiv2} AS int) AS iter,
       CASE CAST(event_id % 15 AS int)
         WHEN 0 THEN 'betaPhi[1, 1]'  WHEN 1 THEN 'betaPhi[2, 1]'  WHEN 2 THEN 'betaPhi[3, 1]'
         WHEN 3 THEN 'betaPhi[1, 2]'  WHEN 4 THEN 'betaPhi[2, 2]'  WHEN 5 THEN 'betaPhi[3, 2]'
         WHEN 6 THEN 'betaPhi[1, 3]'  WHEN 7 THEN 'betaPhi[2, 3]'  WHEN 8 THEN 'betaPhi[3, 3]'
         WHEN 9 THEN 'betaP[1, 1]'    WHEN 10 THEN 'betaP[2, 1]'   WHEN 11 THEN 'betaP[1, 2]'
         WHEN 12 THEN 'psi[1, 1, 1]'  WHEN 13 THEN 'psi[1, 1, 2]'  ELSE 'psi[2, 1, 1]'
       END AS parameter,
       value / 500 AS value
FROM {events}
"""


def raw_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior draws made out of ``events``: (chain, iter, parameter, value)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = DRAWS_SQL.format(
        events="{events}", idiv="(event_id div 15)", idiv2="(event_id div 30)"
    )
    return spark.sql(text, events=events)
