"""Rainfall, runoff and pond queries. lineitem is a table of daily rain: site = l_suppkey, date = l_shipdate, mm = l_quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwater.operators import hydrology as H

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def daily(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("precipitation_sum"))


DAILY = "r AS (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DECIMAL(18,4)) AS mm FROM lineitem)"
HALF = "floor({x} * {k} + 0.5) / {k}"
half = lambda x, digits=2: HALF.format(x=f"({x})", k=f"{10**digits}.0::DOUBLE")
YEARS = "n AS (SELECT site, count(DISTINCT year(date)) AS years, sum(mm) AS mm, sum(CASE WHEN month(date) BETWEEN 6 AND 9 THEN mm ELSE 0 END) AS wet, min(year(date)) AS y0, max(year(date)) AS y1 FROM r GROUP BY site)"
ANNUAL = half("CAST(mm AS DOUBLE) / years")
# A site's catchment, slope and coefficient for the runoff queries.
AREA, STEEP, COEFF = "(site % 40) * 0.01", "CAST(site % 11 AS DOUBLE)", "CASE WHEN site % 7 = 0 THEN NULL WHEN site % 13 = 0 THEN 1.5 ELSE (site % 10) / 10.0 END"


@query(f"WITH {DAILY} SELECT site, year(date)::INT AS year, CAST(sum(mm) AS DOUBLE) AS total_mm FROM r GROUP BY 1, 2")
def rainfall_annual(spark, d):
    return H.annual(daily(spark, d)).withColumn("total_mm", F.col("total_mm").cast("double"))


@query(f"""WITH {DAILY}, {YEARS}, m AS (SELECT site, month(date) AS month, sum(mm) AS mm FROM r GROUP BY 1, 2)
SELECT n.site, k.month::INT AS month, {half("coalesce(CAST(m.mm AS DOUBLE), 0) / years")} AS mean_mm FROM n CROSS JOIN (SELECT unnest(range(1, 13)) AS month) k LEFT JOIN m ON m.site = n.site AND m.month = k.month""")
def rainfall_monthly(spark, d):
    return H.monthly(daily(spark, d))


@query(f"WITH {DAILY}, {YEARS} SELECT site, 'success' AS status, {ANNUAL} AS annual_avg_mm, {half('CAST(wet AS DOUBLE) / years')} AS monsoon_mm, 'Historical daily precipitation was averaged across complete calendar years ' || y0 || '–' || y1 || '.' AS message FROM n")
def rainfall_monsoon(spark, d):
    return H.climatology(daily(spark, d)).select("site", "status", "annual_avg_mm", "monsoon_mm", "message")


@query(f"""WITH r AS (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_orderkey % 9999 = 5 THEN NULL WHEN l_orderkey % 9999 = 7 THEN -1 ELSE l_quantity END AS mm FROM lineitem)
SELECT site, CASE WHEN bool_or(mm IS NULL OR mm < 0) THEN 'unavailable' ELSE 'success' END AS status FROM r GROUP BY site""")
def rainfall_validation(spark, d):
    k = F.col("l_orderkey") % 9999
    rain = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("date"), F.when(k == 5, None).when(k == 7, -1.0).otherwise(F.col("l_quantity")).alias("precipitation_sum"))
    return H.climatology(rain).select("site", "status")


def _sites(spark, d) -> DataFrame:
    s = H.climatology(daily(spark, d))
    return s.withColumn("catchment_area_km2", F.expr("(site % 40) * double(0.01)")).withColumn("slope_deg", F.expr("double(site % 11)")).withColumn("c", F.expr("CASE WHEN site % 7 = 0 THEN NULL WHEN site % 13 = 0 THEN double(1.5) ELSE (site % 10) / double(10) END"))


RUN = f"""{DAILY}, {YEARS}, s AS (SELECT site, {ANNUAL} AS rain, (site % 40) * 0.01::DOUBLE AS area, CAST(site % 11 AS DOUBLE) AS slope, coalesce(CASE WHEN site % 7 = 0 THEN NULL WHEN site % 13 = 0 THEN 1.5::DOUBLE ELSE (site % 10) / 10.0::DOUBLE END, 0.35::DOUBLE) AS c FROM n),
q AS (SELECT *, CASE WHEN area > 0 AND c BETWEEN 0 AND 1 THEN {half("c * (rain / 1000) * (area * 1000000)")} END AS m3 FROM s)"""


@query(f"""WITH {RUN} SELECT site, CASE WHEN m3 IS NULL THEN 'unavailable' ELSE 'success' END AS runoff_status, m3 AS annual_runoff_m3,
CASE WHEN area <= 0 THEN 'Runoff is unavailable because no valid catchment area was delineated.' WHEN c > 1 THEN 'Runoff is unavailable because the runoff coefficient must be between 0 and 1.' ELSE 'Planning estimate using average historical rainfall, delineated catchment area, and runoff coefficient C=' || printf('%.2f', c) || '.' END AS runoff_message FROM q""")
def runoff(spark, d):
    return H.runoff(_sites(spark, d), coefficient="c").select("site", "runoff_status", "annual_runoff_m3", "runoff_message")


@query(f"""WITH {RUN}, z AS (SELECT *, CASE WHEN slope > 5 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS depth FROM q) SELECT site, CASE WHEN m3 IS NULL THEN 'unavailable' ELSE 'success' END AS pond_status, CASE WHEN m3 IS NOT NULL THEN depth END AS recommended_depth_m,
{half("m3 * 0.8::DOUBLE")} AS estimated_storage_m3, {half("m3 * 0.8::DOUBLE / depth")} AS estimated_surface_area_m2 FROM z""")
def pond_size(spark, d):
    return H.pond(H.runoff(_sites(spark, d), coefficient="c")).select("site", "pond_status", "recommended_depth_m", "estimated_storage_m3", "estimated_surface_area_m2")


@query(f"WITH {RUN} SELECT site, area * 1e6 AS area_m2, {half('0.35::DOUBLE * (rain / 1000) * (area * 1000000)')} AS expected_volume_m3 FROM q")
def candidate_volume(spark, d):
    return H.candidate_volume(_sites(spark, d)).select("site", (F.col("catchment_area_km2") * 1e6).alias("area_m2"), "expected_volume_m3")
