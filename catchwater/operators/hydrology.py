"""Rainfall climatology, runoff, pond size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.params import Params

# Month names, and the texts that results carry.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONSOON = (6, 9)
NO_RAIN = "Runoff is unavailable because historical rainfall data could not be retrieved."
NO_AREA = "Runoff is unavailable because no valid catchment area was delineated."
NO_COEFFICIENT = "Runoff is unavailable because the runoff coefficient must be between 0 and 1."
NO_RUNOFF = "Pond storage is unavailable because annual runoff could not be estimated."
POND = "Planning-level storage estimate using the configured retention factor ({:.0%}) and indicative depth."


def half_up(x: Column, digits: int) -> Column:
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def _bad() -> Column:
    return F.bool_or(F.col("precipitation_sum").isNull() | (F.col("precipitation_sum") < 0) | F.col("date").isNull())


def annual(daily: DataFrame) -> DataFrame:
    """(site, year, total_mm), in decimals so that sums are exact. Years are those present."""
    return daily.groupBy("site", F.year("date").alias("year")).agg(F.sum(F.col("precipitation_sum").cast("decimal(18,4)")).alias("total_mm"))


def monthly(daily: DataFrame) -> DataFrame:
    """(site, month 1..12, mean_mm): totals of a month over the number of years present; a missing month counts as 0."""
    totals = daily.groupBy("site", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum(F.col("precipitation_sum").cast("decimal(18,4)")).alias("mm"))
    site = totals.groupBy("site").agg(F.countDistinct("year").alias("years"))
    all_months = site.select("site", "years", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    sums = totals.groupBy("site", "month").agg(F.sum("mm").alias("mm"))
    return all_months.join(sums, ["site", "month"], "left").select("site", "month", half_up(F.coalesce("mm", F.lit(0)).cast("double") / F.col("years"), 2).alias("mean_mm"))


def climatology(daily: DataFrame) -> DataFrame:
    """(site, status, annual_avg_mm, monthly_avg_mm map, monsoon_mm, message). One null or negative value makes a site's whole record unavailable."""
    valid = daily.groupBy("site").agg(_bad().alias("bad"), F.countDistinct(F.year("date")).alias("years"), F.min(F.year("date")).alias("y0"), F.max(F.year("date")).alias("y1"),
                                      F.sum(F.col("precipitation_sum").cast("decimal(18,4)")).alias("mm"), F.sum(F.when(F.month("date").between(*MONSOON), F.col("precipitation_sum").cast("decimal(18,4)"))).alias("wet"))
    names = F.array(*[F.lit(m) for m in MONTHS])
    by_month = monthly(daily).groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "mean_mm")))).alias("m")).select("site", F.transform_keys("m", lambda k, _: F.element_at(names, k)).alias("m"))
    ok = ~F.col("bad")
    per_year = lambda c: half_up(F.coalesce(c, F.lit(0)).cast("double") / F.col("years"), 2)
    message = F.concat(F.lit("Historical daily precipitation was averaged across complete calendar years "), F.col("y0").cast("string"), F.lit("–"), F.col("y1").cast("string"), F.lit("."))
    return valid.join(by_month, "site", "left").select("site", F.when(ok, "success").otherwise("unavailable").alias("status"), F.when(ok, per_year(F.col("mm"))).alias("annual_avg_mm"), F.when(ok, F.col("m")).alias("monthly_avg_mm"), F.when(ok, per_year(F.col("wet"))).alias("monsoon_mm"),
                                                       F.when(ok, message).otherwise("Historical rainfall data could not be retrieved.").alias("message"))


def runoff(df: DataFrame, p: Params = Params(), rain: str = "annual_avg_mm", area: str = "catchment_area_km2", coefficient: str | None = None) -> DataFrame:
    """df with runoff_status, annual_runoff_m3 and runoff_message: C x P x A, unavailable with a reason where an input does not hold."""
    c = F.coalesce(F.col(coefficient), F.lit(p.runoff_coefficient)) if coefficient else F.lit(p.runoff_coefficient)
    why = F.when(F.col(rain).isNull(), NO_RAIN).when(F.col(area).isNull() | (F.col(area) <= 0), NO_AREA).when(~c.between(0, 1), NO_COEFFICIENT)
    return df.withColumn("runoff_status", F.when(why.isNull(), "success").otherwise("unavailable")).withColumn("annual_runoff_m3", F.when(why.isNull(), half_up(c * (F.col(rain) / 1000) * (F.col(area) * 1_000_000), 2))).withColumn(
        "runoff_message", F.coalesce(why, F.concat(F.lit("Planning estimate using average historical rainfall, delineated catchment area, and runoff coefficient C="), F.format_string("%.2f", c), F.lit("."))))


def pond(df: DataFrame, p: Params = Params(), slope: str = "slope_deg") -> DataFrame:
    """df with pond_status, depth, storage and area: a shallower pond on steep ground."""
    q = F.col("annual_runoff_m3")
    depth = F.when(F.col(slope) > p.steep_deg, F.lit(p.steep_depth_m)).otherwise(F.lit(p.depth_m))
    storage = q * p.retention
    return df.withColumn("pond_status", F.when(q.isNotNull(), "success").otherwise("unavailable")).withColumn("recommended_depth_m", F.when(q.isNotNull(), depth)).withColumn("estimated_storage_m3", half_up(storage, 2)).withColumn("estimated_surface_area_m2", half_up(storage / depth, 2)).withColumn(
        "pond_message", F.when(q.isNull(), NO_RUNOFF).otherwise(POND.format(p.retention)))


def candidate_volume(df: DataFrame, p: Params = Params()) -> DataFrame:
    """df with expected_volume_m3 by the area's rain and coefficient; null if an input is."""
    return df.withColumn("expected_volume_m3", half_up(F.lit(p.runoff_coefficient) * (F.col("annual_avg_mm") / 1000) * (F.col("catchment_area_km2") * 1_000_000), 2))
