"""Clearcut zones: period filters, change status, newest clearcut and area series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

CHANGED, UNCHANGED, NO_DATA = 0, 1, 2
STATUSES = (-1, 0, 1)
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def check_period(start: str, end: str, prefix: bool = False) -> None:
    """Reject bounds that are not dates; ``prefix=True`` accepts trailing text."""
    match = re.match if prefix else re.fullmatch
    for bound in (start, end):
        if not match(_DATE, bound):
            raise ValueError(f"not a date: {bound!r}")


def counted(clearcuts: DataFrame) -> DataFrame:
    """Forest loss without cloud in zones that belong to a tile."""
    return clearcuts.where((F.col("forest") == 1) & (F.col("clouds") == 0) & F.col("tile_id").isNotNull())


def between(clearcuts: DataFrame, start: str, end: str) -> DataFrame:
    check_period(start, end, prefix=True)
    return clearcuts.where(F.col("image_date_current").between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date")))


def in_period(clearcuts: DataFrame, start: str, end: str, prefix: bool = False) -> DataFrame:
    """Counted clearcuts with a current date in the period, both ends included."""
    check_period(start, end, prefix)
    return counted(between(clearcuts, start, end))


def date_span(period: DataFrame) -> DataFrame:
    """First and last date per zone, ``several`` when they differ."""
    return (period.groupBy("zone_id").agg(F.min("image_date_current").alias("min_date"), F.max("image_date_current").alias("max_date"))
            .withColumn("several", F.col("max_date") > F.col("min_date")))


def zone_dates(period: DataFrame) -> DataFrame:
    """Area per zone and date: one row per calendar day however many clearcuts a zone holds."""
    return period.groupBy("zone_id", "image_date_current").agg(F.sum("area").alias("area"))


def change(period: DataFrame) -> DataFrame:
    """Status of every zone in the period: CHANGED when the area grew from its first to its last date."""
    ends = zone_dates(period).groupBy("zone_id").agg(
        F.min("image_date_current").alias("min_date"), F.max("image_date_current").alias("max_date"),
        F.min_by("area", "image_date_current").alias("min_date_area"),
        F.max_by("area", "image_date_current").alias("max_date_area"))
    return ends.withColumn("status", F.when(F.col("min_date_area") < F.col("max_date_area"), CHANGED).otherwise(UNCHANGED))


def newest(clearcuts: DataFrame, values: list[str]) -> DataFrame:
    """Newest counted clearcut per zone: by date, then larger area, then smaller id.

    A maximum over a struct needs no sort and combines before the shuffle.
    """
    order = F.struct("image_date_current", "area", (-F.col("id")).alias("_nid"))
    return (counted(clearcuts).groupBy("zone_id")
            .agg(F.max_by(F.struct("id", "image_date_current", "area", *values), order).alias("_n")).select("zone_id", "_n.*"))


def zone_status(clearcuts: DataFrame, start: str, end: str, values: list[str] = ()) -> DataFrame:
    """Every zone with its newest clearcut and its status in the period (NO_DATA outside it)."""
    status = change(in_period(clearcuts, start, end)).select("zone_id", "status")
    return (newest(clearcuts, list(values)).join(status, "zone_id", "left")
            .withColumn("status", F.coalesce(F.col("status"), F.lit(NO_DATA))))


def changed_semi(clearcuts: DataFrame, start: str, end: str) -> DataFrame:
    """Counted clearcuts of the period in zones seen on more than one date."""
    period = in_period(clearcuts, start, end)
    return period.join(date_span(period).where("several").select("zone_id"), "zone_id", "left_semi")


def area_series(clearcuts: DataFrame, start: str, end: str) -> DataFrame:
    """Area per zone and date in the period; no forest or cloud filter."""
    check_period(start, end)
    return zone_dates(between(clearcuts, start, end)).withColumnRenamed("area", "zone_area")


def area_chart(clearcuts: DataFrame, clearcut_id: int, start: str, end: str) -> DataFrame:
    """Area series of the zone a clearcut belongs to; empty for an unknown id, an error if an id is in two zones."""
    one = F.when(F.count_distinct("zone_id") > 1, F.raise_error(F.lit(f"clearcut {clearcut_id} is in two zones"))).otherwise(F.max("zone_id"))
    zone = clearcuts.where(F.col("id") == clearcut_id).agg(one.alias("zone_id")).scalar()
    return area_series(clearcuts.where(F.col("zone_id") == zone), start, end)


def review(clearcuts: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply review rows (id, status[, mpoly], review_no) -> (updated clearcuts, rejected reviews).

    A review with a status outside {-1, 0, 1} is rejected; of several valid ones the last
    counts. Dates are never touched.
    """
    valid = F.col("status").isin(*STATUSES)
    columns = [c for c in ("status", "mpoly") if c in reviews.columns]
    last = (reviews.where(valid).groupBy("id")
            .agg(F.max_by(F.struct(*[F.col(c).alias(f"_r_{c}") for c in columns]), "review_no").alias("_r")))
    merged = (clearcuts.join(last.select("id", "_r.*"), "id", "left")
              .withColumns({c: F.coalesce(F.col(f"_r_{c}"), F.col(c)) for c in columns}).drop(*[f"_r_{c}" for c in columns]))
    return merged, reviews.where(~F.coalesce(valid, F.lit(False)))


def route(forest: Column, clouds: Column) -> Column:
    """``rejected`` for detections off forest or under cloud."""
    return F.when((forest == 0) | (clouds == 1), "rejected").otherwise("accepted")


def above_mean_area(detections: DataFrame, task: list[str], share: float = 0.2) -> DataFrame:
    """Detections larger than ``share`` of the mean area of their task (strict).

    The mean comes from an aggregate and is joined back instead of a window, so a task
    holding most rows is never sorted into one partition.
    """
    mean = detections.groupBy(*task).agg(F.avg("area").alias("mean_area"))
    return detections.join(mean, task).where(F.col("area") > F.col("mean_area") * share)


def assign_zone(matches: DataFrame, new_id: str) -> DataFrame:
    """Zone of the matched clearcut with the largest overlap (first id on ties) and the earliest previous date.

    ``matches``: new_id, old_id, zone_id, overlap, image_date_previous.
    """
    order = F.struct("overlap", (-F.col("old_id")).alias("_nid"))
    return matches.groupBy(new_id).agg(F.max_by("zone_id", order).alias("zone_id"), F.max("overlap").alias("overlap"),
                                       F.min("image_date_previous").alias("image_date_previous"),
                                       F.count("*").alias("matches"))
