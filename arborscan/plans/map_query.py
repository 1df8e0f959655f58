"""The change map: every zone's newest polygon coloured by its status in a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborscan.functions import rings
from arborscan.operators import zones
from arborscan.sources import geojson


def change_map(clearcuts: DataFrame, start: str, end: str, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature text per zone whose newest polygon is not empty."""
    status = zones.zone_status(clearcuts, start, end, [geometry]).where(rings.area(F.col(geometry)) > 0)
    return status.select(geojson.feature_text(geojson.from_rings(F.col(geometry)), pk=F.col("id"), color=F.col("status")).alias("value"))
