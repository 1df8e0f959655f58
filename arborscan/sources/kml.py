"""Tile outlines from KML placemarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tile_bounds(placemarks: DataFrame, column: str = "value") -> DataFrame:
    """Placemark text -> name and bounding box of all its coordinates."""
    text = F.col(column)
    name = F.regexp_extract(text, r"<name>([^<]*)</name>", 1)
    blocks = F.regexp_extract_all(text, F.lit(r"<coordinates>([^<]*)</coordinates>"), F.lit(1))
    points = F.filter(F.split(F.array_join(blocks, " "), r"\s+"), lambda p: p != "")
    xs = F.transform(points, lambda p: F.split(p, ",")[0].cast("double"))
    ys = F.transform(points, lambda p: F.split(p, ",")[1].cast("double"))
    return placemarks.select(name.alias("name"), xs.alias("_xs"), ys.alias("_ys")).select(
        "name", F.array_min("_xs").alias("xmin"), F.array_min("_ys").alias("ymin"),
        F.array_max("_xs").alias("xmax"), F.array_max("_ys").alias("ymax"))


def read_tile_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Bounds of every placemark in KML files."""
    rows = (spark.read.format("xml").option("rowTag", "Placemark")
            .schema("name string, Polygon struct<outerBoundaryIs struct<LinearRing struct<coordinates string>>>,"
                    " MultiGeometry struct<Polygon array<struct<outerBoundaryIs struct<LinearRing struct<coordinates string>>>>>")
            .load(path))
    inner = F.concat_ws(" ", F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"),
                        F.array_join(F.col("MultiGeometry.Polygon.outerBoundaryIs.LinearRing.coordinates"), " "))
    text = F.concat(F.lit("<name>"), F.col("name"), F.lit("</name><coordinates>"), inner, F.lit("</coordinates>"))
    return tile_bounds(rows.select(text.alias("value")))
