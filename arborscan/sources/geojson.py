"""GeoJSON features in and out, one feature per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from arborscan import schemas
from arborscan.functions import rings


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """GeoJSON Polygon of an axis-parallel rectangle, counter-clockwise and closed."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return polygon(F.array(F.array(*[F.array(x, y) for x, y in corners])))


def polygon(coordinates: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))


def from_rings(shape: Column) -> Column:
    """GeoJSON geometry of a rings array."""
    return polygon(F.transform(shape, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))


def feature_text(geometry: Column, **properties: Column) -> Column:
    """One feature as JSON text."""
    named = F.struct(*[value.alias(name) for name, value in properties.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), named.alias("properties")))


def to_rings(geometry: Column) -> Column:
    """rings array<array<struct<x,y>>> of a parsed Polygon geometry, null for other types."""
    points = F.transform(geometry["coordinates"], lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return F.when(geometry["type"] == "Polygon", points)


def area_of(geometry: str) -> Column:
    return rings.area(F.col(geometry))


def _flatten(features: DataFrame, column: str) -> DataFrame:
    f = F.col(column)
    return features.select(f"{column}.properties.*", to_rings(f["geometry"]).alias("geometry"))


def parse_features(lines: DataFrame, properties: T.StructType, column: str = "value") -> DataFrame:
    """Rows of JSON feature text -> properties plus a rings ``geometry``; bad text gives null geometry."""
    parsed = lines.select(F.from_json(column, schemas.feature(properties), {"mode": "PERMISSIVE"}).alias("_f"))
    return _flatten(parsed, "_f")


def parse_markup(lines: DataFrame) -> DataFrame:
    return parse_features(lines, schemas.MARKUP_PROPERTIES)


def read_collection(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """Features of FeatureCollection files, properties and rings geometry per row."""
    shape = T.StructType([T.StructField("features", T.ArrayType(schemas.feature(properties)))])
    whole = spark.read.schema(shape).option("multiLine", True).json(path)
    return _flatten(whole.select(F.explode("features").alias("_f")), "_f")


def read_features(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """Features of newline-delimited files, properties and rings geometry per row."""
    return parse_features(spark.read.text(path), properties)


def write_features(df: DataFrame, path: str, geometry: str = "geometry", mode: str = "overwrite") -> None:
    """Newline-delimited features; the sink that scales with the number of tasks."""
    others = {c: F.col(c) for c in df.columns if c != geometry}
    (df.select(feature_text(from_rings(F.col(geometry)), **others).alias("value"))
     .write.mode(mode).text(path))


def valid_only(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows with a parsed, closed, non-empty outer ring. Flags stay on the row they came with."""
    outer = F.col(geometry)[0]
    closed = (F.element_at(outer, 1) == F.element_at(outer, -1)) & (F.size(outer) >= 4)
    return df.where(F.col(geometry).isNotNull() & (F.size(geometry) > 0)).where(closed)
