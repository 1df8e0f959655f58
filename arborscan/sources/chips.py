"""Chip and split indexes as CSV, chip records with binary images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborscan import schemas


def index_line(schema=schemas.CHIP_INDEX) -> Column:
    """One CSV line of an index row."""
    return F.to_csv(F.struct(*schema.names))


def parse_index(lines: DataFrame, schema=schemas.CHIP_INDEX, column: str = "value") -> DataFrame:
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return lines.select(F.from_csv(column, ddl).alias("_r")).select("_r.*")


def write_index(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*partition) if partition else writer).csv(path)


def read_index(spark: SparkSession, path: str, schema=schemas.CHIP_INDEX) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def to_bytes(cells: Column) -> Column:
    """array of 0..255 values -> binary, one byte per cell."""
    return F.unhex(F.array_join(F.transform(cells, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def from_bytes(raw: Column) -> Column:
    """binary -> array<int> of 0..255."""
    text = F.hex(raw)
    return F.transform(F.sequence(F.lit(1), F.octet_length(raw)),
                       lambda i: F.conv(F.substring(text, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Evaluation records as Parquet with binary columns."""
    df.select(*schemas.EVAL_RECORD.names).write.mode(mode).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVAL_RECORD).parquet(path)
