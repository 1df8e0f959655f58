"""Band arithmetic per cell."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Order of the nine bands of a stacked scene.
STACK = ("tci_r", "tci_g", "tci_b", "b8", "b8a", "b11", "b12", "ndvi", "ndmi")
# Bands of the stack that each channel name selects.
CHANNELS = {"rgb": (0, 1, 2), "b8": (3,), "b8a": (4,), "b11": (5,), "b12": (6,), "ndvi": (7,), "ndmi": (8,)}
# Default nodata and rank of each raster type.
NODATA = {"Byte": 255, "UInt16": 65535, "Int16": -32767, "UInt32": 4294967293, "Int32": -2147483647,
          "Float32": 3.402823466e38, "Float64": 1.7976931348623158e308}
SQL_TYPES = {"Byte": "int", "UInt16": "int", "Int16": "int", "UInt32": "bigint", "Int32": "int",
             "Float32": "float", "Float64": "double"}
LIMITS = {"Byte": (0, 255), "UInt16": (0, 65535), "Int16": (-32768, 32767), "UInt32": (0, 4294967295),
          "Int32": (-2147483648, 2147483647)}


def normalised_index(a: Column, b: Column) -> Column:
    """(b - a) / (a + b + 0.001)."""
    return (b - a) / (a + b + F.lit(0.001))


def ndvi(red: Column, nir: Column) -> Column:
    return normalised_index(red, nir)


def ndmi(swir: Column, nir: Column) -> Column:
    return normalised_index(swir, nir)


def to_type(value: Column, kind: str) -> Column:
    """Cast with saturation; fractions round half up for integer types."""
    if kind in LIMITS:
        low, high = LIMITS[kind]
        return F.greatest(F.least(F.floor(value + 0.5), F.lit(high)), F.lit(low)).cast(SQL_TYPES[kind])
    return value.cast(SQL_TYPES[kind])


def to_byte(value: Column) -> Column:
    return to_type(value, "Byte")


def clip_range(mean: Column, std: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Two-sigma range inside the value range."""
    return F.greatest(low, mean - 2 * std), F.least(high, mean + 2 * std)


def linear_byte(value: Column, low: Column, high: Column) -> Column:
    """Linear map of low..high to 0..255, saturated; a flat range maps to 0."""
    return to_byte(F.coalesce((value - low) / F.nullif(high - low, F.lit(0.0)) * 255, F.lit(0.0)))


def max_scaled(value: Column, top: Column, limit: float) -> Column:
    return F.when(top > 0, value / F.nullif(top, F.lit(0)) * limit).otherwise(value.cast("double"))


def difference_byte(current: Column, previous: Column) -> Column:
    """((c - p) / (c + p) + 1) * 127 truncated to a byte; 0/0 counts as no difference."""
    ratio = F.coalesce((current - previous) / F.nullif(current + previous, F.lit(0.0)), F.lit(0.0))
    return F.pmod(F.floor((ratio + 1) * 127), F.lit(256)).cast("int")


def channel_count(channels: list[str]) -> int:
    """Number of bands the channels select; an unknown name is an error."""
    return len(channel_bands(channels))


def channel_bands(channels: list[str], neighbours: int = 1) -> list[int]:
    """Positions in a stack of ``neighbours`` images, in channel order for each image."""
    unknown = [c for c in channels if c not in CHANNELS]
    if unknown:
        raise ValueError(f"unknown channel: {unknown[0]}")
    return [i * len(STACK) + band for i in range(neighbours) for c in channels for band in CHANNELS[c]]


def select_channels(stack: Column, channels: list[str], neighbours: int = 1) -> Column:
    """The chosen bands of an array of bands."""
    return F.array(*[F.get(stack, F.lit(band)) for band in channel_bands(channels, neighbours)])
