"""Names, paths and dates of scenes, tiles and chips."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONES = (1, 60)


def tile_name_to_uri(name: Column) -> Column:
    """``36UYA`` -> ``36/U/YA``; null when zone, latitude band or square is out of range."""
    zone = F.regexp_extract(name, r"^(\d+)[C-Z][A-Z]{2}$", 1)
    band = F.regexp_extract(name, r"^\d+([C-Z])[A-Z]{2}$", 1)
    square = F.regexp_extract(name, r"^\d+[C-Z]([A-Z]{2})$", 1)
    number = zone.try_cast("int")
    return F.when(number.between(*ZONES), F.concat_ws("/", number.cast("string"), band, square))


def granule_date(path: Column) -> Column:
    """Date of the first ``_YYYYMMDDThhmmss`` in a path, null when there is none."""
    stamp = F.regexp_extract(path, r"_(\d{8}T\d{6})", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss")))


def uri_date(uri: Column) -> Column:
    """Date in the last ``_`` token of a granule uri."""
    token = F.element_at(F.split(uri, "_"), -1)
    return F.to_date(F.try_to_timestamp(token, F.lit("yyyyMMdd'T'HHmmss")))


def scene_name_date(name: Column) -> Column:
    """Date prefix of a file name such as ``20190712_...``."""
    return F.to_date(F.try_to_timestamp(F.element_at(F.split(name, "_"), 1), F.lit("yyyyMMdd")))


def is_winter(day: Column) -> Column:
    return F.when(F.month(day).isin(12, 1, 2), 1.0).otherwise(0.0)


def split_chip_name(full: Column) -> tuple[Column, Column]:
    """``a_b_r_c`` -> (``a_b``, ``r_c``): the last two tokens are the position."""
    parts = F.split(full, "_")
    size = F.size(parts)
    name = F.array_join(F.slice(parts, F.lit(1), F.greatest(size - 2, F.lit(0))), "_")
    position = F.array_join(F.slice(parts, F.greatest(size - 1, F.lit(1)), F.lit(2)), "_")
    return name, position


def join_chip_name(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def image_info(file_name: Column) -> tuple[Column, Column]:
    """First two tokens, and the two tokens before the extension, of a chip file name."""
    parts = F.split(file_name, "[_.]")
    size = F.size(parts)
    return F.array_join(F.slice(parts, 1, 2), "_"), F.array_join(F.slice(parts, size - 2, F.lit(2)), "_")


def predicted_name(tile: Column, first: Column, second: Column) -> Column:
    return F.concat(F.concat_ws("_", F.lit("predicted"), tile, first.cast("string"), second.cast("string")),
                    F.lit(".geojson"))


def scene_path(root: str, tile: Column, day: Column, file_name: str) -> Column:
    return F.concat_ws("/", F.lit(root), tile, day.cast("string"), F.lit(file_name))


def utc_text(stamp: Column) -> Column:
    """UTC text at second precision."""
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def decimal_to_double(value: Column) -> Column:
    return value.cast("double")
