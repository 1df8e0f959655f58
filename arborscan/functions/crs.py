"""UTM <-> WGS84 longitude/latitude as Column expressions (Krueger series to third order).

Fixed values: WGS84 ellipsoid, UTM scale factor and false origin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from arborscan.functions.rings import let

AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST0, NORTH0_SOUTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def zone_of_tile(tile_name: Column) -> tuple[Column, Column]:
    """(UTM zone number, true when north) of a tile name such as ``36UYA``."""
    return (F.regexp_extract(tile_name, r"^(\d+)", 1).try_cast("int"),
            F.regexp_extract(tile_name, r"^\d+([C-Z])", 1) >= "N")


def _meridian(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def _xy(x: Column, y: Column, names: tuple[str, str]) -> Column:
    return F.struct(x.alias(names[0]), y.alias(names[1]))


def to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> Column:
    """struct<x,y> in metres."""
    phi = F.radians(lat.cast("double"))
    dl = F.radians(lon.cast("double")) - _meridian(zone)
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))

    def series(v: Column) -> Column:
        xi, eta = v["x"], v["y"]
        east = eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
        nrth = xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
        return _xy(EAST0 + _RADIUS * east, F.when(north, 0.0).otherwise(NORTH0_SOUTH) + _RADIUS * nrth, ("x", "y"))

    return let(_xy(F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t)), ("x", "y")), series)


def to_lonlat(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """struct<x,y> with x = longitude and y = latitude in degrees."""
    xi0 = (y - F.when(north, 0.0).otherwise(NORTH0_SOUTH)) / _RADIUS
    eta0 = (x - EAST0) / _RADIUS

    def inverse(v: Column) -> Column:
        xi = v["x"] - sum(b * F.sin(2 * (j + 1) * v["x"]) * F.cosh(2 * (j + 1) * v["y"]) for j, b in enumerate(_BETA))
        eta = v["y"] - sum(b * F.cos(2 * (j + 1) * v["x"]) * F.sinh(2 * (j + 1) * v["y"]) for j, b in enumerate(_BETA))
        return _xy(xi, eta, ("x", "y"))

    def angles(v: Column) -> Column:
        chi = F.asin(F.sin(v["x"]) / F.cosh(v["y"]))
        lon = F.degrees(_meridian(zone) + F.atan2(F.sinh(v["y"]), F.cos(v["x"])))
        lat = let(chi, lambda c: F.degrees(c + sum(d * F.sin(2 * (j + 1) * c) for j, d in enumerate(_DELTA))))
        return _xy(lon, lat, ("x", "y"))

    return let(let(_xy(xi0, eta0, ("x", "y")), inverse), angles)


def reproject(shape: Column, zone: Column, north: Column, to: str) -> Column:
    """Rings in the other system; ``to`` is ``lonlat`` or ``utm``."""
    convert = {"lonlat": to_lonlat, "utm": to_utm}.get(to)
    if convert is None:
        raise ValueError(f"unsupported target system: {to}")
    return F.transform(shape, lambda ring: F.transform(ring, lambda p: convert(p["x"], p["y"], zone, north)))
