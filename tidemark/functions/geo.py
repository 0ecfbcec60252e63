"""Distances and cells on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Geohash: the cell numbers of both axes, their bits in turn (longitude first), five to a letter."""
    bits = precision * 5
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * 2**lon_bits), F.lit(2**lon_bits - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * 2**lat_bits), F.lit(2**lat_bits - 1)).cast("long")
    letters = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for i in range(5 * k, 5 * k + 5):
            axis, at = (x, lon_bits - 1 - i // 2) if i % 2 == 0 else (y, lat_bits - 1 - i // 2)
            code = code * 2 + F.shiftright(axis, at).bitwiseAND(F.lit(1).cast("long"))
        letters.append(F.substring(F.lit(_BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def grid_cells(lat: Column, lon: Column, km: float, around: bool = False) -> Column:
    """The square cell of side `km` a point lies in, with its neighbours if `around`: keys for an exact radius join."""
    step = km / 110.0
    row = F.floor(lat / step)
    wide = lambda r: F.lit(step) / F.greatest(F.cos(F.radians(r * step)), F.lit(0.02))
    own = F.array(F.struct(row.alias("r"), F.floor(lon / wide(row)).alias("c")))
    if not around:
        return own
    rows = F.array(*[row + i for i in (-1, 0, 1)])
    return F.flatten(F.transform(rows, lambda r: F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.struct(r.alias("r"), (F.floor(lon / wide(r)) + i).alias("c")))))
