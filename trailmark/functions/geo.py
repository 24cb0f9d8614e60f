"""Geometry and cost formulas as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_PER_DEGREE = 111.32
TILE = 256


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    # least() would skip a null, so that a missing place would lie at the antipodes.
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def equirect_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    m = KM_PER_DEGREE * 1000
    return F.sqrt(F.pow((lat2 - lat1) * m, 2) + F.pow((lng2 - lng1) * m * F.cos(F.radians((lat1 + lat2) / 2)), 2))


def bbox_area_km2(south: Column, west: Column, north: Column, east: Column) -> Column:
    return (north - south) * KM_PER_DEGREE * (east - west) * KM_PER_DEGREE * F.cos(F.radians((south + north) / 2))


def mercator_pixel(lat: Column, lng: Column, zoom: Column | int) -> tuple[Column, Column]:
    size = TILE * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    s = F.sin(F.radians(lat))
    return (lng + 180) / 360 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size


def tile_xy(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    x, y = mercator_pixel(lat, lng, zoom)
    return F.floor(x / TILE), F.floor(y / TILE)


def metres_per_px(lat: Column, zoom: int) -> Column:
    return F.cos(F.radians(lat)) * (2 * math.pi * EARTH_M / (TILE * 2**zoom))


def fit_zoom(south: Column, west: Column, north: Column, east: Column, width: int, height: int) -> Column:
    """The largest whole zoom from 19 to 3 at which the box fits; 3 if none does."""
    fits = None
    for z in range(19, 2, -1):
        (x0, y0), (x1, y1) = mercator_pixel(north, west, z), mercator_pixel(south, east, z)
        ok = (x1 - x0 <= width) & (y1 - y0 <= height)
        fits = F.when(ok, z) if fits is None else fits.when(ok, z)
    return fits.otherwise(3)


def fov_from_focal(focal: Column, portrait: Column) -> Column:
    """Degrees across a frame of 36 by 24 mm, by its orientation; one decimal."""
    return F.bround(F.degrees(2 * F.atan(F.when(portrait, 24.0).otherwise(36.0) / (2 * focal))), 1)


def bearing(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


@dataclass(frozen=True)
class Cost:
    """Energy of moving over ground: kJ per metre of distance and of climb."""

    a_roll: float = 0.0055
    a_aero: float = 0.0045
    beta: float = 0.95
    climb_thr: float = 0.03
    ab_ratio: float = 0.012
    eps_offset: float = 0.05


def leg_energy(d: Column, dh: Column, c: Cost = Cost()) -> Column:
    """kJ for d metres that rise by dh: air counts unless it climbs steeply, descents give back a share."""
    up = c.a_roll * d + F.when(dh < c.climb_thr * d, c.a_aero * d).otherwise(0.0) + c.beta * dh
    eps = F.greatest(F.least(c.ab_ratio * d / -dh, F.lit(1.0)) - c.eps_offset, F.lit(0.0))
    down = F.greatest((c.a_roll + c.a_aero) * d - eps * c.beta * -dh, F.lit(0.0))
    return F.when(dh >= 0, up).otherwise(down)
