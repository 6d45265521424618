"""Ground-motion, distance, grid and wind expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Attenuation coefficients, fragility curve, distances.
PGA_BASE, PGA_PER_MAGNITUDE, PGA_PER_LOG_KM = -1.715, 0.500, -1.344
MIN_DISTANCE_KM = 0.1
FRAGILITY_MIDPOINT, FRAGILITY_WIDTH = 0.3, 0.1
KM_PER_DEGREE = 111.0
EARTH_RADIUS_KM = 6371.0
LIQUEFACTION_FACTOR = {"very_high": 2.0, "high": 1.5, "moderate": 1.1, "low": 1.0, "none": 1.0}
DAMAGE_FLOOR = 0.05
HIGH_DAMAGE = 0.7


def gmpe_pga(magnitude: Column, depth_km: Column, distance_km: Column) -> Column:
    """Peak ground acceleration in g from magnitude and hypocentral distance."""
    slant = F.sqrt(distance_km * distance_km + depth_km * depth_km)
    reach = F.greatest(slant, F.lit(MIN_DISTANCE_KM))
    log_pga = F.lit(PGA_BASE) + F.lit(PGA_PER_MAGNITUDE) * magnitude + F.lit(PGA_PER_LOG_KM) * F.log(reach)
    return F.exp(log_pga)


def liquefaction_factor(kind: Column) -> Column:
    factors = F.create_map(*[F.lit(x) for pair in LIQUEFACTION_FACTOR.items() for x in pair])
    return F.coalesce(F.try_element_at(factors, kind), F.lit(1.0))


def damage_probability(pga: Column, kind: Column | None = None) -> Column:
    """Logistic fragility times the soil factor, kept in [0, 1]."""
    base = F.lit(1.0) / (F.lit(1.0) + F.exp(-(pga - FRAGILITY_MIDPOINT) / FRAGILITY_WIDTH))
    if kind is not None:
        base = base * liquefaction_factor(kind)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))


def damage_at(magnitude: float, squared_km: np.ndarray, factor: float) -> np.ndarray:
    """``damage_probability`` of many hypocentral distances (squared) at once, for use inside a task."""
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.maximum(np.sqrt(squared_km), MIN_DISTANCE_KM)
        pga = np.exp(PGA_BASE + PGA_PER_MAGNITUDE * magnitude + PGA_PER_LOG_KM * np.log(reach))
        base = 1.0 / (1.0 + np.exp(-(pga - FRAGILITY_MIDPOINT) / FRAGILITY_WIDTH)) * factor
    return np.fmax(0.0, np.fmin(1.0, base))  # a NaN counts as the largest number, as in Spark


def planar_km(dlat: Column, dlng: Column, origin_lat: Column) -> Column:
    """Flat distance of a degree offset, longitude shrunk at the origin's latitude."""
    north = dlat * KM_PER_DEGREE
    east = dlng * KM_PER_DEGREE * F.cos(F.radians(origin_lat))
    return F.sqrt(north * north + east * east)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def decimals(x: Column, digits: int) -> Column:
    """Rounding by scaled nearest integer; stays in generated code, unlike decimal rounding."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def cell_index(x: Column, res: float) -> Column:
    return F.floor(x / F.lit(res)).cast("bigint")


def cell_origin(index: Column, res: float) -> Column:
    return F.round(index * F.lit(res), 4)


def wind_east(speed_ms: Column, from_deg: Column) -> Column:
    return -F.sin(F.radians(from_deg)) * speed_ms


def wind_north(speed_ms: Column, from_deg: Column) -> Column:
    return -F.cos(F.radians(from_deg)) * speed_ms


def inside_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Even-odd test of a point against ``array<struct<lng,lat>>``, closed or not."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    crossings = F.zip_with(
        ring,
        shifted,
        lambda a, b: F.when(
            ((a["lat"] > lat) != (b["lat"] > lat))
            & (lng < (b["lng"] - a["lng"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"]),
            1,
        ).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda n, c: n + c) % 2 == 1


def inside_edges(lat: Column, lng: Column, edges: Column) -> Column:
    """The same test against the ring's edges, ``array<struct<ay,ax,by,bx>>``."""
    crosses = lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (
        lng < (e["bx"] - e["ax"]) * (lat - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
    )
    return F.size(F.filter(edges, crosses)) % 2 == 1


def polygon_centroid(ring: Column) -> Column:
    """Mean of the ring's vertices, the closing one included."""
    n = F.size(ring)
    total = lambda axis: F.aggregate(ring, F.lit(0.0), lambda s, v: s + v[axis])
    return F.struct((total("lat") / n).alias("lat"), (total("lng") / n).alias("lng"))
