"""Geometry and traffic formulas as column expressions (all of them stay in generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres (fixed value).
EARTH_M = 6_371_000.0
#: Free speed in km/h and capacity in vehicles an hour by road class; other classes get the defaults (fixed values).
SPEED_KMH = {"motorway": 70.0, "trunk": 55.0, "primary": 45.0, "secondary": 38.0, "tertiary": 32.0, "residential": 24.0, "living_street": 12.0, "service": 16.0, "unclassified": 28.0}
CAPACITY_VPH = {"motorway": 2200.0, "trunk": 1600.0, "primary": 1200.0, "secondary": 900.0, "tertiary": 600.0, "residential": 400.0, "living_street": 150.0, "service": 200.0, "unclassified": 500.0}
DEFAULT_SPEED, DEFAULT_CAPACITY = 28.0, 400.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def speed_kmh(highway: Column) -> Column:
    return _lookup(SPEED_KMH, F.coalesce(highway, F.lit("")), DEFAULT_SPEED)


def capacity_vph(highway: Column) -> Column:
    return _lookup(CAPACITY_VPH, F.coalesce(highway, F.lit("")), DEFAULT_CAPACITY)


def travel_time_s(length_m: Column, highway: Column) -> Column:
    return length_m / (speed_kmh(highway) * 1000 / 3600)


def bpr_time(free: Column, volume: Column, capacity: Column, alpha: float = 0.15, beta: float = 4.0) -> Column:
    """Congested travel time; infinite where there is no capacity."""
    return F.when(capacity <= 0, F.lit(float("inf"))).otherwise(free * (1 + alpha * F.pow(volume / F.nullif(capacity, F.lit(0.0)), F.lit(beta))))


def conductance(length: Column) -> Column:
    return F.when(length > 0, 1 / F.nullif(length, F.lit(0.0))).otherwise(1.0)


def heading(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Unit vector from the first place to the second, longitudes scaled by the first latitude's cosine."""
    dx, dy = (lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1
    norm = F.coalesce(F.nullif(F.hypot(dx, dy), F.lit(0.0)), F.lit(1.0))
    return dx / norm, dy / norm


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test of a point against an array of struct(x, y) vertices; half-open in y."""
    n = F.size(polygon)

    def step(odd: Column, i: Column) -> Column:
        a, b = F.element_at(polygon, i), F.element_at(polygon, F.when(i == 1, n).otherwise(i - 1))
        crosses = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(crosses & (x < at), ~odd).otherwise(odd)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(1), n), F.lit(False), step)).otherwise(F.lit(False))


def is_overpass(bridge: Column, layer: Column) -> Column:
    return F.coalesce(bridge, F.lit(False)) | (F.coalesce(layer, F.lit(0)) > 0)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Share of the way from ``low`` to ``high``; 0 where they are equal."""
    return F.when(high - low <= 0, 0.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def path_length_m(places: Column) -> Column:
    """Great-circle length in metres along an array of struct(x, y) places; 0 for fewer than two."""
    step = lambda i: haversine_m(F.element_at(places, i - 1)["y"], F.element_at(places, i - 1)["x"], F.element_at(places, i)["y"], F.element_at(places, i)["x"])
    total = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(places), F.lit(2))), F.lit(0.0), lambda t, i: t + F.when(i <= F.size(places), step(F.least(i, F.size(places)))).otherwise(0.0))
    return F.when(F.size(places) > 1, total).otherwise(0.0)


def saving(samples: Column) -> Column:
    """How many times fewer sources a run of 100,000 sources would have needed; 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.round(F.lit(100_000.0) / F.nullif(samples, F.lit(0))).cast("bigint"))
