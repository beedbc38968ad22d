"""Distances and areas on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_008.8
UNITS = {"cm": 0.01, "m": 1.0, "km": 1000.0, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}


def metres(value: float, unit: str = "m") -> float:
    return value * UNITS[unit]


def haversine(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    """Metres between each point and the one given."""
    a = F.pow(F.sin(F.radians(lat - at_lat) / 2), 2) + F.cos(F.radians(F.lit(at_lat))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - at_lon) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within(lat: Column, lon: Column, at_lat: float, at_lon: float, radius: float) -> Column:
    """True up to ``radius`` metres away. The latitude band comes first: it can be pushed into
    the scan and spares the trigonometry of all points outside of it."""
    reach = radius / EARTH_METRES * 180 / 3.141592653589793 + 1e-9
    return lat.between(at_lat - reach, at_lat + reach) & (haversine(lat, lon, at_lat, at_lon) <= radius)


def in_polygon(lat: Column, lon: Column, points: list[tuple[float, float]]) -> Column:
    """Whether a ray to the east crosses the edges an odd number of times."""
    crossings = F.lit(0)
    for (lat1, lon1), (lat2, lon2) in zip(points, points[1:] + points[:1]):
        if lat1 == lat2:
            continue
        spans = (F.lit(lat1) > lat) != (F.lit(lat2) > lat)
        crossings = crossings + F.when(spans & (lon < (lat - lat1) * ((lon2 - lon1) / (lat2 - lat1)) + lon1), 1).otherwise(0)
    return (crossings % 2) == 1
