"""Coordinate systems: what a WKT says, and areas between longitude/latitude and UTM by Krüger's series."""

from __future__ import annotations

import math
import re

from .geometry import Area

#: Half-axis and flattening of the WGS 84 and GRS 80 ellipsoids (they differ below a tenth of a millimetre).
_A, _F = 6378137.0, 1 / 298.257223563
_SCALE, _EAST, _NORTH = 0.9996, 500_000.0, 10_000_000.0


def is_compound(wkt: str | None) -> bool:
    return bool(wkt and re.search(r"COMPD_CS|COMPOUNDCRS", wkt))


def epsg_of(wkt: str | None) -> int | None:
    """The code of the horizontal system: the last of the first part that has one."""
    if not wkt:
        return None
    part = wkt.split("VERT_CS")[0].split("VERTCRS")[0] if is_compound(wkt) else wkt
    found = re.findall(r'(?:AUTHORITY\["EPSG","|ID\["EPSG",)(\d+)', part)
    return int(found[-1]) if found else None


def utm_zone(epsg: int | None) -> tuple[int, bool] | None:
    """Zone and whether it is northern, of UTM on WGS 84, NAD 83 or ETRS 89."""
    if epsg is None:
        return None
    for low, high, north in ((32601, 32660, True), (32701, 32760, False), (26901, 26923, True), (25828, 25838, True)):
        if low <= epsg <= high:
            return epsg % 100, north
    return None


def _series() -> tuple[float, list[float], list[float]]:
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    backward = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forward, backward


def to_utm(lon: float, lat: float, zone: int, north: bool = True) -> tuple[float, float]:
    radius, forward, _ = _series()
    e = math.sqrt(_F * (2 - _F))
    phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
    s = math.sin(phi)
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(a * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, a in enumerate(forward, 1))
    y = xi + sum(a * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, a in enumerate(forward, 1))
    return _EAST + _SCALE * radius * x, _SCALE * radius * y + (0 if north else _NORTH)


def from_utm(x: float, y: float, zone: int, north: bool = True) -> tuple[float, float]:
    radius, _, backward = _series()
    xi, eta = (y - (0 if north else _NORTH)) / (_SCALE * radius), (x - _EAST) / (_SCALE * radius)
    u = xi - sum(b * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, b in enumerate(backward, 1))
    v = eta - sum(b * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, b in enumerate(backward, 1))
    e = math.sqrt(_F * (2 - _F))
    t = math.sin(u) / math.hypot(math.sinh(v), math.cos(u))
    conformal, phi = t, math.atan(t)
    for _ in range(6):  # from conformal to geodetic latitude
        s = math.sin(phi)
        phi = math.atan(math.sinh(math.asinh(conformal) + e * math.atanh(e * s)))
    return 6 * zone - 183 + math.degrees(math.atan2(math.sinh(v), math.cos(u))), math.degrees(phi)


def area_to(area: Area, source: int, target: int) -> Area:
    """An area in another system: the corners are moved, so nothing has to be done to the points."""
    if source == target:
        return area
    a, b = utm_zone(source), utm_zone(target)
    degrees = {4326, 4269, 4258}

    def move(p: tuple[float, float]) -> tuple[float, float]:
        if source in degrees:
            lon, lat = p
        elif a:
            lon, lat = from_utm(*p, *a)
        else:
            raise ValueError(f"EPSG {source} isn't known here")
        if target in degrees:
            return lon, lat
        if not b:
            raise ValueError(f"EPSG {target} isn't known here")
        return to_utm(lon, lat, *b)

    rings = tuple(tuple(tuple(map(move, ring)) for ring in rings) for rings in area.polygons)
    return Area(rings, tuple(tuple(map(move, line)) for line in area.lines), area.width)
