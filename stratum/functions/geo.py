"""Geographic scalar functions as Column expressions. Angles are radians unless a name says degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371.0


def to_cartesian(lat: Column, lon: Column, r: Column) -> tuple[Column, Column, Column]:
    """x, y, z of a geographic point."""
    return r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)


def to_geographic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and radius of a Cartesian point."""
    return F.atan2(z, F.sqrt(x * x + y * y)), F.atan2(y, x), F.sqrt(x * x + y * y + z * z)


def distance(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    """Straight-line distance."""
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angular distance; rounding can't push the root over 1."""
    dlat, dlon = (lat2 - lat1) / 2, (lon2 - lon1) / 2
    h = F.sqrt(F.sin(dlat) * F.sin(dlat) + F.cos(lat1) * F.cos(lat2) * F.sin(dlon) * F.sin(dlon))
    return 2 * F.asin(F.least(h, F.lit(1.0)))


def at_pole(lat: Column) -> Column:
    return F.abs(F.abs(lat) - F.lit(3.141592653589793 / 2)) < 1e-12


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Azimuth from the first point to the second; the longitude of a pole counts as 0."""
    dlon = lon2 - F.when(at_pole(lat1), 0.0).otherwise(lon1)
    return F.atan2(F.sin(dlon) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dlon))


def destination(lat: Column, lon: Column, delta: Column, azimuth: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached by an arc of delta at azimuth. From the south pole the azimuth is the longitude, from the north pole pi minus it."""
    lat2 = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(lat) * F.cos(delta) + F.cos(lat) * F.sin(delta) * F.cos(azimuth))))
    lon2 = lon + F.atan2(F.sin(azimuth) * F.sin(delta) * F.cos(lat), F.cos(delta) - F.sin(lat) * F.sin(lat2))
    south, north = at_pole(lat) & (lat < 0), at_pole(lat) & (lat > 0)
    return lat2, F.when(south, azimuth).when(north, F.lit(3.141592653589793) - azimuth).otherwise(lon2)


def linear_index(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    """1-based index of lattice node (i, j, k), latitude fastest."""
    return (k - 1) * (nx * ny) + (j - 1) * nx + i


def lattice_index(index: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    """(i, j, k) of a 1-based index."""
    k = F.floor((index - 1) / (nx * ny)).cast("long") + 1
    j = F.floor((index - 1 - (k - 1) * (nx * ny)) / nx).cast("long") + 1
    return F.pmod(index - 1, F.lit(nx)) + 1, j, k


def clamped_index(dims: list[int], subs: list[Column]) -> Column:
    """1-based index of subscripts, each held within its dimension."""
    out, stride = F.lit(1).cast("long"), 1
    for n, s in zip(dims, subs, strict=True):
        out = out + (F.greatest(F.lit(1), F.least(F.lit(n), s)) - 1) * stride
        stride *= n
    return out


def regular_index(value: Column, low: float, step: float) -> Column:
    """1-based index of the nearest point of a regular axis, halves up."""
    return F.floor((value - low) / step + 0.5).cast("long") + 1


def axis_rotation(angle: Column, axis: int) -> list[list[Column]]:
    """Rows of the matrix that turns by an angle about axis 1, 2 or 3."""
    if axis not in (1, 2, 3):
        raise ValueError("axis is 1, 2 or 3")
    one, zero, c, s = F.lit(1.0), F.lit(0.0), F.cos(angle), F.sin(angle)
    a, b = [k for k in (0, 1, 2) if k != axis - 1]
    out = [[one if i == j else zero for j in range(3)] for i in range(3)]
    out[a][a] = out[b][b] = c
    out[a][b], out[b][a] = (s, -s) if axis == 2 else (-s, s)
    return out


def lattice_rotations(lon: Column, lat: Column) -> tuple[list[list[Column]], list[list[Column]]]:
    """About the first axis by -lat, and about the second by lon."""
    return axis_rotation(-lat, 1), axis_rotation(lon, 2)


def enu_to_ecef(east: Column, north: Column, up: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred components of a local (east, north, up) vector: turned by -lat about the second axis, then by lon about the third."""
    a = F.cos(lat) * up - F.sin(lat) * north
    return F.cos(lon) * a - F.sin(lon) * east, F.sin(lon) * a + F.cos(lon) * east, F.sin(lat) * up + F.cos(lat) * north


def rotate_tensor(t: dict[str, Column], lat: Column, lon: Column) -> dict[str, Column]:
    """R T R' of a symmetric local (east, north, up) tensor: components t11 t12 t13 t22 t23 t33."""
    one, zero = F.lit(1.0), F.lit(0.0)
    axes = [enu_to_ecef(one, zero, zero, lat, lon), enu_to_ecef(zero, one, zero, lat, lon), enu_to_ecef(zero, zero, one, lat, lon)]
    full = lambda p, q: t[f"t{min(p, q)}{max(p, q)}"]
    return {f"t{i}{j}": sum((axes[p - 1][i - 1] * full(p, q) * axes[q - 1][j - 1] for p in (1, 2, 3) for q in (1, 2, 3)), zero) for i, j in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3))}


def gnomonic(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Plane coordinates (km) of a point in the gnomonic projection about (lat0, lon0)."""
    c = F.sin(lat0) * F.sin(lat) + F.cos(lat0) * F.cos(lat) * F.cos(lon - lon0)
    return EARTH_RADIUS * F.cos(lat) * F.sin(lon - lon0) / c, EARTH_RADIUS * (F.cos(lat0) * F.sin(lat) - F.sin(lat0) * F.cos(lat) * F.cos(lon - lon0)) / c


def direction(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Unit vector of an azimuth and an elevation."""
    return F.cos(elevation) * F.cos(azimuth), F.cos(elevation) * F.sin(azimuth), F.sin(elevation)
