"""Transverse Mercator (UTM on WGS84) as column expressions.

Krüger's series in the third flattening, to the fourth order, forward and back:
about a micrometre inside a zone.  All functions are built-in ones, so the
projection stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

A_AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
N = FLATTENING / (2 - FLATTENING)
RADIUS = A_AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
C = 2 * math.sqrt(N) / (1 + N)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def _meridian(epsg: Column) -> Column:
    return F.radians(F.pmod(epsg, F.lit(100)) * 6.0 - 183.0)


def forward(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """(east, north) in metres of EPSG 326zz or 327zz."""
    phi, turn = F.radians(lat), F.radians(lon) - _meridian(epsg)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - C * F.atanh(C * s))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + SCALE * RADIUS * east, SCALE * RADIUS * north + F.when(epsg >= 32700, F.lit(1e7)).otherwise(F.lit(0.0))


def inverse(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi = (y - F.when(epsg >= 32700, F.lit(1e7)).otherwise(F.lit(0.0))) / (SCALE * RADIUS)
    eta = (x - 500000.0) / (SCALE * RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(_meridian(epsg) + F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)
