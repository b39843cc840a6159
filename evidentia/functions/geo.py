"""Spherical geodesy, locators and radio closed forms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
LIGHT = 299_792_458.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(_col(lat1)), F.radians(_col(lat2))
    half = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin((F.radians(_col(lon2)) - F.radians(_col(lon1))) / 2) ** 2
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360 degrees."""
    a, b, d = F.radians(_col(lat1)), F.radians(_col(lat2)), F.radians(_col(lon2)) - F.radians(_col(lon1))
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def destination(lat, lon, bearing, metres) -> tuple[Column, Column]:
    """Latitude and longitude reached along a great circle."""
    a, o, t, d = F.radians(_col(lat)), F.radians(_col(lon)), F.radians(_col(bearing)), _col(metres) / EARTH_M
    end = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    turn = o + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(end))
    return F.degrees(end), wrap180(F.degrees(turn))


def wrap180(deg) -> Column:
    x = _col(deg) + 180
    return x - 360 * F.floor(x / 360) - 180


def enu_m(lat0, lon0, lat, lon) -> tuple[Column, Column]:
    """East and north metres in the plane that touches the first place."""
    return F.radians(wrap180(_col(lon) - _col(lon0))) * F.cos(F.radians(_col(lat0))) * EARTH_M, F.radians(_col(lat) - _col(lat0)) * EARTH_M


def from_enu(lat0, lon0, east, north) -> tuple[Column, Column]:
    return _col(lat0) + F.degrees(_col(north) / EARTH_M), wrap180(_col(lon0) + F.degrees(_col(east) / (F.cos(F.radians(_col(lat0))) * EARTH_M)))


def great_circle_points(lat1, lon1, lat2, lon2, steps: int) -> Column:
    """An array of {lat, lon} from the first place to the second."""
    d = haversine_m(lat1, lon1, lat2, lon2)
    t = bearing_deg(lat1, lon1, lat2, lon2)

    def at(i: Column) -> Column:
        lat, lon = destination(lat1, lon1, t, d * i / steps)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


# Locators: pairs of letters and digits that halve the world in turn, longitude before latitude.


def locator(lat, lon, pairs: int = 3) -> Column:
    x, y = F.least(_col(lon) + 180, F.lit(360 - 1e-9)), F.least(_col(lat) + 90, F.lit(180 - 1e-9))
    width, height, out = 20.0, 10.0, []
    for i in range(pairs):
        a, b = F.floor(x / width), F.floor(y / height)
        base = 48 if i % 2 else (65 if i == 0 else 97)
        out += [F.char(a + base), F.char(b + base)]
        x, y = x - a * width, y - b * height
        width, height = (width / 10, height / 10) if i % 2 == 0 else (width / 24, height / 24)
    return F.concat(*out)


def is_locator(grid: Column) -> Column:
    return grid.rlike("^[A-Ra-r]{2}([0-9]{2}([A-Xa-x]{2}([0-9]{2}([A-Xa-x]{2})?)?)?)?$")


def locator_centre(grid: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a locator's field; null if it is none."""
    g = F.upper(grid)
    lat, lon = F.lit(-90.0), F.lit(-180.0)
    width, height = 20.0, 10.0
    half_w, half_h = F.lit(0.0), F.lit(0.0)
    for i in range(5):
        have = F.length(g) >= 2 * i + 2
        base = 48 if i % 2 else 65
        lon = lon + F.when(have, (F.ascii(F.substring(g, 2 * i + 1, 1)) - base) * width).otherwise(0.0)
        lat = lat + F.when(have, (F.ascii(F.substring(g, 2 * i + 2, 1)) - base) * height).otherwise(0.0)
        half_w, half_h = F.when(have, F.lit(width / 2)).otherwise(half_w), F.when(have, F.lit(height / 2)).otherwise(half_h)
        width, height = (width / 10, height / 10) if i % 2 == 0 else (width / 24, height / 24)
    ok = is_locator(grid)
    return F.when(ok, lat + half_h), F.when(ok, lon + half_w)


def locator_uncertainty_km(grid: Column) -> Column:
    """Half the diagonal of the field at the equator."""
    width, height, out = 20.0, 10.0, F.lit(None).cast("double")
    for i in range(5):
        out = F.when(F.length(grid) >= 2 * i + 2, F.lit(math.hypot(width, height) / 2 * EARTH_M * math.pi / 180 / 1000)).otherwise(out)
        width, height = (width / 10, height / 10) if i % 2 == 0 else (width / 24, height / 24)
    return F.when(is_locator(grid), out)


# The amateur bands in MHz, both edges included.
BANDS = (
    ("2200m", 0.1357, 0.1378), ("630m", 0.472, 0.479), ("160m", 1.8, 2.0), ("80m", 3.5, 4.0), ("60m", 5.06, 5.45), ("40m", 7.0, 7.3), ("30m", 10.1, 10.15), ("20m", 14.0, 14.35),
    ("17m", 18.068, 18.168), ("15m", 21.0, 21.45), ("12m", 24.89, 24.99), ("10m", 28.0, 29.7), ("6m", 50.0, 54.0), ("4m", 70.0, 71.0), ("2m", 144.0, 148.0),
)


def band_of(mhz: Column) -> Column:
    """Name of the band, empty outside all bands."""
    out = F.lit("")
    for name, low, high in BANDS:
        out = F.when(mhz.between(low, high), name).otherwise(out)
    return out


# Radio


def wavelength_m(hz) -> Column:
    return F.lit(LIGHT) / _col(hz)


def fspl_db(metres, hz) -> Column:
    return 20 * F.log10(4 * math.pi * F.greatest(_col(metres), F.lit(1.0)) / wavelength_m(hz))


def radio_horizon_m(h_tx, h_rx, k: float = 4 / 3) -> Column:
    return F.sqrt(2 * k * EARTH_M * _col(h_tx)) + F.sqrt(2 * k * EARTH_M * _col(h_rx))


def earth_bulge_m(d1, d2, k: float = 4 / 3) -> Column:
    return _col(d1) * _col(d2) / (2 * k * EARTH_M)


def fresnel_radius_m(d1, d2, hz, zone: int = 1) -> Column:
    return F.sqrt(zone * wavelength_m(hz) * _col(d1) * _col(d2) / (_col(d1) + _col(d2)))


def dipole_gain_dbi(elevation) -> Column:
    """Half-wave dipole standing upright."""
    t = F.radians(90 - _col(elevation))
    field = F.when(F.abs(F.sin(t)) < 1e-6, 0.0).otherwise(F.cos(math.pi / 2 * F.cos(t)) / F.sin(t))
    return 2.15 + 20 * F.log10(F.greatest(F.abs(field), F.lit(1e-5)))


def directional_gain_dbi(azimuth, boresight, peak: float, beamwidth: float, back: float) -> Column:
    """Parabolic main lobe, 3 dB down at half the beam width, never under the back lobe."""
    off = F.abs(wrap180(_col(azimuth) - _col(boresight)))
    return F.greatest(peak - 12 * (off / beamwidth) ** 2, F.lit(float(back)))


def reflection(grazing, permittivity: float, conductivity: float, hz: float, vertical: bool) -> tuple[Column, Column]:
    """Real and imaginary part of the ground's reflection coefficient."""
    s, c2 = F.sin(F.radians(_col(grazing))), F.cos(F.radians(_col(grazing))) ** 2
    loss = -conductivity * LIGHT / hz * 60
    re, im = permittivity - c2, F.lit(loss)
    size = F.sqrt(F.sqrt(re * re + im * im))
    turn = F.atan2(im, re) / 2
    zr, zi = size * F.cos(turn), size * F.sin(turn)
    ar, ai = (permittivity * s, loss * s) if vertical else (s, F.lit(0.0))
    nr, ni, dr, di = ar - zr, ai - zi, ar + zr, ai + zi
    scale = dr * dr + di * di
    return (nr * dr + ni * di) / scale, (ni * dr - nr * di) / scale


def in_region(grid: Column, region: dict | None) -> Column:
    """Whether a locator lies in a region: ``{"grids": [...]}`` by beginnings, ``{"lat", "lon", "km"}`` by distance; None is everywhere."""
    if region is None:
        return F.lit(True)
    if "grids" in region:
        out = F.lit(False)
        for beginning in region["grids"]:
            out = out | F.upper(grid).startswith(beginning.upper())
        return F.coalesce(out, F.lit(False))
    lat, lon = locator_centre(grid)
    return F.coalesce(haversine_m(lat, lon, float(region["lat"]), float(region["lon"])) <= 1000.0 * region["km"], F.lit(False))


def two_ray_db(metres, hz: float, h_tx, h_rx, permittivity: float = 15.0, conductivity: float = 0.005, vertical: bool = True) -> Column:
    """Loss over flat ground of the direct and the reflected ray together; nearer than a metre counts as a metre."""
    d, up, down = F.greatest(_col(metres).cast("double"), F.lit(1.0)), _col(h_tx), _col(h_rx)
    direct, bounced = F.sqrt(d * d + (up - down) ** 2), F.sqrt(d * d + (up + down) ** 2)
    re, im = reflection(F.degrees(F.atan2(up + down, d)), permittivity, conductivity, hz, vertical)
    turn = 2 * math.pi * hz / LIGHT * (bounced - direct)
    x = 1 / direct + (re * F.cos(turn) + im * F.sin(turn)) / bounced
    y = (im * F.cos(turn) - re * F.sin(turn)) / bounced
    return -20 * F.log10(LIGHT / hz / (4 * math.pi) * F.sqrt(x * x + y * y))


def table_gain_dbi(angle, angles: list[float], gains: list[float]) -> Column:
    """Gain by linear interpolation in a table over the circle; angles grow from 0 and stay under 360."""
    a = F.pmod(_col(angle), F.lit(360.0))
    out = F.lit(None).cast("double")
    ring = [*zip(angles, gains, strict=True), (angles[0] + 360.0, gains[0])]
    for (a0, g0), (a1, g1) in zip(ring, ring[1:], strict=False):
        at = F.when(a < angles[0], a + 360).otherwise(a)
        out = F.when((at >= a0) & (at < a1), g0 + (g1 - g0) * (at - a0) / (a1 - a0)).otherwise(out)
    return out


def ideal_split_loss_db(ways) -> Column:
    return 10 * F.log10(_col(ways).cast("double"))


def expected_input_dbm(power_dbm, attenuation_db, split_db, cable_db=0.0) -> Column:
    """What a receiver gets through an attenuator, a splitter and a cable."""
    return _col(power_dbm) - _col(attenuation_db) - _col(split_db) - _col(cable_db)
