"""Scalar helpers: time, rounding, keys, text, geometry. All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time zone and city of a country code.
ZONES = {"PH": "Asia/Manila", "SG": "Asia/Singapore", "TH": "Asia/Bangkok"}
CITIES = {"PH": "Metro Manila", "SG": "Singapore", "TH": "Bangkok"}


def nan_to_null(c: Column) -> Column:
    """Missing values are nulls everywhere; NaN is turned into null at every source and sink."""
    return F.when(~F.isnan(c), c)


def normalized_header(c: Column) -> Column:
    """Lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def utc_timestamp(text: Column, fmt: str | None = None) -> Column:
    """Timestamp of a text, null where it can't be parsed."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def local_time(ts: Column, zone: Column | str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_hour(ts: Column, zone: Column | str) -> Column:
    return F.hour(local_time(ts, zone))


def local_weekday(ts: Column, zone: Column | str) -> Column:
    """0 is Sunday."""
    return F.dayofweek(local_time(ts, zone)) - 1


def by_country(country: Column, values: dict[str, str], otherwise: Column | None = None) -> Column:
    """A value for each listed country, else ``otherwise`` or null."""
    out = F.lit(None).cast("string")
    for code, value in values.items():
        out = F.when(country == code, F.lit(value)).otherwise(out)
    return out if otherwise is None else F.coalesce(out, otherwise)


def round2(c: Column) -> Column:
    """Two decimals, half to even on the scaled value."""
    return F.rint(c * 100) / 100


def grid_key(prefix: str, lat: Column, lon: Column) -> Column:
    return F.format_string(f"{prefix}:%.4f_%.4f", lat, lon)


def ewkt_point(lon: Column, lat: Column) -> Column:
    """Extended WKT of a point; null if a coordinate is missing."""
    real = nan_to_null(lon).isNotNull() & nan_to_null(lat).isNotNull()
    return F.when(real, F.format_string("SRID=4326;POINT(%s %s)", lon, lat))


def day_path(d: Column) -> Column:
    """year/day-of-year with three digits."""
    return F.format_string("%d/%03d", F.year(d), F.dayofyear(d))


def scan_start_end(granule: Column, fallback: Column) -> Column:
    """(start, end) from the 15-character time stamps in a granule's name, else half an hour around ``fallback``."""
    tokens = F.filter(F.split(granule, "_"), lambda p: (F.length(p) == 15) & p.contains("T"))
    at = lambda i: F.try_to_timestamp(F.get(tokens, i), F.lit("yyyyMMdd'T'HHmmss"))
    half = F.expr("INTERVAL 30 MINUTES")
    return F.struct(F.coalesce(at(0), fallback - half).alias("start"), F.coalesce(at(1), fallback + half).alias("end"))


def first_text(json: Column, *paths: str) -> Column:
    """First non-empty text at the JSON paths; an object at a path doesn't count."""
    found = (F.get_json_object(json, p) for p in paths)
    return F.coalesce(*(F.when((x != "") & ~x.startswith("{"), x) for x in found))


def measured_at(json: Column) -> Column:
    """UTC instant of a measurement: end of its period first, then the older spellings."""
    return first_text(json, "$.period.datetimeTo.utc", "$.period.datetimeFrom.utc", "$.datetime.utc", "$.datetime", "$.date.utc", "$.date", "$.datetimeUtc")


def parameter_name(json: Column) -> Column:
    """Lower-case parameter, given as an object with a name or as a text."""
    return F.lower(F.coalesce(first_text(json, "$.parameter.name", "$.parameter"), F.lit("")))


def ndvi(red: Column, near_infrared: Column) -> Column:
    """(nir - red) / (nir + red), null where the sum is 0."""
    return F.when(near_infrared + red != 0, (near_infrared - red) / (near_infrared + red))


def history_start(first_seen: Column, fallback: Column) -> Column:
    """The later of ``fallback`` and the first instant seen; unparsable texts count as ``fallback``."""
    return F.greatest(fallback, F.coalesce(F.try_to_timestamp(first_seen), fallback))


def month_windows(first_month: Column, windows: int, months: int) -> Column:
    """Array of (start, end) windows of ``months`` months each, ending at ``first_month`` and going back."""
    step = lambda i: F.struct(F.add_months(first_month, -(i + 1) * months).alias("start"), F.add_months(first_month, -i * months).alias("end"))
    return F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), step)


def composite_due(d: Column) -> Column:
    """First of January, May and September."""
    return F.month(d).isin(1, 5, 9) & (F.dayofmonth(d) == 1)


def stem_without(stem: Column, suffix: str) -> Column:
    return F.when(stem.endswith(suffix), F.left(stem, F.length(stem) - len(suffix))).otherwise(stem)


def padded_box(box: str, pad: float) -> tuple[float, float, float, float]:
    """west, south, east, north of a comma-separated box, moved out by ``pad`` degrees."""
    west, south, east, north = map(float, box.split(","))
    return west - pad, south - pad, east + pad, north + pad


#: WGS84 ellipsoid and the transverse Mercator scale.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm(lat: Column, lon: Column, zone: int = 51) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) by Krueger's series to the sixth order of flattening's n; sub-millimetre."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = math.sqrt(_F * (2 - _F))
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + _K0 * radius * x, _K0 * radius * y


def from_utm(x: Column, y: Column, zone: int = 51) -> tuple[Column, Column]:
    """Latitude and longitude of easting and northing (northern hemisphere), by the series that inverts ``utm``'s."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    xi, eta = y / (_K0 * radius), (x - 500_000) / (_K0 * radius)
    p, q = xi, eta
    for j, b in enumerate(beta, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (6 * zone - 183)


def sinusoidal(lat: Column, lon: Column, radius: float = 6371007.181) -> tuple[Column, Column]:
    """The sinusoidal projection of satellite tiles."""
    return radius * F.radians(lon) * F.cos(F.radians(lat)), radius * F.radians(lat)


def from_sinusoidal(x: Column, y: Column, radius: float = 6371007.181) -> tuple[Column, Column]:
    """Latitude and longitude of a projected point."""
    return F.degrees(y / radius), F.degrees(x / (radius * F.cos(y / radius)))


def text_or_unknown(c: Column) -> Column:
    """A value as text, ``unknown`` where it is null."""
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def field_or_default(json: Column, key: str, default: Column) -> Column:
    """A field of a JSON object as text; the default where the key is absent, null where its value is null."""
    return F.when(F.array_contains(F.json_object_keys(json), key), F.get_json_object(json, f"$.{key}")).otherwise(default.cast("string"))
