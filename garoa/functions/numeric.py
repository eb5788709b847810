"""Scalar expressions over values, units, coordinates and dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garoa.params import BBox, Radius

SECONDS_PER_DAY = 86400.0
KELVIN_OFFSET = 273.15
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
MIN_COS_LAT = 0.01

# Unit spellings that mean a flux per second, and degrees Celsius.
FLUX_UNITS = ("kg m-2 s-1", "kg m^-2 s^-1", "mm s-1", "mm/s")
CELSIUS_UNITS = ("degc", "celsius", "°c", "c")

# Unit of every rainfall index.
INDEX_UNITS = {
    "wet_days": "dias",
    "sdii": "mm/day",
    "rx1day": "mm",
    "rx5day": "mm",
    "r20mm": "dias",
    "r50mm": "dias",
    "r95ptot_mm": "mm",
    "r95ptot_frac": "adimensional",
}

# Calendars whose dates need a check against the common calendar.
OTHER_CALENDARS = ("noleap", "365_day", "360_day", "all_leap", "366_day")


def column_type(df: DataFrame, name: str) -> str:
    """SQL type name of a column, so that literals can follow it."""
    return df.schema[name].dataType.simpleString()


def is_finite(x: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite; never NULL."""
    inf = F.lit(float("inf"))
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf)


def nan_to_null(x: Column) -> Column:
    """NaN becomes NULL; everything else is kept."""
    return F.when(~F.isnan(x), x)


def finite_or_null(x: Column) -> Column:
    """Anything that is not a finite number becomes NULL."""
    return F.when(is_finite(x), x)


def normalize_lon(lon: Column, kind: str = "double") -> Column:
    """Longitude in [-180, 180); ``kind`` keeps float32 grids in float32."""
    turn, half = F.lit(360.0).cast(kind), F.lit(180.0).cast(kind)
    return F.pmod(lon.cast(kind) + half, turn) - half


def is_flux(units: Column) -> Column:
    """Whether a unit text names a flux per second (any case); NULL counts as no."""
    low = F.lower(F.coalesce(units, F.lit("")))
    found = F.lit(False)
    for spelling in FLUX_UNITS:
        found = found | low.contains(spelling)
    return found


def per_day(valor: Column, kind: str = "double") -> Column:
    """Flux per second to amount per day."""
    return valor * F.lit(SECONDS_PER_DAY).cast(kind)


def to_mm_day(valor: Column, units: Column, kind: str = "double") -> Column:
    """Convert by the unit text alone."""
    return F.when(is_flux(units), per_day(valor, kind)).otherwise(valor)


def to_celsius(valor: Column, units: Column, kind: str = "double") -> Column:
    """Kelvin to Celsius unless the unit text already says Celsius."""
    already = F.lower(F.trim(F.coalesce(units, F.lit("")))).isin(*CELSIUS_UNITS)
    return F.when(already, valor).otherwise(valor - F.lit(KELVIN_OFFSET).cast(kind))


def index_unit(nome: Column) -> Column:
    """Unit of a rainfall index name; NULL for a name outside the closed set."""
    unit = None
    for name, text in INDEX_UNITS.items():
        unit = (F if unit is None else unit).when(nome == name, F.lit(text))
    return unit


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def radius_span(radius: Radius) -> tuple[float, float]:
    """Half height and half width, in degrees, of the box around a circle."""
    cos_lat = max(math.cos(math.radians(radius.lat)), MIN_COS_LAT)
    return radius.km / KM_PER_DEGREE, radius.km / (KM_PER_DEGREE * cos_lat)


def bbox_from_radius(lat: Column, lon: Column, km: Column) -> dict[str, Column]:
    """The four sides, not wrapped, of the box around a circle."""
    dlat = km / F.lit(KM_PER_DEGREE)
    dlon = km / (F.lit(KM_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(MIN_COS_LAT)))
    return {
        "lat_min": lat - dlat,
        "lat_max": lat + dlat,
        "lon_min": lon - dlon,
        "lon_max": lon + dlon,
    }


def in_bbox(lat: Column, lon: Column, bbox: BBox) -> Column:
    """Inside a closed box; a box with ``lon_min > lon_max`` is two strips."""
    if bbox.lon_min <= bbox.lon_max:
        lon_ok = (lon >= bbox.lon_min) & (lon <= bbox.lon_max)
    else:
        lon_ok = (lon >= bbox.lon_min) | (lon <= bbox.lon_max)
    return (lat >= bbox.lat_min) & (lat <= bbox.lat_max) & lon_ok


def in_radius(lat: Column, lon: Column, radius: Radius) -> Column:
    """Cheap box first (its latitude side reaches the scan), exact distance after."""
    dlat, dlon = radius_span(radius)
    near = (lat >= radius.lat - dlat) & (lat <= radius.lat + dlat)
    if dlon < 180.0:
        near = near & (F.abs(normalize_lon(lon - F.lit(radius.lon))) <= dlon)
    exact = haversine_km(F.lit(radius.lat), F.lit(radius.lon), lat, lon) <= radius.km
    return near & exact


def is_dry_hot(pr: Column, tas: Column, lim_pr: float, lim_tas: float) -> Column:
    """Dry and hot on the same day, both limits included."""
    return (pr <= F.lit(lim_pr)) & (tas >= F.lit(lim_tas))


def daily_deficit(evap: Column, pr: Column) -> Column:
    """Evaporation minus rain; negative on wet days."""
    return evap - pr


def valid_day(pr: Column, tas: Column, evap: Column) -> Column:
    """A day counts only when all three values are finite."""
    return is_finite(pr) & is_finite(tas) & is_finite(evap)


def calendar_timestamp(y: Column, m: Column, d: Column, h: Column | None = None) -> Column:
    """Date parts of any calendar as a timestamp; NULL where no such day exists."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, m, d, zero if h is None else h, zero, F.lit(0.0))


def iso_to_ts(text: Column) -> Column:
    """ISO-8601 text to a timestamp; without an offset it is UTC."""
    zoned = F.when(text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.to_timestamp(zoned)


def ts_to_iso(ts: Column) -> Column:
    """Timestamp to ISO-8601 text with a UTC offset (session time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
