"""Scalar column helpers. All stay inside Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from fraudloom.schemas import SCORE

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def upper_code(col: Column | str) -> Column:
    return F.upper(F.trim(_c(col)))


def lower_code(col: Column | str) -> Column:
    return F.lower(F.trim(_c(col)))


def is_alpha_code(col: Column | str, length: int) -> Column:
    """True for exactly `length` letters A-Z (non-ASCII letters are not codes here)."""
    return _c(col).rlike(f"^[A-Z]{{{length}}}$")


def lenient_decimal(col: Column | str, precision: int = 28, scale: int = 8) -> Column:
    """A decimal, or NULL where the text is no number."""
    return _c(col).try_cast(f"decimal({precision},{scale})")


def quantize4(col: Column | str) -> Column:
    """Four fractional digits, half up."""
    return F.round(_c(col), 4).cast(SCORE)


def clamp01(col: Column | str) -> Column:
    return F.greatest(F.lit(0).cast(SCORE), F.least(F.lit(1).cast(SCORE), _c(col)))


def min_max(raw: Column | str, low: float, high: float) -> Column:
    """Position of `raw` between the bounds, clamped, 4 digits; 0.5 for degenerate bounds."""
    if high > low:
        position = (_c(raw) - F.lit(float(low))) / F.lit(float(high) - float(low))
        position = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))
    else:
        position = F.when(_c(raw).isNotNull(), F.lit(0.5))
    return F.round(position, 4).cast(SCORE)


def fixed_text(col: Column | str, digits: int) -> Column:
    """A decimal printed with `digits` fractional digits, ties to even."""
    return F.bround(_c(col), digits).cast(f"decimal(38,{digits})").cast("string")


def join_reasons(reasons: Sequence[Column], separator: str = ", ") -> Column:
    """Joined text of the reasons that are not NULL."""
    return F.concat_ws(separator, *reasons)


def parse_time(col: Column | str) -> Column:
    """ISO text to a timestamp; text without an offset is UTC."""
    return F.try_to_timestamp(_c(col))


def iso_time(col: Column | str) -> Column:
    return F.date_format(_c(col), TIME_FORMAT)


def hour_of_day(col: Column | str) -> Column:
    return F.hour(_c(col))


def bucket_start(col: Column | str, width: str = "5 minutes") -> Column:
    """Start of the epoch-aligned bucket."""
    return F.window(_c(col), width)["start"]


def micros(col: Column | str) -> Column:
    return F.unix_micros(_c(col).cast("timestamp"))


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(part) for item in values.items() for part in item])


def map_get(values: Column, key: Column | str, default: float) -> Column:
    return F.coalesce(F.try_element_at(values, _c(key)), F.lit(default))


def json_text(col: Column | str, *paths: str) -> Column:
    """First payload field that is present and not empty."""
    found = [F.get_json_object(_c(col), f"$.{path}") for path in paths]
    return F.coalesce(*[F.nullif(value, F.lit("")) for value in found])


def event_family(col: Column | str) -> Column:
    return F.split(_c(col), r"\.")[0]


# Currency by country; every other country uses USD (fixed values).
CURRENCY_COUNTRIES = {
    "USD": ("US",),
    "EUR": ("DE", "FR", "NL"),
    "GBP": ("GB",),
    "CAD": ("CA",),
    "JPY": ("JP",),
    "AUD": ("AU",),
}


def currency_for_country(col: Column | str) -> Column:
    currency = F.lit("USD")
    for code, countries in CURRENCY_COUNTRIES.items():
        currency = F.when(_c(col).isin(*countries), code).otherwise(currency)
    return currency


def contains_text(query: str, *cols: Column | str) -> Column:
    """Case-insensitive substring search over several columns."""
    needle = F.lit(query.lower())
    hits = [F.coalesce(F.lower(_c(c).cast("string")).contains(needle), F.lit(False)) for c in cols]
    result = hits[0]
    for hit in hits[1:]:
        result = result | hit
    return result


def short_id(col: Column | str) -> Column:
    return F.concat(F.substring(_c(col).cast("string"), 1, 8), F.lit("..."))


def label(col: Column | str) -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit("unknown"))


def derived_id(*cols: Column | str) -> Column:
    """Stable identifier from column values, the same on every rerun."""
    return F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in cols]), 256)
