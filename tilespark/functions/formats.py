"""Tile formats, payload signatures, timestamps and request dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to media type.
MIME_TYPES = {
    "png": "image/png",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "atm": "image/lerc",
    "mvt": "application/vnd.mapbox-vector-tile",
    "pbf": "application/x-protobuf",
    "omv": "application/x-protobuf",
    "json": "application/json",
    "geojson": "application/json",
    "terrain": "application/vnd.quantized-mesh,application/octet-stream;q=1.0",
}
# Media types whose extension is not their subtype.
NAMED_EXTENSIONS = {
    "vnd.mapbox-vector-tile": "mvt",
    "application/x-protobuf": "pbf",
    "application/json": "geojson",
    "application/vnd.quantized-mesh": "terrain",
}


def mime_type(fmt: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in MIME_TYPES.items() for v in pair])
    return F.when(fmt.contains("/"), fmt).otherwise(F.coalesce(table[fmt], F.lit("")))


def extension(fmt: Column) -> Column:
    trimmed = F.trim(fmt)
    subtype = F.when(trimmed.contains("/"), F.split_part(trimmed, F.lit("/"), F.lit(2))).otherwise(trimmed)
    named = F
    for marker, ext in NAMED_EXTENSIONS.items():
        named = named.when(trimmed.contains(marker), ext)
    return named.otherwise(F.split_part(subtype, F.lit(";"), F.lit(1)))


def sniff(payload: Column) -> Column:
    """Format named by the leading bytes, null when unknown."""
    head = F.hex(F.substring(payload, 1, 16))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("4D4D002A") | head.startswith("49492A00"), "tiff")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 14) == "57454250565038"), "webp")
    )


MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})"
# date order differs: the day-first forms, then the month-first one
_DAY_FIRST = r"^[A-Za-z]+, +(\d{1,2})[ -]([A-Z][a-z]{2})[ -](\d{2}|\d{4}) " + _CLOCK + r" (GMT|UTC)$"
_MONTH_FIRST = r"^[A-Za-z]+ ([A-Z][a-z]{2}) +(\d{1,2}) " + _CLOCK + r" (\d{4})$"


def parse_iso(text: Column) -> Column:
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def _clock(text: Column, pattern: str, year: int, month: int, day: int, hour: int) -> Column:
    def get(i):
        return F.regexp_extract(text, pattern, i)

    raw = get(year).try_cast("int")
    full = F.when(F.length(get(year)) == 2, F.when(raw >= 69, raw + 1900).otherwise(raw + 2000)).otherwise(raw)
    at = F.instr(F.lit(MONTHS), get(month))
    return F.when(
        text.rlike(pattern) & (at % 3 == 1),
        F.concat_ws(
            " ",
            F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"),
                        F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"), F.lpad(get(day), 2, "0")),
            F.concat_ws(":", F.lpad(get(hour), 2, "0"), get(hour + 1), get(hour + 2)),
        ).try_cast("timestamp"),
    )


def parse_http_date(text: Column) -> Column:
    """The HTTP date forms in use, one- or two-digit days and two- or four-digit years."""
    return F.coalesce(
        _clock(text, _DAY_FIRST, 3, 2, 1, 4),
        _clock(text, _MONTH_FIRST, 6, 1, 2, 3),
    )


def parse_timestamp(text: Column) -> Column:
    return F.coalesce(parse_iso(text), parse_http_date(text))


def format_http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def epoch_seconds(ts: Column) -> Column:
    """Seconds with the milliseconds floored."""
    return F.floor(F.unix_micros(ts) / 1000) / 1000.0


def dimension_values(values: Column, default: Column) -> Column:
    return F.when(values.isNull() | (F.size(values) == 0), F.array(default)).otherwise(values)


def first_dimension_value(values: Column, default: Column) -> Column:
    return F.element_at(dimension_values(values, default), 1)


def dimensions_for_params(dimensions: Column, params: Column) -> Column:
    """First value of every dimension that the request names (any letter case)."""
    asked = F.transform(F.map_keys(params), F.lower)
    wanted = F.map_filter(dimensions, lambda k, _: F.array_contains(asked, k))
    return F.transform_values(wanted, lambda _, d: first_dimension_value(d["values"], d["default"]))
