"""Dates, periods and identifiers of scenes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(stamp: Column) -> Column:
    """The date of an ISO string: its first ten characters."""
    return F.try_to_date(F.substring(stamp, 1, 10))


def local_day(stamp: Column, zone: str = "UTC") -> Column:
    """The date of an instant (a timestamp, or an ISO string) on the clock of ``zone``, whatever the session's."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.to_timestamp(stamp), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))))


def instant(stamp: Column, end: bool = False) -> Column:
    """A bare date becomes the first or last second of its day; open ends stay open."""
    bare = stamp.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(bare, F.concat(stamp, F.lit("T23:59:59Z" if end else "T00:00:00Z"))).otherwise(stamp)


def interval(range_: Column) -> Column:
    """``a/b`` with both ends as instants; anything without a slash is left."""
    start, stop = F.substring_index(range_, "/", 1), F.substring_index(range_, "/", -1)
    return F.when(F.instr(range_, "/") > 0, F.concat(instant(start), F.lit("/"), instant(stop, True))).otherwise(range_)


def stride(start: Column, stop: Column, days: int) -> Column:
    """The first days of one-day windows every ``days`` days, both ends included."""
    if days <= 0:
        raise ValueError("days must be positive")
    checked = F.when(start <= stop, start).otherwise(F.raise_error(F.lit("range is reversed")))
    return F.sequence(checked.cast("date"), stop, F.expr(f"interval {days} day"))


def range_name(ranges: list[tuple[str, str]], days: int | None = None) -> str:
    name = ",".join(f"{a}..{b}" for a, b in ranges)
    return f"{name}:sample-every-{days}-days" if days else name


def period_label(start: Column, stop: Column) -> Column:
    """``YYYY-MM`` of a range within a month, else ``a..b``."""
    month = F.substring(start, 1, 7)
    return F.when(month == F.substring(stop, 1, 7), month).otherwise(F.concat(start, F.lit(".."), stop))


def period(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM")


def month_end(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year, month, F.lit(1)))


def shift_month(month: Column, by: int) -> Column:
    return F.pmod(month - 1 + by, F.lit(12)) + 1


def granule_day(name: Column) -> Column:
    """The date of a ``.AYYYYDDD.`` token."""
    token = F.regexp_extract(name, r"\.A(\d{7})\.", 1)
    year, of_year = F.substring(token, 1, 4).try_cast("int"), F.substring(token, 5, 3).try_cast("int")
    return F.when(token != "", F.date_add(F.make_date(year, F.lit(1), F.lit(1)), of_year - 1))


def tile_of_id(item: Column) -> Column:
    """The tile in an item id: ``S2x_TTTTT_...``, ``HLS.x.TTTTTT.``, or MODIS ``hXXvYY``; else empty."""
    s2 = F.regexp_extract(item, r"^S2[^_]*_([0-9]{1,2}[A-Z]{3})_", 1)
    hls = F.regexp_extract(item, r"^HLS\.[^.]+\.T?([0-9]{2}[A-Z]{3})\.", 1)
    modis = F.regexp_extract(item, r"\.(h[0-9]{2}v[0-9]{2})\.", 1)
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (s2, hls, modis)), F.lit(""))


def tile(properties: Column, item: Column) -> Column:
    """The tile of a scene: explicit properties first, a grid code next, the id last."""
    grid = F.nullif(F.regexp_extract(F.coalesce(properties["grid:code"], F.lit("")), r"^MGRS-(.+)$", 1), F.lit(""))
    return F.coalesce(properties["s2:mgrs_tile"], properties["mgrs:tile"], grid, tile_of_id(item))


def tile_and_day(item: Column) -> Column:
    """(tile, day) of either scene id dialect."""
    stac = F.regexp_extract(item, r"^S2[A-Z]_([0-9]{2}[A-Z]{3})_(\d{8})_", 1)
    index = F.regexp_extract(item, r"_T([0-9]{2}[A-Z]{3})$", 1)
    found = F.coalesce(F.nullif(stac, F.lit("")), F.nullif(index, F.lit("")))
    date = F.try_to_date(F.regexp_extract(item, r"(?:^|_)(\d{8})(?:T|_)", 1), "yyyyMMdd")
    return F.struct(found.alias("tile"), date.alias("day"))


def epsg_of_tile(code: Column, north: bool = False) -> Column:
    """The UTM code of a tile: zone 1 to 60, bands from N on lie north; else null."""
    zone = F.regexp_extract(code, r"^T?(\d{1,2})[A-Z]{3}$", 1).try_cast("int")
    band = F.regexp_extract(code, r"^T?\d{1,2}([A-Z])", 1)
    base = F.lit(32600) if north else F.when(band >= "N", 32600).otherwise(32700)
    return F.when(zone.between(1, 60), base + zone)


def utm_epsg(lon: Column, lat: Column, north: bool = False) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")
    return zone + (F.lit(32600) if north else F.when(lat >= 0, 32600).otherwise(32700))
