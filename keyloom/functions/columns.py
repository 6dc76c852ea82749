"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(now_ms: int, expire_at: str = "expire_at_ms") -> Column:
    """Not expired: the time to live is 0 (none) or still ahead."""
    return (F.col(expire_at) == 0) | (F.col(expire_at) > now_ms)


def byte_range(value: Column, start: int, stop: int) -> Column:
    """Bytes start to stop, both included; negative places count from the end; out of range is clamped. A cut may split
    a character, so the result is binary."""
    b = F.encode(value, "UTF-8")
    n = F.octet_length(b)
    lo = F.greatest(F.lit(start) + (n if start < 0 else 0), F.lit(0))
    hi = F.least(F.lit(stop) + (n if stop < 0 else 0), n - 1)
    return F.when((lo > hi) | (n == 0), F.lit(b"")).otherwise(F.substring(b, lo + 1, hi - lo + 1))


def last_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row a key: the last by a column ord, where there is one, else the greatest value."""
    last = F.max_by(value, "ord") if "ord" in rows.columns else F.max(value)
    return rows.groupBy(*by).agg(last.alias(value))


def glob(key: Column, pattern: str) -> Column:
    """* any run, ? one character, [ab] one of a class, [^a] or [!a] none of it, backslash quotes. Patterns of over 1024
    bytes match nothing."""
    if len(pattern.encode()) > 1024:
        return F.lit(False)
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            none = body[:1] in ("^", "!")
            quoted = "".join("\\" + x if x in "\\[&^" else x for x in body[none:])
            out += ("[^" if none else "[") + quoted + "]" if quoted else "." if none else "(?!)"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\Q" + pattern[i] + "\\E"
        else:
            out += "\\Q" + c + "\\E"
        i += 1
    return key.rlike("(?s)^" + out + "\\z")


def slot(key: Column, slots: int = 1024) -> Column:
    """Shard of a key; what stands in the first {braces} decides, where there is something in them."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.conv(F.substring(F.md5(F.when(tag != "", tag).otherwise(key)), 1, 8), 16, 10).cast("long") % slots


def index_range(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """First and last place of a range with both ends included; negative places count from the end, and those before
    the first place are the first."""
    place = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.lit(i)
    return place(start), F.least(place(stop), n - 1)


#: Limits of the grid that a 52-bit geohash covers, and the radius of the sphere in metres.
GEO_LNG, GEO_LAT, EARTH = (-180.0, 180.0), (-90.0, 90.0), 6371000.0


def _spread(x: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(25)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", x, i).bitwiseAND(F.lit(1).cast("long")), i * 2)))


def geo_score(lng: Column, lat: Column) -> Column:
    """Interleaved 26-bit cells of longitude (odd bits) and latitude (even bits)."""
    cell = lambda v, lim: F.round((v - lim[0]) / (lim[1] - lim[0]) * ((1 << 26) - 1)).cast("long")
    return _spread(cell(lat, GEO_LAT)) + _spread(cell(lng, GEO_LNG)) * 2


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres between two places on the sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((b - a) / 2), F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))


def geo_place(score: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a score's cell."""
    def axis(shift: int, lim: tuple[float, float]) -> Column:
        bit = lambda i: F.call_function("shiftright", score, i * 2 + shift).bitwiseAND(F.lit(1).cast("long"))
        cell = F.aggregate(F.sequence(F.lit(0), F.lit(25)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", bit(i), i)))
        return F.lit(lim[0]) + (cell + 0.5) / float(1 << 26) * (lim[1] - lim[0])

    return axis(1, GEO_LNG), axis(0, GEO_LAT)


#: Fixed value: the digits of a geohash.
GEO_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def geo_hash(score: Column) -> Column:
    """The 52 bits of a score and three zero bits as eleven digits."""
    wide = F.shiftleft(score, 3)
    return F.concat(*(F.substring(F.lit(GEO_DIGITS), F.shiftright(wide, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10, -1, -1)))
