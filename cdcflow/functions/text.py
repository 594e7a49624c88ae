"""Text, time and hash functions."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone of a source that names none, longest topic name, longest stored message in bytes.
DEFAULT_ZONE = "Asia/Shanghai"
TOPIC_CHARS = 249
MESSAGE_BYTES = 1800


def instant_text(ms: Column) -> Column:
    """ISO-8601 instant of epoch milliseconds in UTC, without a fraction that is zero. The session zone must be UTC."""
    whole = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(ms, F.lit(1000))
    return F.when(part == 0, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), F.lpad(part.cast("string"), 3, "0"), F.lit("Z")))


def default_target_name(database: Column, tbl: Column) -> Column:
    """database_table with characters that a topic may not have replaced by _, at most 249 long."""
    return F.substring(F.regexp_replace(F.concat_ws("_", database, tbl), "[^A-Za-z0-9._-]", "_"), 1, TOPIC_CHARS)


def comma_list(text: Column) -> Column:
    """The trimmed, non-blank items of a comma-separated list, in order, repeats kept."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def table_of(qualified: Column) -> Column:
    """The table of db.table, or the whole name."""
    return F.substring_index(qualified, ".", -1)


def database_of(qualified: Column) -> Column:
    """The database of db.table; null without one."""
    return F.when(F.instr(qualified, ".") > 0, F.substring_index(qualified, ".", 1))


def within_bytes(text: Column, most: int = MESSAGE_BYTES) -> Column:
    """The longest start of text whose UTF-8 form has at most `most` bytes."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most + 1)
    size = F.octet_length(raw)
    # an UTF-8 character begins at every byte that isn't 10xxxxxx: step back over those where the cut would fall
    def begins(i: int) -> Column:
        code = F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
        return (code < 128) | (code >= 192)

    cut = F.when(begins(most + 1), most).when(begins(most), most - 1).when(begins(most - 1), most - 2).otherwise(most - 3)
    return F.when(size <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def byte_size_text(n: Column) -> Column:
    """Bytes as a short text with the largest unit that gives at least 1."""
    k, m, g = 1024, 1024**2, 1024**3
    return (
        F.when(n >= g, F.format_string("%.1f GB", n / g)).when(n >= m, F.format_string("%.1f MB", n / m)).when(n >= k, F.format_string("%.1f KB", n / k)).otherwise(F.format_string("%d B", n.cast("long")))
    )


def redacted(text: Column) -> Column:
    """Passwords in key=value or key: value form replaced by ******."""
    return F.regexp_replace(text, r"(?i)(password|pwd)(\s*[=:]\s*)[^&,;\s}]+", "$1$2******")


def base64_length(n: Column) -> Column:
    return F.ceil(n / 3) * 4


def zone_shift_hours(ms: Column, zone: str) -> Column:
    """Hours that a zone's wall clock is ahead of UTC at an instant."""
    at = F.timestamp_millis(ms)
    return (F.unix_millis(F.from_utc_timestamp(at, zone)) - ms) / 3_600_000


def local_to_epoch_ms(text: Column, zone: str) -> Column:
    """Epoch milliseconds of a wall-clock text in a zone."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(text), zone))


def number_from(text: Column) -> Column:
    """Whole number from a number or its text, such as 50, 50.9 or 1e1, without its fraction; null if it can't be read."""
    whole = F.trim(text.cast("string")).try_cast("decimal(38,9)")
    return whole.try_cast("long")


#: Abbreviations that name several zones, or none by themselves.
ABBREVIATIONS = ("EST", "MST", "HST", "ACT", "AET", "AGT", "ART", "AST", "BET", "BST", "CAT", "CNT", "CST", "CTT", "EAT", "ECT", "IET", "IST", "JST", "MIT", "NET", "NST", "PLT", "PNT", "PRT", "PST", "SST", "VST")


def zone_id(name: str | None) -> str | None:
    """The canonical IANA id of a zone, whatever its case; blank stays blank (the default zone) and None stays None. Abbreviations, bare offsets and unknown names are refused."""
    if name is None or not name.strip():
        return name if name is None else ""
    given = name.strip()
    found = next((z for z in available_timezones() if z.upper() == given.upper()), None)
    if found is None or given.upper() in ABBREVIATIONS:
        raise ValueError(f"{given!r} is no IANA zone id, such as Asia/Shanghai or UTC")
    return found


def effective_zone(name: str | None) -> str:
    """The zone that a source counts as having."""
    return zone_id(name) or DEFAULT_ZONE


def offset_text(seconds: Column) -> Column:
    """UTC+08:00, UTC-05:30, UTC+00:00: an offset from UTC; its seconds only where there are any."""
    size = F.abs(seconds).cast("long")
    text = F.format_string("%02d:%02d", F.floor(size / 3600), F.floor(F.pmod(size, F.lit(3600)) / 60))
    rest = F.pmod(size, F.lit(60))
    return F.concat(F.lit("UTC"), F.when(seconds < 0, "-").otherwise("+"), text, F.when(rest != 0, F.format_string(":%02d", rest)).otherwise(""))


def shift_hours_text(seconds: Column) -> Column:
    """Hours of a shift with at most two decimals, and no trailing zeros: 8, -5.5, 5.75."""
    text = F.round(seconds.cast("decimal(20,0)") / 3600, 2).cast("decimal(20,2)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")
