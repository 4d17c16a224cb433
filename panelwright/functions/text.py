"""Text expressions. White space is Unicode's, as the inputs are names in any language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = "[\\x00-\\x1f\\x7f]"
CITY_LENGTH = 100
LOG_LENGTH = 200


#: The characters that Unicode calls white space.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def has_control(x: Column) -> Column:
    return x.rlike(CONTROL)


def stripped(x: Column) -> Column:
    return F.trim(x, F.lit(SPACES))


def not_blank(x: Column) -> Column:
    return F.coalesce(x.rlike("(?U)\\S"), F.lit(False))


def valid_city(x: Column) -> Column:
    """The stripped city, cut to CITY_LENGTH; null if it is null, blank or has a control character anywhere."""
    city = stripped(x)
    return F.when(x.isNull() | has_control(x) | (city == ""), None).otherwise(F.left(city, F.lit(CITY_LENGTH)))


def city_error(x: Column) -> Column:
    return (
        F.when(x.isNull(), "not a string")
        .when(has_control(x), "control characters")
        .when(stripped(x) == "", "empty")
    )


def clean_city(x: Column) -> Column:
    """Control characters become spaces, white space runs one space; trimmed, then cut."""
    spaced = F.regexp_replace(F.regexp_replace(x, CONTROL, " "), "(?U)\\s+", " ")
    return F.left(F.trim(spaced), F.lit(CITY_LENGTH))


def log_safe(x: Column, length: int = LOG_LENGTH) -> Column:
    """Control characters go; what is longer than ``length`` is cut and gets three dots."""
    kept = F.regexp_replace(x, CONTROL, "")
    return F.when(F.length(kept) > length, F.concat(F.left(kept, F.lit(length)), F.lit("..."))).otherwise(kept)


def default_if_empty(x: Column, default: str) -> Column:
    """Null and the empty string give the default; blanks stay."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("\\A[0-9a-fA-F]{64}\\z"), F.lit(False))
