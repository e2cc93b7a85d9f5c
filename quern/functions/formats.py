"""String format predicates and pattern conversion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ATOM = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_URI_CHAR = r"(?:[a-z0-9\-._~:/?@!$&'()*+,;=\[\]]|%[0-9a-f]{2})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CLOCK = r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d|23:59:60)(?:\.\d+)?(?:z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)"
_DAY = r"\d{4}-\d{2}-\d{2}"
_H16 = "[0-9a-f]{1,4}"

PATTERNS = {
    "email": rf"(?i)^{_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+{_LABEL}$",
    "uuid": r"(?i)^(?:urn:uuid:)?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$",
    "uri": rf"(?i)^[a-z][a-z0-9+.-]*:{_URI_CHAR}+(?:#{_URI_CHAR}*)?$",
    "time": rf"(?i)^{_CLOCK}$",
    "date-time": rf"(?i)^{_DAY}[t\s]{_CLOCK}$",
    "ipv4": rf"^(?:{_OCTET}\.){{3}}{_OCTET}$",
    "ipv6": (
        rf"(?i)^(?:(?:{_H16}:){{7}}{_H16}|(?:{_H16}:){{1,7}}:|(?:{_H16}:){{1,6}}:{_H16}"
        rf"|(?:{_H16}:){{1,5}}(?::{_H16}){{1,2}}|(?:{_H16}:){{1,4}}(?::{_H16}){{1,3}}"
        rf"|(?:{_H16}:){{1,3}}(?::{_H16}){{1,4}}|(?:{_H16}:){{1,2}}(?::{_H16}){{1,5}}"
        rf"|{_H16}:(?::{_H16}){{1,6}}|:(?:(?::{_H16}){{1,7}}|:)"
        rf"|(?:{_H16}:){{6}}(?:{_OCTET}\.){{3}}{_OCTET}|::(?:ffff:)?(?:{_OCTET}\.){{3}}{_OCTET})$"
    ),
    "iso-time": rf"(?i)^{_CLOCK}?$",
    "iso-date-time": rf"(?i)^{_DAY}[t\s](?:{_CLOCK}|(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d|23:59:60)(?:\.\d+)?)$",
    "duration": r"^P(?!$)(?:(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?|\d+W)$",
    "uri-reference": rf"(?i)^(?:[a-z][a-z0-9+.-]*:)?{_URI_CHAR}*(?:#{_URI_CHAR}*)?$",
    "url": rf"(?i)^(?:https?|ftp)://(?:[^\s/@]+@)?(?:{_LABEL}\.)+[a-z]{{2,}}(?::\d{{1,5}})?(?:[/?#]\S*)?$",
    "json-pointer": r"^(?:/(?:[^~/]|~0|~1)*)*$",
    "json-pointer-uri-fragment": r"(?i)^#(?:/(?:[a-z0-9_\-.!$&'()*+,;:=@]|%[0-9a-f]{2}|~0|~1)*)*$",
    "relative-json-pointer": r"^(?:0|[1-9]\d*)(?:#|(?:/(?:[^~/]|~0|~1)*)*)$",
    "byte": r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$",
    "hostname": rf"(?i)^(?=.{{1,253}}$)[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?)*$",
}


def java_pattern(pattern: str) -> str:
    """A schema pattern in the regex dialect of Spark.

    ``$`` means the very end of the text, not "before a last line break".
    """
    out: list[str] = []
    in_class = escaped = False
    for char in pattern:
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif char == "[":
            # A bare "[" inside a class is a literal; Java would nest.
            if in_class:
                out.append("\\")
            in_class = True
        elif char == "]":
            in_class = False
        elif char == "$" and not in_class:
            char = r"\z"
        out.append(char)
    return "".join(out)


def matches(text: Column, pattern: str) -> Column:
    """Unanchored search."""
    return F.rlike(text, F.lit(java_pattern(pattern)))


def _real_day(text: Column) -> Column:
    """Days of the month checked with the leap-year rule, any year 0000-9999."""
    year, month, day = (F.substring(text, at, n).try_cast("int") for at, n in ((1, 4), (6, 2), (9, 2)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = (
        F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    )
    return month.between(1, 12) & day.between(1, last)


def _date(text: Column) -> Column:
    return matches(text, f"^{_DAY}$") & _real_day(text)


def _date_time(text: Column) -> Column:
    return matches(text, PATTERNS["date-time"]) & _real_day(text)


def _iso_date_time(text: Column) -> Column:
    return matches(text, PATTERNS["iso-date-time"]) & _real_day(text)


def _any_text(text: Column) -> Column:
    return text.isNotNull()


def _by_pattern(name: str) -> Callable[[Column], Column]:
    return lambda text: matches(text, PATTERNS[name])


FORMATS: dict[str, Callable[[Column], Column]] = {
    **{name: _by_pattern(name) for name in PATTERNS},
    "date": _date,
    "date-time": _date_time,
    "iso-date-time": _iso_date_time,
    # Named for people, not for checks.
    "password": _any_text,
    "binary": _any_text,
}

#: Formats of numbers; others leave numbers alone.
INT32, INT64 = (1 << 31), (1 << 63)
NUMBER_FORMATS: dict[str, Callable[[Column], Column]] = {
    "int32": lambda n: (n == F.rint(n)) & n.between(-INT32, INT32 - 1),
    "int64": lambda n: (n == F.rint(n)) & n.between(-float(INT64), float(INT64)),
    "float": lambda n: n.isNotNull(),
    "double": lambda n: n.isNotNull(),
}


def has_format(text: Column, name: str) -> Column | None:
    """Predicate for a named format; None for a name that is not known."""
    rule = FORMATS.get(name)
    return None if rule is None else F.coalesce(rule(text), F.lit(False))
