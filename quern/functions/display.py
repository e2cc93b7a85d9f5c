"""Texts shown for sizes, times, prices, context windows and statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import number_text

UNITS = ("B", "KB", "MB", "GB")

# Labels of finished runs.
STATUS_LABELS = {
    "completed": "Completed",
    "completed_with_errors": "Completed with errors",
    "failed": "Failed",
    "cancelled": "Cancelled",
}


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, halves away from zero."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(value + F.lit(0.5))


def _by_unit(size: Column, show) -> Column:
    steps = [(1024.0 ** i, unit) for i, unit in enumerate(UNITS)]
    last = show(size / F.lit(steps[-1][0]), steps[-1][1])
    return reduce(
        lambda rest, i: F.when(size < steps[i + 1][0], show(size / F.lit(steps[i][0]), steps[i][1])).otherwise(rest),
        reversed(range(len(steps) - 1)),
        last,
    )


def bytes_text(size: Column) -> Column:
    """``1.50 KB``: always two decimals."""
    return _by_unit(size.cast("double"), lambda v, u: F.concat(fixed(v, 2), F.lit(f" {u}")))


def bytes_text_trimmed(size: Column) -> Column:
    """``1.5 KB``: up to two decimals, ``0 B`` for nothing."""
    def show(value: Column, unit: str) -> Column:
        return F.concat(F.regexp_replace(fixed(value, 2), r"\.?0+$", ""), F.lit(f" {unit}"))

    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").otherwise(_by_unit(size.cast("double"), show))


def bytes_text_short(size: Column) -> Column:
    """``1.5 KB``: always one decimal, ``0 B`` for nothing."""
    shown = _by_unit(size.cast("double"), lambda v, u: F.concat(fixed(v, 1), F.lit(f" {u}")))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").otherwise(shown)


def duration_text(ms: Column) -> Column:
    ms = ms.cast("double")
    minutes = F.floor(ms / 60000).cast("string")
    seconds = F.floor((ms % 60000) / 1000).cast("string")
    return (
        F.when(ms < 1000, F.concat(number_text(ms), F.lit("ms")))
        .when(ms < 60000, F.concat(fixed(ms / 1000, 1), F.lit("s")))
        .otherwise(F.concat(minutes, F.lit("m "), seconds, F.lit("s")))
    )


def relative_time(at: Column, now: Column, days: bool = True) -> Column:
    """``3 hours ago``; older than a week (or a day without ``days``) gives the date."""
    ms = F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))

    def ago(unit_ms: int, unit: str) -> Column:
        n = F.floor(ms / unit_ms)
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    text = (
        F.when(at.isNull(), "")
        .when(ms < 60_000, "just now")
        .when(ms < 3_600_000, ago(60_000, "minute"))
        .when(ms < 86_400_000, ago(3_600_000, "hour"))
    )
    if days:
        text = text.when(ms < 604_800_000, ago(86_400_000, "day"))
    return text.otherwise(F.date_format(at, "yyyy-MM-dd"))


def progress_text(current: Column, total: Column, label: str = "Progress") -> Column:
    """``Progress: 7/10 (70%)``."""
    percent = round_half_up(F.try_divide(current, total) * 100).cast("string")
    return F.concat(
        F.lit(f"{label}: "), current.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), percent, F.lit("%)")
    )


def cost_text(amount: Column, currency: str = "$") -> Column:
    return F.concat(F.lit(currency), fixed(amount, 4))


def price_per_million(prompt: Column, model_id: Column) -> Column:
    """``Free``, else dollars per million tokens with 3, 2 or 1 decimals."""
    price = F.coalesce(prompt.cast("double"), F.lit(0.0))
    million = price * 1_000_000

    def show(digits: int) -> Column:
        return F.concat(F.lit("$"), fixed(million, digits), F.lit("/M"))

    return (
        F.when((price == 0) | F.contains(model_id, F.lit(":free")), "Free")
        .when(million < 1, show(3))
        .when(million < 10, show(2))
        .otherwise(show(1))
    )


def price_pair(prompt: Column, completion: Column) -> Column:
    """``$in/$out`` per million tokens."""
    p, c = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (prompt, completion))
    pair = F.concat(F.lit("$"), fixed(p * 1_000_000, 2), F.lit("/$"), fixed(c * 1_000_000, 2))
    return F.when((p == 0) & (c == 0), "Free").otherwise(pair)


def context_thousands(length: Column) -> Column:
    """``128K``; ``?`` when not known."""
    known = F.concat(fixed(length / 1000, 0), F.lit("K"))
    return F.when(F.coalesce(length, F.lit(0)) == 0, "?").otherwise(known)


def context_text(length: Column) -> Column:
    """``1M``, ``128k`` or the number; ``Unknown`` when not known."""
    return (
        F.when(F.coalesce(length, F.lit(0)) == 0, "Unknown")
        .when(length >= 1_000_000, F.concat(round_half_up(length / 1_000_000).cast("string"), F.lit("M")))
        .when(length >= 1000, F.concat(round_half_up(length / 1000).cast("string"), F.lit("k")))
        .otherwise(length.cast("string"))
    )


def provider_name(model_id: Column, known: Column | None = None) -> Column:
    """The given provider, else the capitalised part of the id before the slash."""
    prefix = F.regexp_extract(model_id, "^([^/]+)/", 1)
    named = F.when(prefix != "", F.concat(F.upper(F.substring(prefix, 1, 1)), F.substring(prefix, F.lit(2), F.char_length(prefix))))
    given = F.lit(None).cast("string") if known is None else F.nullif(known, F.lit(""))
    return F.coalesce(given, named, F.lit("Unknown"))


def status_label(status: Column) -> Column:
    text = F.lit(None).cast("string")
    for key, label in reversed(STATUS_LABELS.items()):
        text = F.when(status == key, label).otherwise(text)
    return F.coalesce(text, status)
