"""Text columns: slugs, file names, number text, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin spelling of the 33 Cyrillic letters. The hard and the soft
# sign have no spelling; they count as punctuation and so become "_".
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo",
    "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch",
    "ы": "y", "э": "e", "ю": "yu", "я": "ya",
}

PREVIEW_CHARS = 80
ERROR_EXCERPT_CHARS = 200
ATTACHMENT_CHARS = 10_000


def translit(text: Column) -> Column:
    """Latin lower-case slug of a text; NULL gives the empty string."""
    singles = {c: l for c, l in LATIN.items() if len(l) == 1}
    multis = {c: l for c, l in LATIN.items() if len(l) > 1}
    # One pass folds capitals and spells the one-letter cases.
    source = "".join(c.upper() + c for c in singles) + "".join(c.upper() for c in multis)
    target = "".join(l * 2 for l in singles.values()) + "".join(multis)
    given = F.coalesce(text, F.lit(""))
    spelled = F.translate(given, source, target)
    for letter, latin in multis.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(latin))
    # Most texts hold no Cyrillic letter; finding that out is far cheaper than spelling.
    # \P{Alnum} is everything but ASCII letters and digits.
    latin_text = F.when(F.rlike(given, F.lit("[Ѐ-ӿ]")), spelled).otherwise(given)
    return F.lower(F.regexp_replace(latin_text, r"\P{Alnum}+", "_"))


def number_text(value: Column) -> Column:
    """Text of a double: digits without an exponent from 1e-6 to below 1e21, else ``1e-20`` and ``1.5e+21``."""
    plain = value.cast("string")
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(plain, "E", 1), "[-.]", ""), r"(?<=\d)0+$", "")
    power = F.substring_index(plain, "E", -1).try_cast("int")
    size = F.char_length(digits)
    whole = F.when(size <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(size == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), size)))
    spelled = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
    return (
        F.when(F.isnan(value), "NaN")
        .when((F.abs(value) < F.lit(1e18)) & (value == F.rint(value)), value.cast("decimal(20,0)").cast("string"))
        .when(~F.contains(plain, F.lit("E")), plain)
        .otherwise(F.concat(sign, F.when(power.between(0, 20), whole).when(power.between(-6, -1), small).otherwise(spelled)))
    )


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9.-]", "_")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash, empty when there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Extension with its dot; empty for none and for names like ``.profile``."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]*)$", 1)


def cut(text: Column, limit: int, tail: str) -> Column:
    """Text longer than ``limit`` is cut there and marked with ``tail``."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def preview(text: Column) -> Column:
    return cut(text, PREVIEW_CHARS, "...")


def error_excerpt(text: Column) -> Column:
    return F.substring(text, 1, ERROR_EXCERPT_CHARS)


def attachment_text(text: Column) -> Column:
    return cut(text, ATTACHMENT_CHARS, "\n... [truncated]")
