"""Reading JSON out of free-text answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.pinned import pin
from quern.functions.text import error_excerpt
from quern.functions.variants import parse_exact

_FENCE = "```"
_BLANK = " \t\n\r\f\v ﻿"


def json_part(answer: Column, compat: bool = False) -> Column:
    """The JSON text inside an answer.

    A fenced ``json`` block wins, then the span from the first ``{`` to the last
    ``}``, then the whole text.  Unless ``compat``, a text whose first bracket is
    ``[`` is read up to the last ``]``, so a bare list of objects stays whole.
    """
    text = F.btrim(answer, F.lit(_BLANK))
    opens = F.locate(_FENCE + "json", text)
    body_at = opens + len(_FENCE) + 4
    closes = F.locate(_FENCE, F.substring(text, body_at, F.char_length(text)))
    fenced = F.btrim(F.substring(text, body_at, closes - 1), F.lit(_BLANK))

    def span(left: str, right: str) -> tuple[Column, Column, Column]:
        first = F.locate(left, text)
        last = F.char_length(text) + 1 - F.locate(right, F.reverse(text))
        found = (first > 0) & (F.locate(right, text) > 0)
        return first, found, F.substring(text, first, F.greatest(last - first + 1, F.lit(0)))

    brace_at, braces, object_text = span("{", "}")
    list_at, brackets, list_text = span("[", "]")
    part = F.when((opens > 0) & (closes > 0), fenced)
    if not compat:
        part = part.when(brackets & ((brace_at == 0) | (list_at < brace_at)), list_text)
    return part.when(braces, object_text).otherwise(text)


def read_answer(answer: Column, compat: bool = False) -> Column:
    """The VARIANT inside an answer, NULL when there is none."""
    return parse_exact(json_part(answer, compat))


def with_answer(df: DataFrame, answer: str, compat: bool = False) -> DataFrame:
    """Add ``data``, and for answers that cannot be read ``parse_error`` and ``excerpt``."""
    lacks = F.col("data").isNull()
    return pin(df, data=read_answer(F.col(answer), compat)).withColumns({
        "parse_error": F.when(lacks, "Failed to parse JSON response"),
        "excerpt": F.when(lacks, error_excerpt(F.col(answer))),
    })


def soft_parse(answer: Column, context: Column) -> Column:
    """The parsed value, or ``{content, context}`` when the text is no JSON."""
    wrapped = F.to_variant_object(F.struct(answer.alias("content"), context.alias("context")))
    return F.coalesce(parse_exact(answer), wrapped)
