"""The model catalogue: projection, filters, facets, ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.display import context_text

# Price limits per token and context limits in tokens.
CHEAP_PROMPT = 0.000001
CHEAP_COMPLETION = 0.000003
SMALL_CONTEXT = 10_000
LARGE_CONTEXT = 100_000

# Price of a web search through the plugin, and the three tiers of
# the provider that searches by itself.
SEARCH_PLUGIN = 0.02
SEARCH_LOW = 0.005
SEARCH_MEDIUM = 0.008
SEARCH_HIGH = 0.012
NATIVE_SEARCH_PROVIDER = "perplexity"

# Parts of model ids behind the named quick filters.
FAST_IDS = ("gpt-3.5", "mistral-7b", "llama-3.1-8b", "llama-3.2", "gemini-flash", "claude-3-haiku")
SMART_IDS = ("gpt-4", "claude-3-opus", "claude-3.5", "gemini-pro", "o1-preview", "o1-mini")
CODING_IDS = ("codestral", "code", "gpt-4", "claude", "deepseek")
POPULAR_IDS = ("gpt", "claude", "gemini")

# Parts of model ids per provider facet.
PROVIDER_IDS = {
    "openai": ("gpt", "o1-"),
    "anthropic": ("claude",),
    "google": ("gemini", "palm"),
    "meta": ("llama",),
    "mistral": ("mistral", "mixtral"),
    "perplexity": ("perplexity",),
}

# Context facets as half-open ranges.
CONTEXT_RANGES = {
    "4k": (4000, 8000),
    "8k": (8000, 16000),
    "16k": (16000, 32000),
    "32k": (32000, 128000),
    "128k+": (128000, None),
    "small-context": (None, SMALL_CONTEXT),
    "medium-context": (SMALL_CONTEXT, LARGE_CONTEXT),
    "large-context": (LARGE_CONTEXT, None),
}


def _id_has(parts: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(F.col("id"), F.lit(p)) for p in parts])


def _takes(modality: str) -> Column:
    return F.coalesce(F.array_contains("input_modalities", modality), F.lit(False))


def _supports(parameter: str) -> Column:
    return F.coalesce(F.array_contains("supported_parameters", parameter), F.lit(False))


def _price(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def project_models(raw: DataFrame, *kept: str) -> DataFrame:
    """Flat catalogue from nested model records, with the ``kept`` columns.

    Input: id, name, context_length, created, pricing{prompt, completion},
    architecture{input_modalities}, top_provider{max_completion_tokens,
    is_moderated}, supported_parameters.
    """
    native = F.contains(F.lower("id"), F.lit(NATIVE_SEARCH_PROVIDER))
    none = F.array().cast("array<string>")

    def tier(price: float) -> Column:
        return F.when(native, F.lit(price))

    return raw.select(
        *kept, "id", "name", "context_length", "created",
        F.col("pricing.prompt").cast("double").alias("prompt"),
        F.col("pricing.completion").cast("double").alias("completion"),
        F.col("top_provider.max_completion_tokens").alias("max_completion_tokens"),
        F.col("top_provider.is_moderated").alias("is_moderated"),
        F.coalesce(F.col("architecture.input_modalities"), none).alias("input_modalities"),
        F.coalesce(F.col("supported_parameters"), none).alias("supported_parameters"),
        F.lit(True).alias("supports_web_search"),
        native.alias("has_native_web_search"),
        F.struct(
            F.lit(SEARCH_PLUGIN).alias("plugin"), tier(SEARCH_LOW).alias("low"), tier(SEARCH_MEDIUM).alias("medium"),
            tier(SEARCH_HIGH).alias("high"),
        ).alias("web_search_pricing"),
    )


def search_price_per_thousand() -> Column:
    """The medium tier of a native search, else the plugin price."""
    own = F.col("has_native_web_search") & F.col("web_search_pricing.medium").isNotNull()
    return F.when(own, F.col("web_search_pricing.medium")).otherwise(F.col("web_search_pricing.plugin")) * 1000


# -- predicates ---------------------------------------------------------------

def is_free() -> Column:
    """Free by prompt price or by a ``:free`` id."""
    return (_price("prompt") == 0) | F.contains(F.col("id"), F.lit(":free"))


def is_paid() -> Column:
    return (_price("prompt") > 0) & ~F.contains(F.col("id"), F.lit(":free"))


def costs_nothing() -> Column:
    return (_price("prompt") == 0) & (_price("completion") == 0)


def is_popular() -> Column:
    return _id_has(POPULAR_IDS)


def list_filter(name: str) -> Column:
    """Filters of the model list: free, paid, vision, functions, reasoning, param_*, modality_*."""
    named = {
        "free": is_free, "paid": is_paid, "vision": lambda: _takes("image"), "functions": lambda: _supports("tools"),
        "reasoning": lambda: _supports("reasoning"),
    }
    if name in named:
        return named[name]()
    if name.startswith("param_"):
        return _supports(name.removeprefix("param_"))
    if name.startswith("modality_"):
        return _takes(name.removeprefix("modality_"))
    raise ValueError(f"unknown filter: {name}")


def matches_search(query: str) -> Column:
    """Case-insensitive part of the name or the id; blank matches all."""
    if not query.strip():
        return F.lit(True)
    part = F.lit(query.lower())
    return F.contains(F.lower("name"), part) | F.contains(F.lower("id"), part)


def quick_filter(name: str) -> Column:
    """Named shortcuts; an unknown name matches all."""
    cheap = (_price("prompt") > 0) & (_price("prompt") < CHEAP_PROMPT) & (_price("completion") < CHEAP_COMPLETION)
    return {
        "free": costs_nothing(),
        "cheap": cheap,
        "fast": _id_has(FAST_IDS),
        "smart": _id_has(SMART_IDS),
        "coding": _id_has(CODING_IDS),
        "multimodal": _takes("image") | _takes("audio"),
        "large-context": F.coalesce(F.col("context_length"), F.lit(0)) >= LARGE_CONTEXT,
    }.get(name, F.lit(True))


def is_cheap() -> Column:
    """Cheap as a facet: limits included, free models too."""
    return (_price("prompt") <= CHEAP_PROMPT) & (_price("completion") <= CHEAP_COMPLETION)


def facet(name: str) -> Column:
    """Predicate of one facet value; unknown values match nothing."""
    moderated = F.coalesce(F.col("is_moderated"), F.lit(False))
    if name in CONTEXT_RANGES:
        low, high = CONTEXT_RANGES[name]
        length = F.col("context_length")
        bounds = [length >= low] if low is not None else []
        bounds += [length < high] if high is not None else []
        return F.coalesce(reduce(and_, bounds), F.lit(False))
    if name in PROVIDER_IDS:
        return _id_has(PROVIDER_IDS[name])
    return {
        "multimodal": _takes("image") | _takes("audio"),
        "vision": _takes("image"),
        "audio": _takes("audio"),
        "function-calling": _supports("tools"),
        "has-tools": _supports("tools"),
        "json-mode": _supports("response_format"),
        "structured-output": _supports("response_format"),
        "web-search": F.col("supports_web_search") | F.contains(F.col("id"), F.lit(NATIVE_SEARCH_PROVIDER)),
        "native-web-search": F.col("has_native_web_search"),
        "free": costs_nothing(),
        "cheap": is_cheap(),
        "premium": ~is_cheap(),
        "moderated": moderated,
        "unmoderated": ~moderated,
    }.get(name, F.lit(False))


def facet_filter(active: Mapping[str, Sequence[str]]) -> Column:
    """At least one value of every group that has any."""
    groups = [reduce(or_, [facet(v) for v in values]) for values in active.values() if values]
    return reduce(and_, groups, F.lit(True))


def visible_models(users: DataFrame, models: DataFrame, active: Mapping[str, Sequence[str]]) -> DataFrame:
    """Models per user setting ``only_free``.

    A user's list depends only on that flag, so the lists are made once per flag
    value and counted; users are joined to the two results by the flag.
    """
    kept = models.filter(facet_filter(active)).withColumn("_free", costs_nothing())
    totals = kept.agg(F.count("*").alias("all"), F.count_if("_free").alias("free"))
    per_flag = totals.select(F.explode(F.array(
        F.struct(F.lit(False).alias("only_free"), F.col("all").alias("models")),
        F.struct(F.lit(True).alias("only_free"), F.col("free").alias("models")),
    )).alias("r")).select("r.*")
    # A user without the setting has not asked for free models only.
    return users.withColumn("only_free", F.coalesce("only_free", F.lit(False))).join(per_flag, "only_free")


# -- aggregates ---------------------------------------------------------------

CAPABILITY_FACETS = (
    "multimodal", "vision", "audio", "has-tools", "structured-output", "web-search", "native-web-search",
)


def price_bucket() -> Column:
    return F.when(costs_nothing(), "free").when(is_cheap(), "cheap").otherwise("premium")


def context_bucket() -> Column:
    length = F.coalesce(F.col("context_length"), F.lit(0))
    return F.when(length < SMALL_CONTEXT, "small-context").when(length < LARGE_CONTEXT, "medium-context").otherwise("large-context")


def facet_counts(models: DataFrame, *by: str) -> DataFrame:
    """Models per facet value, in one pass: (group, value, models)."""
    buckets = {
        "capabilities": {name: facet(name) if name != "web-search" else F.col("supports_web_search") for name in CAPABILITY_FACETS},
        "pricing": {name: price_bucket() == name for name in ("free", "cheap", "premium")},
        "context": {name: context_bucket() == name for name in ("small-context", "medium-context", "large-context")},
        "moderation": {name: facet(name) for name in ("moderated", "unmoderated")},
    }
    flat = [(group, value, p) for group, values in buckets.items() for value, p in values.items()]
    counted = models.groupBy(*by).agg(*[F.count_if(p).alias(f"c{i}") for i, (_, _, p) in enumerate(flat)])
    rows = F.array(*[
        F.struct(F.lit(g).alias("facet"), F.lit(v).alias("value"), F.col(f"c{i}").alias("models"))
        for i, (g, v, _) in enumerate(flat)
    ])
    return counted.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def value_counts(models: DataFrame, column: str) -> DataFrame:
    """Distinct entries of an array column with the number of models."""
    entries = models.select(F.explode(F.array_distinct(column)).alias("value"))
    return entries.groupBy("value").agg(F.count("*").alias("models"))


def free_and_paid(models: DataFrame) -> DataFrame:
    return models.agg(
        F.count("*").alias("total"), F.count_if(is_free()).alias("free"), F.count_if(~is_free()).alias("paid")
    )


# -- order --------------------------------------------------------------------

def newest_first(models: DataFrame) -> DataFrame:
    """Dated models first, newest first; undated ones by name."""
    dated = F.when(F.coalesce(F.col("created"), F.lit(0)) != 0, F.col("created"))
    return models.orderBy(dated.desc_nulls_last(), "name", "id")


# -- display ------------------------------------------------------------------

def badges() -> Column:
    """Short labels of a model."""
    return F.array_compact(F.array(
        F.when(costs_nothing(), "Free"),
        F.when(F.coalesce(F.col("is_moderated"), F.lit(False)), "Moderated"),
        F.when(_takes("image"), "Vision"),
        F.when(_takes("audio"), "Audio"),
        F.when(_supports("tools"), "Tools"),
        F.when(F.col("has_native_web_search"), "Native Search").when(F.col("supports_web_search"), "Web Search"),
        F.when(_supports("response_format"), "JSON"),
        F.when(F.col("context_length") >= LARGE_CONTEXT, context_text(F.col("context_length"))),
    ))


def base_model(model_id: Column) -> Column:
    return F.regexp_replace(model_id, r":online\z", "")


def is_online(model_id: Column) -> Column:
    return F.endswith(model_id, F.lit(":online"))


def match_models(requested: DataFrame, models: DataFrame, model_id: str = "model_id") -> DataFrame:
    """Catalogue row of a requested id, whether or not it asks for web search."""
    named = requested.withColumn("id", base_model(F.col(model_id))).withColumn("online", is_online(F.col(model_id)))
    return named.join(models, "id", "left")
