"""Queries over the model catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.display import (
    context_text, context_thousands, price_pair, price_per_million, provider_name,
)
from quern.operators import catalog
from quern.plans.registry import query
from quern.plans.tables import MODELS_SQL, models, table


def _money(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST(round({expr}, {digits}) AS DOUBLE))"


@query("model_catalog", f"""
    WITH {MODELS_SQL}
    SELECT id, name, max_completion_tokens, is_moderated, native AS has_native_web_search, true AS supports_web_search,
      CASE WHEN native THEN 8e0 ELSE 20e0 END AS search_price,
      CASE WHEN prompt = 0 OR contains(id, ':free') THEN 'Free' WHEN prompt * 1000000 < 1 THEN '$' || {_money('prompt * 1000000', 3)} || '/M'
        ELSE '$' || {_money('prompt * 1000000', 2)} || '/M' END AS price,
      CASE WHEN prompt = 0 AND completion = 0 THEN 'Free' ELSE '$' || {_money('prompt * 1000000', 2)} || '/$' || {_money('completion * 1000000', 2)} END AS prices,
      CAST(context_length // 1000 AS VARCHAR) || 'K' AS context_k, CAST(context_length // 1000 AS VARCHAR) || 'k' AS context,
      CASE p_type WHEN 'ECONOMY' THEN 'Openai' WHEN 'LARGE' THEN 'Anthropic' WHEN 'MEDIUM' THEN 'Google' WHEN 'PROMO' THEN 'Meta-llama'
        WHEN 'SMALL' THEN 'Mistralai' ELSE 'Perplexity' END AS provider,
      concat_ws(',', CASE WHEN prompt = 0 AND completion = 0 THEN 'Free' END, CASE WHEN is_moderated THEN 'Moderated' END,
        CASE WHEN image THEN 'Vision' END, CASE WHEN audio THEN 'Audio' END, CASE WHEN tools THEN 'Tools' END,
        CASE WHEN native THEN 'Native Search' ELSE 'Web Search' END, CASE WHEN response_format THEN 'JSON' END,
        CASE WHEN context_length >= 100000 THEN CAST(context_length // 1000 AS VARCHAR) || 'k' END) AS badges
    FROM models JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey)
""")
def model_catalog(spark, sf_dir):
    return models(spark, sf_dir).select(
        "id", "name", "max_completion_tokens", "is_moderated", "has_native_web_search", "supports_web_search",
        catalog.search_price_per_thousand().alias("search_price"),
        price_per_million(F.col("prompt"), F.col("id")).alias("price"),
        price_pair(F.col("prompt"), F.col("completion")).alias("prices"),
        context_thousands(F.col("context_length")).alias("context_k"), context_text(F.col("context_length")).alias("context"),
        provider_name(F.col("id")).alias("provider"), F.array_join(catalog.badges(), ",").alias("badges"),
    )


LIST_FILTERS = ("free", "paid", "vision", "functions", "reasoning", "param_stream", "modality_audio")
QUICK_FILTERS = ("free", "cheap", "fast", "smart", "coding", "multimodal", "large-context")


@query("model_filters", f"""
    WITH {MODELS_SQL}, f AS (
      SELECT id, prompt = 0 OR contains(id, ':free') AS list_free, prompt > 0 AND NOT contains(id, ':free') AS list_paid, image AS list_vision,
        tools AS list_functions, reasoning AS list_reasoning, true AS list_param_stream, audio AS list_modality_audio,
        prompt = 0 AND completion = 0 AS quick_free, prompt > 0 AND prompt < 1e-6 AND completion < 3e-6 AS quick_cheap,
        contains(id, 'llama-3.1-8b') OR contains(id, 'gemini-flash') AS quick_fast, contains(id, 'gpt-4') OR contains(id, 'claude-3.5') AS quick_smart,
        contains(id, 'gpt-4') OR contains(id, 'claude') AS quick_coding, image OR audio AS "quick_multimodal",
        context_length >= 100000 AS "quick_large-context",
        contains(lower(name), 'red') OR contains(lower(id), 'red') AS search, contains(id, 'gpt') OR contains(id, 'claude') OR contains(id, 'gemini') AS popular
      FROM models
    )
    SELECT * FROM f
""")
def model_filters(spark, sf_dir):
    columns = [catalog.list_filter(n).alias(f"list_{n}") for n in LIST_FILTERS]
    columns += [catalog.quick_filter(n).alias(f"quick_{n}") for n in QUICK_FILTERS]
    return models(spark, sf_dir).select(
        "id", *columns, catalog.matches_search("Red").alias("search"), catalog.is_popular().alias("popular")
    )


ACTIVE = {"providers": ["openai", "google", "perplexity"], "capabilities": ["has-tools", "native-web-search"], "pricing": ["cheap", "free"], "context": [], "moderation": ["unmoderated"]}
ACTIVE_SQL = """
  (contains(id, 'gpt') OR contains(id, 'gemini') OR contains(id, 'perplexity')) AND (tools OR native)
  AND prompt <= 1e-6 AND completion <= 3e-6 AND NOT is_moderated
"""


@query("model_facet_filter", f"WITH {MODELS_SQL} SELECT id FROM models WHERE {ACTIVE_SQL}")
def model_facet_filter(spark, sf_dir):
    return models(spark, sf_dir).filter(catalog.facet_filter(ACTIVE)).select("id")


@query("visible_models", f"""
    WITH {MODELS_SQL}, n AS (SELECT count(*) AS every, count(*) FILTER (prompt = 0 AND completion = 0) AS free FROM models WHERE {ACTIVE_SQL})
    SELECT c_custkey, c_acctbal < 0 AS only_free, CASE WHEN c_acctbal < 0 THEN free ELSE every END AS models FROM customer, n
""")
def visible_models(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("only_free"))
    return catalog.visible_models(users, models(spark, sf_dir), ACTIVE).select("c_custkey", "only_free", "models")


@query("facet_counts", f"""
    WITH {MODELS_SQL}, f AS (
      SELECT unnest([
        {{'facet': 'capabilities', 'value': 'multimodal', 'models': count(*) FILTER (image OR audio)}},
        {{'facet': 'capabilities', 'value': 'vision', 'models': count(*) FILTER (image)}},
        {{'facet': 'capabilities', 'value': 'audio', 'models': count(*) FILTER (audio)}},
        {{'facet': 'capabilities', 'value': 'has-tools', 'models': count(*) FILTER (tools)}},
        {{'facet': 'capabilities', 'value': 'structured-output', 'models': count(*) FILTER (response_format)}},
        {{'facet': 'capabilities', 'value': 'web-search', 'models': count(*)}},
        {{'facet': 'capabilities', 'value': 'native-web-search', 'models': count(*) FILTER (native)}},
        {{'facet': 'pricing', 'value': 'free', 'models': count(*) FILTER (prompt = 0 AND completion = 0)}},
        {{'facet': 'pricing', 'value': 'cheap', 'models': count(*) FILTER (NOT (prompt = 0 AND completion = 0) AND prompt <= 1e-6 AND completion <= 3e-6)}},
        {{'facet': 'pricing', 'value': 'premium', 'models': count(*) FILTER (prompt > 1e-6 OR completion > 3e-6)}},
        {{'facet': 'context', 'value': 'small-context', 'models': count(*) FILTER (context_length < 10000)}},
        {{'facet': 'context', 'value': 'medium-context', 'models': count(*) FILTER (context_length >= 10000 AND context_length < 100000)}},
        {{'facet': 'context', 'value': 'large-context', 'models': count(*) FILTER (context_length >= 100000)}},
        {{'facet': 'moderation', 'value': 'moderated', 'models': count(*) FILTER (is_moderated)}},
        {{'facet': 'moderation', 'value': 'unmoderated', 'models': count(*) FILTER (NOT is_moderated)}}
      ]) AS r FROM models
    )
    SELECT r.facet AS facet, r.value AS value, r.models AS models FROM f
""")
def facet_counts(spark, sf_dir):
    return catalog.facet_counts(models(spark, sf_dir))


@query("value_counts", f"""
    WITH {MODELS_SQL}
    SELECT 'modality' AS kind, 'text' AS value, count(*) AS models FROM models
    UNION ALL SELECT 'modality', 'image', count(*) FROM models WHERE image
    UNION ALL SELECT 'modality', 'audio', count(*) FROM models WHERE audio
    UNION ALL SELECT 'parameter', 'stream', count(*) FROM models
    UNION ALL SELECT 'parameter', 'tools', count(*) FROM models WHERE tools
    UNION ALL SELECT 'parameter', 'response_format', count(*) FROM models WHERE response_format
    UNION ALL SELECT 'parameter', 'reasoning', count(*) FROM models WHERE reasoning
""")
def value_counts(spark, sf_dir):
    m = models(spark, sf_dir)
    first = catalog.value_counts(m, "input_modalities").withColumn("kind", F.lit("modality"))
    second = catalog.value_counts(m, "supported_parameters").withColumn("kind", F.lit("parameter"))
    return first.unionByName(second)


@query("free_and_paid", f"""
    WITH {MODELS_SQL} SELECT count(*) AS total, count(*) FILTER (prompt = 0 OR contains(id, ':free')) AS free,
      count(*) FILTER (NOT (prompt = 0 OR contains(id, ':free'))) AS paid FROM models
""")
def free_and_paid(spark, sf_dir):
    return catalog.free_and_paid(models(spark, sf_dir))


@query("topk_models", f"""
    WITH {MODELS_SQL}
    (SELECT 'newest' AS list, id FROM models ORDER BY created DESC NULLS LAST, name, id LIMIT 25)
    UNION ALL (SELECT 'free', id FROM models WHERE prompt = 0 OR contains(id, ':free') ORDER BY created DESC NULLS LAST, name, id LIMIT 10)
    UNION ALL (SELECT 'popular paid', id FROM models WHERE NOT (prompt = 0 OR contains(id, ':free'))
      AND (contains(id, 'gpt') OR contains(id, 'claude') OR contains(id, 'gemini')) ORDER BY created DESC NULLS LAST, name, id LIMIT 10)
""")
def topk_models(spark, sf_dir):
    m = models(spark, sf_dir)
    lists = {
        "newest": (m, 25), "free": (m.filter(catalog.is_free()), 10),
        "popular paid": (m.filter(~catalog.is_free() & catalog.is_popular()), 10),
    }
    out = None
    for name, (rows, n) in lists.items():
        part = catalog.newest_first(rows).limit(n).select(F.lit(name).alias("list"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("online_match", f"""
    WITH {MODELS_SQL}, r AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, m.id || CASE WHEN l_returnflag = 'A' THEN ':online' ELSE '' END AS model_id,
        l_returnflag = 'A' AS online, prompt
      FROM lineitem JOIN models m ON p_partkey = l_partkey
    )
    SELECT online, count(*) AS requests, count(DISTINCT model_id) AS models, round(sum(prompt * 1e6), 4) AS price FROM r GROUP BY 1
""")
def online_match(spark, sf_dir):
    m = models(spark, sf_dir).select("id", "prompt")
    keyed = models(spark, sf_dir, "p_partkey").select(F.col("p_partkey").alias("l_partkey"), F.col("id").alias("base"))
    asked = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").join(keyed, "l_partkey").select(
        F.concat("base", F.when(F.col("l_returnflag") == "A", ":online").otherwise("")).alias("model_id")
    )
    return catalog.match_models(asked, m).groupBy("online").agg(
        F.count("*").alias("requests"), F.countDistinct("model_id").alias("models"),
        F.round(F.sum(F.col("prompt") * 1e6), 4).alias("price"),
    )
