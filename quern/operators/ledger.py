"""Run ledger: costs, totals, estimates, progress, users, storage, metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.display import round_half_up
from quern.operators.running import running_totals, top_per_key

# Fixed values of the service: history page, stale limit, session life, quota,
# prompt tokens assumed per item.
HISTORY_PAGE = 50
STALE_SECONDS = 300
SESSION_HOURS = 24
DEFAULT_QUOTA_BYTES = 10_485_760
PROMPT_TOKENS_PER_ITEM = 500
PROGRESS_BLOCK = 100_000


# -- cost ---------------------------------------------------------------------

def request_cost(split: bool = True) -> Column:
    """Cost of one request.

    The provider's own two costs when both are given, else tokens by price per
    token: split into prompt and completion price, or all at the prompt price.
    """
    given = (F.coalesce(F.col("prompt_cost"), F.lit(0.0)) != 0) & (F.coalesce(F.col("completion_cost"), F.lit(0.0)) != 0)
    asked = F.coalesce(F.col("prompt_tokens"), F.lit(0))
    answered = F.coalesce(F.col("completion_tokens"), F.lit(0))
    prompt = F.coalesce(F.col("prompt"), F.lit(0.0))
    completion = F.coalesce(F.col("completion"), F.lit(0.0))
    counted = asked * prompt + answered * completion if split else (asked + answered) * prompt
    return F.when(given, F.col("prompt_cost") + F.col("completion_cost")).otherwise(counted)


def with_prices(requests: DataFrame, models: DataFrame, model_id: str = "model_id") -> DataFrame:
    """Prices by model id; unknown models cost nothing."""
    prices = models.select(F.col("id").alias(model_id), "prompt", "completion")
    return requests.join(prices, model_id, "left")


def run_totals(requests: DataFrame, *by: str) -> DataFrame:
    """Items, tokens, cost, errors and averages per group."""
    good = F.col("error").isNull()
    totals = requests.groupBy(*by).agg(
        F.count_if(good).alias("items"),
        F.count_if(~good).alias("errors"),
        F.sum(F.when(good, F.coalesce(F.col("prompt_tokens"), F.lit(0))).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(good, F.coalesce(F.col("completion_tokens"), F.lit(0))).otherwise(0)).alias("completion_tokens"),
        F.sum(F.when(good, F.col("cost")).otherwise(0.0)).alias("cost"),
    )
    n = F.greatest(F.col("items"), F.lit(1))
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return totals.select(
        *by, "items", "errors", "prompt_tokens", "completion_tokens", tokens.alias("total_tokens"), "cost",
        round_half_up(tokens / n).alias("avg_tokens"), (F.col("cost") / n).alias("avg_cost"),
        F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed").alias("status"),
    )


def estimate_difference(actual: Column, estimated: Column) -> Column:
    """Percent by which the actual cost differs from the estimate."""
    return F.try_divide(actual - estimated, estimated) * 100


def max_cost_estimate(count: Column, max_tokens: Column, price_per_million: Column) -> Column:
    return price_per_million * (count * max_tokens / 1_000_000)


def detailed_estimate(count: Column, max_tokens: Column, prompt: Column, completion: Column, search_per_thousand: Column | None) -> Column:
    """``struct(prompt, completion, web_search, total)`` with prices per token."""
    p = count * PROMPT_TOKENS_PER_ITEM * prompt
    c = count * max_tokens * completion
    w = F.lit(0.0) if search_per_thousand is None else count / 1000 * search_per_thousand
    return F.struct(p.alias("prompt"), c.alias("completion"), w.alias("web_search"), (p + c + w).alias("total"))


def history_rows(totals: DataFrame, now: datetime) -> DataFrame:
    """Ledger rows of finished runs, ready to append; metadata is JSON text."""
    metadata = F.to_json(F.struct(F.lit("json").alias("format"), (F.col("items") + F.col("errors")).alias("requests")))
    return totals.withColumn("metadata", metadata).withColumn("completed_at", F.lit(now).cast("timestamp"))


# -- progress and history -----------------------------------------------------

def progress(requests: DataFrame, run: str, index: str) -> DataFrame:
    """Running item count, tokens and cost along each run, and its number of requests.

    ``index`` numbers the requests of a run, so blocks of it are even.
    """
    good = F.col("error").isNull()
    block = F.floor(F.col(index) / PROGRESS_BLOCK)
    run_rows = running_totals(
        requests, [run], [index],
        {
            "current": good.cast("bigint"),
            "tokens_so_far": F.when(good, F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(0),
            "cost_so_far": F.when(good, F.col("cost")).otherwise(F.lit(0).cast(dict(requests.dtypes)["cost"])),
        },
        block,
        {"total": F.lit(1).cast("bigint")},
    )
    percent = round_half_up(F.try_divide(F.col("current"), F.col("total")) * 100)
    return run_rows.withColumn("percent", percent)


def latest_runs(runs: DataFrame, user: str, started: str, run: str, n: int = HISTORY_PAGE) -> DataFrame:
    return top_per_key(runs, [user], [F.col(started).desc(), F.col(run).desc()], n)


def last_write(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row per key; combined before the shuffle, no sort."""
    newest = F.max(F.struct(*order, *[v for v in values if v not in order]))
    got = rows.groupBy(*keys).agg(newest.alias("_w"))
    return got.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in dict.fromkeys([*order, *values])])


def queue_view(active: DataFrame, finished: DataFrame) -> DataFrame:
    """Active and finished runs in one list."""
    return active.withColumn("kind", F.lit("active")).unionByName(
        finished.withColumn("kind", F.lit("completed")), allowMissingColumns=True
    )


def insert_ignore(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Existing rows plus new rows whose key is not there; first duplicate wins."""
    columns = [c for c in new.columns if c != key]
    rest = [c for c in columns if c not in order]
    first = new.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_w"))
    once = first.select(key, *[F.col(f"_w.{c}").alias(c) for c in columns])
    fresh = once.join(table.select(key), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


# -- users and sessions -------------------------------------------------------

def users_with_roles(users: DataFrame, roles: DataFrame, role: str, keys: DataFrame, user: str) -> DataFrame:
    """Users with their role, and whether they own any row of ``keys``."""
    owners = keys.select(user).distinct().withColumn("_own", F.lit(True))
    return (
        users.join(roles, role, "left")
        .join(owners, user, "left")
        .withColumn("has_key", F.col("_own").isNotNull())
        .drop("_own")
    )


def open_sessions(sessions: DataFrame, users: DataFrame, roles: DataFrame, user: str, role: str, created: str, now: datetime) -> DataFrame:
    """Sessions that have not expired, with user and role."""
    expires = F.col(created).cast("timestamp") + F.expr(f"INTERVAL {SESSION_HOURS} HOURS")
    live = sessions.withColumn("expires_at", expires).filter(F.col("expires_at") > F.lit(now).cast("timestamp"))
    return live.join(users, user).join(roles, role, "left")


def first_admin(users: DataFrame, user: str) -> DataFrame:
    """The user with the smallest id."""
    return users.join(users.agg(F.min(user).alias(user)), user)


def scope(rows: DataFrame, owner: str, viewer: Column, admin: Column) -> DataFrame:
    """Rows a viewer may see: the own ones, or all for an admin."""
    return rows.filter(admin | (F.col(owner) == viewer))


def user_stats(users: DataFrame, active: Column, *by: str) -> DataFrame:
    return users.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(~active).alias("inactive")
    )


def owners_exist(rows: DataFrame, owner: str) -> DataFrame:
    """Number of rows per owner: existence is a count above zero."""
    return rows.groupBy(owner).agg(F.count("*").alias("rows"))


# -- storage and account ------------------------------------------------------

def storage_usage(files: DataFrame, owner: str, size: str, quota: Column) -> DataFrame:
    """Used and available bytes and percent per owner."""
    used = files.groupBy(owner).agg(F.sum(size).cast("bigint").alias("used"))
    return (
        used.withColumn("quota", quota)
        .withColumn("available", F.greatest(F.col("quota") - F.col("used"), F.lit(0).cast("bigint")))
        .withColumn("percent", round_half_up(F.try_divide(F.col("used"), F.col("quota")) * 100))
    )


def upload_check(batch: DataFrame, usage: DataFrame, owner: str, size: str) -> DataFrame:
    """Whether the files of a batch fit together into what is left of the quota."""
    wanted = batch.groupBy(owner).agg(
        F.sum(size).cast("bigint").alias("batch_bytes"), F.max(size).cast("bigint").alias("largest")
    )
    joined = wanted.join(usage.select(owner, "available"), owner, "left")
    left = F.coalesce(F.col("available"), F.lit(DEFAULT_QUOTA_BYTES).cast("bigint"))
    return joined.withColumn("fits", F.col("batch_bytes") <= left).withColumn("largest_fits", F.col("largest") <= left).drop("available")


def account_usage(spent: DataFrame, limit: Column) -> DataFrame:
    """Remaining amount and percent used, from columns ``usage`` and a limit."""
    percent = F.when(F.col("limit") > 0, F.round(F.col("usage") / F.col("limit") * 100, 1)).otherwise(0.0)
    return spent.withColumn("limit", limit).withColumn("remaining", F.col("limit") - F.col("usage")).withColumn("percent_used", percent)


# -- liveness and metrics -----------------------------------------------------

def last_heartbeats(events: DataFrame, run: str, ts: str) -> DataFrame:
    return events.groupBy(run).agg(F.max(ts).alias("last_heartbeat"))


def stale_runs(heartbeats: DataFrame, now: datetime) -> DataFrame:
    """Runs silent for more than five minutes."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {STALE_SECONDS} SECONDS")
    return heartbeats.filter(F.col("last_heartbeat").cast("timestamp") < limit)


def metrics(events: DataFrame, *by) -> DataFrame:
    """Counters of the diagnostics feed in one pass.

    Input: category (api, generation, validation), event, duration, tokens, valid.
    Start events are not counted.  Averages of nothing are 0.
    """
    category, event = F.col("category"), F.col("event")
    ended = ((category == "api") & event.isin("response", "error")) | (
        (category == "generation") & event.isin("complete", "error")
    ) | ((category == "validation") & (event == "complete"))
    good = F.when(category == "api", event == "response").when(category == "generation", event == "complete").otherwise(
        F.coalesce(F.col("valid"), F.lit(False))
    )
    timed = (category == "api") | ((category == "generation") & (event == "complete"))
    totals = events.filter(ended).groupBy(*by, "category").agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
        F.sum(F.when(timed, F.coalesce(F.col("duration"), F.lit(0)))).alias("total_duration"),
        F.sum(F.when((category == "api") & good, F.coalesce(F.col("tokens"), F.lit(0)))).alias("total_tokens"),
    )
    zero = F.lit(0.0)
    return totals.withColumn(
        "avg_duration", F.coalesce(F.try_divide(F.col("total_duration"), F.col("total")).cast("double"), zero)
    ).withColumn(
        "avg_tokens", F.coalesce(F.try_divide(F.col("total_tokens"), F.col("successful")).cast("double"), zero)
    )


# -- whole ledger rows -----------------------------------------------------------

def ledger_rows(totals: DataFrame, runs: DataFrame, errors: DataFrame, files: DataFrame, run: str = "run_id") -> DataFrame:
    """Ledger rows of finished runs with who ran what, how long, what failed and what was written.

    ``totals`` comes from ``run_totals``; ``runs`` has user_id, config_name, model,
    format, tasks, started_at and finished_at; ``errors`` a message and ``files`` a
    path per row.  Errors are told once per message with their number, files once per
    path, both as JSON text and null where there are none.
    """
    told = errors.groupBy(run, "message").agg(F.count("*").alias("count"))
    told = told.groupBy(run).agg(F.to_json(F.array_sort(F.collect_list(F.struct("message", "count")))).alias("errors"))
    written = files.select(run, "path").distinct().groupBy(run).agg(F.to_json(F.array_sort(F.collect_list("path"))).alias("output_files"))
    joined = totals.withColumnRenamed("errors", "failed").join(runs, run, "left").join(told, run, "left").join(written, run, "left")
    took = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return joined.select(
        run, "user_id", F.coalesce(F.nullif("config_name", F.lit("")), F.lit("Unnamed config")).alias("config_name"),
        F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model"), "status", F.col("items").alias("items_generated"),
        F.col("cost").alias("total_cost"), "total_tokens", "prompt_tokens", "completion_tokens", "errors", "output_files",
        F.to_json(F.struct(took.alias("duration"), "format", "tasks")).alias("metadata"), F.col("finished_at").alias("completed_at"),
    )
