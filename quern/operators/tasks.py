"""From tasks to items: expansion, variable context, labels, keys, file names."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.pinned import pin
from quern.functions.template import map_lookup, render, render_column
from quern.functions.text import number_text, translit
from quern.functions.variants import as_object, describe, is_set

LABEL_FIELDS = ("theme", "topic", "category")
ITEM_BLOCK = 100_000


def tasks_of(configs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per entry of ``generation.tasks`` with its position."""
    found = F.try_variant_get(F.col(doc), "$.generation.tasks", "array<variant>")
    kept = [c for c in configs.columns if c != doc]
    tasks = configs.select(*kept, F.posexplode(found).alias("task_no", "task"))
    return tasks.withColumn("task_json", F.to_json("task")).withColumn(
        "count", F.try_variant_get("task", "$.count", "bigint")
    )


def planned_items(tasks: DataFrame, *by: str, count: str = "count") -> DataFrame:
    """Number of items planned; a task without a count makes one."""
    return tasks.groupBy(*by).agg(F.sum(F.coalesce(F.col(count), F.lit(1))).cast("bigint").alias("planned"))


def expand_items(tasks: DataFrame, keys: list[str], count: str = "count", block: int = ITEM_BLOCK) -> DataFrame:
    """``count`` rows per task with a 0-based ``index``.

    Tasks of ordinary size expand where they are.  A task larger than a block is
    first cut into blocks that are spread over the cluster, so one huge task
    does not become one huge partition.
    """
    n = F.coalesce(F.col(count).cast("bigint"), F.lit(1).cast("bigint"))
    small = tasks.filter((n > 0) & (n <= block)).withColumn("index", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    starts = F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(block).cast("bigint"))
    blocks = tasks.filter(n > block).withColumn("_start", F.explode(starts)).repartition(*keys, "_start")
    ends = F.least(F.col("_start") + block, n) - 1
    large = blocks.withColumn("index", F.explode(F.sequence(F.col("_start"), ends))).drop("_start")
    return small.unionByName(large)


def with_fields(tasks: DataFrame, task_json: str = "task_json") -> DataFrame:
    """Add ``fields``: the members of a task in the order stated, each described once."""
    parsed = pin(tasks, _obj=as_object(F.try_parse_json(F.col(task_json))))
    keys = F.array_distinct(F.json_object_keys(F.col(task_json)))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(F.col("_obj"), k).alias("v")))
    trimmed = F.transform(describe(pairs), lambda d: F.struct(
        d["key"].alias("key"), d["kind"].alias("kind"), d["n"].alias("n"), d["text"].alias("text")
    ))
    return pin(parsed, fields=trimmed).drop("_obj")


def _found(fields: Column, key: str) -> Column:
    """The member ``key`` when it counts as set, as an array of at most one."""
    return F.filter(fields, lambda d: (d["key"] == key) & is_set(d))


def field_text(fields: Column, key: str) -> Column:
    """Text of a member that is not missing, empty, 0, false or null."""
    return F.get(F.transform(_found(fields, key), lambda d: d["text"]), F.lit(0))


def _slug(fields: Column, key: str) -> Column:
    """Slug of a set member, empty for a number and the like; NULL when not set."""
    return F.get(F.transform(_found(fields, key), lambda d: F.when(d["kind"] == "string", translit(d["text"])).otherwise("")), F.lit(0))


def time_values(now: datetime) -> dict[str, Column]:
    """Date and time names of a run; ``now`` is taken once per run."""
    now = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)
    stamp = now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
    epoch = int(now.timestamp()) * 1000 + now.microsecond // 1000
    return {
        "date": F.lit(stamp[:10]), "datetime": F.lit(stamp), "now": F.lit(stamp), "timestamp": F.lit(str(epoch)),
    }


def with_context(items: DataFrame, now: datetime, index: str = "index") -> DataFrame:
    """Add ``ctx`` (name to text) and ``numeric`` (names of number values) to rows with ``fields``.

    Later groups win: task fields, then index and times, then derived names.
    Names keep the order in which the task states them.
    """
    fields = F.col("fields")
    own = F.map_from_entries(F.transform(fields, lambda d: F.struct(d["key"], d["text"])))
    numbers = F.filter(fields, lambda d: d["n"].isNotNull())
    stepped = F.map_from_entries(F.flatten(F.transform(numbers, lambda d: F.array(
        F.struct(F.concat(d["key"], F.lit("_minus_1")).alias("key"), number_text(d["n"] - 1).alias("value")),
        F.struct(F.concat(d["key"], F.lit("_plus_1")).alias("key"), number_text(d["n"] + 1).alias("value")),
    ))))
    level = F.get(F.transform(_found(fields, "difficulty"), lambda d: F.when(
        d["text"] == "easy", "1"
    ).when(d["text"] == "medium", "2").otherwise("3")), F.lit(0))
    fewer = F.get(F.transform(_found(fields, "answers"), lambda d: F.coalesce(
        number_text(F.coalesce(d["n"], d["text"].try_cast("double")) - 1), F.lit("NaN")
    )), F.lit(0))
    pairs: list[tuple[str, Column]] = [("index", F.col(index).cast("string")), *time_values(now).items()]
    pairs += [(f"{key}_translit", _slug(fields, key)) for key in LABEL_FIELDS]
    pairs += [("difficulty_num", level), ("answers_minus_1", fewer)]
    built = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])),
        lambda _, v: v.isNotNull(),
    )
    numeric = F.concat(
        F.transform(numbers, lambda d: d["key"]), F.array(*[F.lit(k) for k in ("index", "timestamp", "difficulty_num")])
    )
    return pin(items, ctx=F.map_concat(own, built, stepped), numeric=numeric)


def label_field(fields: Column) -> Column:
    """The member that labels a task; NULL when none is set."""
    return F.coalesce(*[F.get(_found(fields, key), F.lit(0)) for key in LABEL_FIELDS])


def with_label(items: DataFrame) -> DataFrame:
    """Add ``label``: the label field rendered without its own name in the context."""
    named = items.withColumn("_label", label_field(F.col("fields")))
    own = F.col("_label.key")
    others = F.map_filter(
        F.col("ctx"), lambda k, _: own.isNull() | ((k != own) & (k != F.concat(own, F.lit("_translit"))))
    )
    text = F.coalesce(F.col("_label.text"), F.lit("items"))
    return named.withColumn("label", render_column(text, others, F.col("numeric"))).drop("_label")


def task_key(fields: Column) -> Column:
    """``slug_suffix`` that groups results: label slug and difficulty or type."""
    slug = F.coalesce(*[_slug(fields, key) for key in LABEL_FIELDS], F.lit("data"))
    suffix = F.coalesce(field_text(fields, "difficulty"), field_text(fields, "type"), F.lit("default"))
    return F.concat(slug, F.lit("_"), suffix)


def file_name(fields: Column, key: Column, now: datetime, template: str | None, ext: str = ".json") -> Column:
    """Output file name from a template over the task, or ``key`` plus extension.

    ``{index}`` stays for the text writer, which numbers files from 1.
    """
    if not template:
        return F.concat(key, F.lit(ext))
    stated = F.filter(fields, lambda d: d["key"] != "index")
    slugs = {f"{k}_translit": F.coalesce(_slug(fields, k), F.lit("")) for k in ("theme", "topic")}
    extra = {**slugs, "key": key, **time_values(now)}
    both = F.map_concat(
        F.map_from_entries(F.transform(stated, lambda d: F.struct(d["key"], d["text"]))),
        F.map_from_arrays(F.array(*[F.lit(k) for k in extra]), F.array(*extra.values())),
    )
    return render(template, map_lookup(both))
