"""Deep merge of documents of any depth.

``merge`` of ``configs`` writes its levels out as one expression, so its depth is
bounded.  Every member taken out of a VARIANT is encoded anew with all that is below
it, so levels one by one cost the square of the depth.  Documents whose values all
read the same again from their JSON text are therefore merged as text, in one pass.

The others, with doubles or values that JSON has not, go level by level: each step
merges ``STEP`` levels of all of them at once; pairs of objects that are still deeper
are rows of the next step, with the path to them.  Going up again, every step puts the
merged objects of the one below in their places.  The steps grow with the depth of the
documents, not with their number.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.pinned import pin
from quern.functions.variants import as_object
from quern.session import materialize, scratch_path

#: Levels that one step merges.
STEP = 12
#: Types of values whose text may read as another type; lists of several types are told as VARIANT.
_OTHER_TYPES = "DOUBLE|FLOAT|DATE|TIME|INTERVAL|BINARY|UUID|VARIANT"
#: Before the digits of a number with a fraction while it is a string.
_NUMBER = "\u0000"
_PAIRS = "array<struct<path:string,base:variant,over:variant>>"


def _below(path: Column, name: Column) -> Column:
    """The path of a member; names are escaped so that no two paths are alike."""
    return F.concat(path, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _open_pairs(base: Column, over: Column, path: Column, levels: int) -> Column:
    """Pairs of objects ``levels`` below two objects, as path, base and over."""
    left, right = as_object(base), as_object(over)
    both = left.isNotNull() & right.isNotNull()
    if levels == 0:
        pair = F.array(F.struct(path.alias("path"), base.alias("base"), over.alias("over"))).cast(_PAIRS)
        return F.when(both, pair).otherwise(F.array().cast(_PAIRS))
    shared = F.coalesce(F.array_intersect(F.map_keys(left), F.map_keys(right)), F.array().cast("array<string>"))
    members = F.transform(shared, lambda k: F.struct(k.alias("k"), F.try_element_at(left, k).alias("a"), F.try_element_at(right, k).alias("b")))
    return F.flatten(F.transform(members, lambda m: _open_pairs(m["a"], m["b"], _below(path, m["k"]), levels - 1)))


def _merged(base: Column, over: Column, path: Column, levels: int) -> Column:
    """The merged value; ``_found`` holds those ``levels`` below by path."""
    left, right = as_object(base), as_object(over)
    if levels == 0:
        joined = F.try_element_at(F.col("_found"), path)
    else:
        def pick(name: Column, a: Column, b: Column) -> Column:
            return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(_merged(a, b, _below(path, name), levels - 1))

        joined = F.to_variant_object(F.map_zip_with(left, right, pick))
    return F.when(left.isNotNull() & right.isNotNull(), joined).otherwise(over)


def joined_texts(base: str, over: str) -> str | None:
    """The JSON texts of two documents merged; None where texts are too deep or hold the character that marks numbers."""
    if "\\u0000" in base or "\\u0000" in over:
        return None
    try:
        # Digits stay as they are.
        whole, top = (json.loads(text, parse_float=lambda digits: _NUMBER + digits) for text in (base, over))
        if not (isinstance(whole, dict) and isinstance(top, dict)):
            return over
        pairs = [(whole, top)]
        while pairs:
            left, right = pairs.pop()
            for key, value in right.items():
                if isinstance(value, dict) and isinstance(left.get(key), dict):
                    pairs.append((left[key], value))
                else:
                    left[key] = value
        parts = json.dumps(whole).split('"\\u0000')
        return parts[0] + "".join(part.replace('"', "", 1) for part in parts[1:])
    except RecursionError:
        return None


def _as_text(base: Column, over: Column) -> Column:
    """The merged text of two documents that read the same again from theirs, else NULL."""

    @F.arrow_udf("string")
    def merge(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else joined_texts(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.string())

    def text(doc: Column) -> Column:
        return F.when(~F.rlike(F.schema_of_variant(doc), F.lit(_OTHER_TYPES)), F.to_json(doc))

    return merge(text(base), text(over))


def merge_documents(df: DataFrame, base: str, over: str, name: str = "merged", step: int = STEP) -> DataFrame:
    """Add ``name``: the objects of two VARIANT columns joined at every depth, all else taken from ``over``.

    A null document leaves the other one; JSON null replaces like any value.
    """
    rows = materialize(df.withColumn("_text", _as_text(F.col(base), F.col(over))), "documents")
    whole = F.try_parse_json("_text")
    by_level = F.col(base).isNotNull() & F.col(over).isNotNull() & whole.isNull()
    quick = rows.where(~by_level).withColumn(name, F.coalesce(whole, over, base)).drop("_text")
    deep = rows.where(by_level).drop("_text")
    return quick if deep.isEmpty() else quick.unionByName(_merged_by_level(deep, base, over, name, step))


def _merged_by_level(rows: DataFrame, base: str, over: str, name: str, step: int) -> DataFrame:
    """``merge_documents`` for written rows, ``step`` levels at a time."""
    df, rows = rows, materialize(rows, "deep-documents").withColumn("_row", F.monotonically_increasing_id())
    folder = scratch_path(df.sparkSession, "pairs")
    first = rows.where(F.col(base).isNotNull() & F.col(over).isNotNull())
    first = first.select("_row", F.lit("").alias("path"), F.lit("").alias("parent"), F.col(base).alias("base"), F.col(over).alias("over"))
    levels = [_kept(first, f"{folder}/step=0")]
    while True:
        opened = pin(levels[-1], _open=_open_pairs(F.col("base"), F.col("over"), F.col("path"), step))
        opened = opened.select("_row", F.col("path").alias("parent"), F.explode("_open").alias("p")).select("_row", "p.path", "parent", "p.base", "p.over")
        opened = _kept(opened, f"{folder}/step={len(levels)}")
        if opened.isEmpty():
            break
        levels.append(opened)
    done = None
    for pairs in reversed(levels):
        if done is None:
            pairs = pairs.withColumn("_found", F.lit(None).cast("map<string,variant>"))
        else:
            # One group is what lies below one pair of objects.
            found = done.groupBy("_row", F.col("parent").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_found"))
            pairs = pairs.join(found, ["_row", "path"], "left")
        value = _merged(F.col("base"), F.col("over"), F.col("path"), step)
        done = materialize(pin(pairs, value=value).select("_row", "path", "parent", "value"), "merged")
    found = done.select(F.col("_row").alias("_of"), F.col("value").alias("_value"))
    whole = rows.join(found, F.col("_row") == F.col("_of"), "left")
    return whole.withColumn(name, F.coalesce("_value", over, base)).drop("_row", "_of", "_value")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
