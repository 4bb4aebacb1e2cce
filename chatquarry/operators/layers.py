"""Settings held in rows: layers of JSON resolved field by field, budgets that follow, groups that must agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where no layer has a value.
FALLBACK = "fallback"


def resolve(rows: DataFrame, layers: Mapping[str, Column], fields: Mapping[str, tuple[str, object]]) -> DataFrame:
    """rows with a column for each field, `<field>_from` with the layer it comes from, and malformed array<string>.

    layers are JSON texts by name, the one that goes first first; fields are name: (type, fallback). A value counts
    if its layer is a JSON object that has it, not null, and it can be cast to the type. malformed names the layers
    that are no JSON object, though not null. Each text is parsed once, as a VARIANT. The names of fields must not be
    columns of rows.
    """
    out = rows
    for k, text in enumerate(layers.values()):
        out = out.withColumn(f"__layer{k}", F.try_parse_json(text)).withColumn(f"__bad{k}", text.isNotNull() & ~F.coalesce(F.startswith(F.schema_of_variant(f"__layer{k}"), F.lit("OBJECT")), F.lit(False)))
    found: dict[str, Column] = {}
    for field, (kind, default) in fields.items():
        each = [F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(name).alias("from"))) for k, name in enumerate(layers) for value in [F.when(~F.col(f"__bad{k}"), F.try_variant_get(f"__layer{k}", f"$.{field}", kind))]]
        found[f"__{field}"] = F.coalesce(*each, F.struct(F.lit(default).cast(kind).alias("value"), F.lit(FALLBACK).alias("from")))
    out = out.withColumns(found)
    bad = F.array_compact(F.array(*[F.when(F.col(f"__bad{k}"), F.lit(name)) for k, name in enumerate(layers)])) if layers else F.array().cast("array<string>")
    shown = [c for f in fields for c in (F.col(f"__{f}.value").alias(f), F.col(f"__{f}.from").alias(f"{f}_from"))]
    return out.select(*rows.columns, *shown, bad.alias("malformed"))


def context_caps(caps: Mapping[str, tuple[int, int]], mode: Column, model_len: Column, new_tokens: Column) -> Column:
    """struct<model_len, new_tokens>: those of the row's mode, each overridden alone; null for an unknown mode without override."""
    known = F.create_map(*[F.lit(x) for name, two in caps.items() for x in (name, F.struct(F.lit(two[0]).alias("a"), F.lit(two[1]).alias("b")))])  # type: ignore[arg-type]
    of = F.try_element_at(known, mode)
    return F.struct(F.coalesce(model_len, of["a"]).cast("int").alias("model_len"), F.coalesce(new_tokens, of["b"]).cast("int").alias("new_tokens"))


def beyond(budget: Column, limits: Mapping[str, Column]) -> Column:
    """The names of the limits that a budget is over, in order: array<string>; null limits are none."""
    return F.array_compact(F.array(*[F.when(budget > most, F.lit(name)) for name, most in limits.items()]))


def disagreements(settings: DataFrame, name: str, fields: Sequence[str], sets: Sequence[str] = ()) -> DataFrame:
    """(name, field, only_first, only_here) wherever a row's settings differ from those of the row with the smallest name.

    Plain fields compare null-safely, as text; fields of sets (arrays of strings, in any order) show what only one
    side has, both ways. A row a group is expected; the first is found by a partial minimum and sent to all.
    """
    text = lambda c: F.col(c).cast("string")
    whole = settings.select(F.col(name).cast("string").alias("name"), *[F.array_compact(F.array(text(f))).alias(f) for f in fields], *[F.array_distinct(F.coalesce(F.col(f), F.array().cast("array<string>"))).alias(f) for f in sets])
    first = whole.agg(F.min_by(F.struct(*fields, *sets), "name").alias("__first"))
    sides = [F.struct(F.lit(f).alias("field"), F.sort_array(F.array_except(F.col(f"__first.{f}"), f)).alias("only_first"), F.sort_array(F.array_except(f, F.col(f"__first.{f}"))).alias("only_here")) for f in (*fields, *sets)]
    each = whole.crossJoin(F.broadcast(first)).select("name", F.inline(F.array(*sides)))  # one row
    return each.where((F.size("only_first") > 0) | (F.size("only_here") > 0)).withColumnRenamed("name", name)


def unbalanced(rows: DataFrame, key: str, weight: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, total) of the groups whose weights don't sum to one; null weights count as none."""
    total = rows.groupBy(key).agg(F.coalesce(F.sum(F.col(weight).cast("double")), F.lit(0.0)).alias("total"))
    return total.where(F.abs(F.col("total") - 1) > tolerance)
