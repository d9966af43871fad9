"""Answers of an API as typed columns, field by field, and a report of fields that have changed their type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOUND = "array<struct<field: string, wanted: string, found: string, lost: boolean>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use refers to it. An expression that is only referred to again is worked out again each time, and all that it is made of with it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))  # noqa: PLW0108 - transform counts the parameters


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; VOID for a null one, null for a missing one."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _get(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$['{name}']", kind)


def _typed(value: Column, kind: T.DataType) -> Column:
    """The value has to be cheap to refer to: a column, or the variable of _once or of a transform."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_once(_get(value, f.name), lambda x, f=f: _typed(x, f.dataType)).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _typed(x, kind.elementType))
    plain = F.try_variant_get(value, "$", kind.simpleString())
    return F.when(~_kind(value).isin("OBJECT", "ARRAY"), plain) if isinstance(kind, T.StringType) else plain


def typed(body: Column, schema: str) -> Column:
    """A JSON object as a struct. A field of another type than the schema's is read if it can be converted, else null; all other fields stay. Null, broken and other texts give null.

    What no variant can hold (repeated keys, texts beyond its size) is parsed by the schema instead.
    """
    kind = T.StructType.fromDDL(schema)
    return _once(F.try_parse_json(body), lambda value: F.when(_kind(value) == "OBJECT", _typed(value, kind).cast(kind)).when(value.isNull(), F.from_json(body, schema)))


def _wrong(value: Column, kind: T.DataType, path: str) -> Column:
    """The fields of one value that aren't of their type; a null is of every type. The value has to be cheap to refer to, as for _typed."""
    if isinstance(kind, T.StructType):
        wanted, inner = "OBJECT", F.concat(*[_once(_get(value, f.name), lambda x, f=f: _wrong(x, f.dataType, f"{path}.{f.name}" if path else f.name)) for f in kind])
    elif isinstance(kind, T.ArrayType):
        wanted, inner = "ARRAY", F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _wrong(x, kind.elementType, f"{path}[]")))
    else:
        wanted, inner = {"int": "BIGINT"}.get(kind.simpleString(), kind.simpleString().upper()), None
    lost = F.lit(True) if inner is not None else _typed(value, kind).isNull()
    none = F.array().cast(_FOUND)

    def of(found: Column) -> Column:
        here = F.array(F.struct(F.lit(path).alias("field"), F.lit(wanted).alias("wanted"), found.alias("found"), lost.alias("lost")))
        return F.when(found == wanted, F.coalesce(inner, none) if inner is not None else none).when(found != "VOID", here).otherwise(none)

    return _once(_kind(value), of)


def drift(rows: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """field, wanted, found, n values that aren't of the schema's type, and n_lost of them that can't be converted; the field '' is a body that is no object, found BROKEN one that is no JSON. Null bodies aren't counted."""
    broken = F.array(F.struct(F.lit("").alias("field"), F.lit("OBJECT").alias("wanted"), F.lit("BROKEN").alias("found"), F.lit(True).alias("lost"))).cast(_FOUND)
    wrong = _once(F.try_parse_json(body), lambda value: F.when(value.isNull(), broken).otherwise(_wrong(value, T.StructType.fromDDL(schema), "")))
    each = rows.filter(F.col(body).isNotNull()).select(F.explode(wrong).alias("w")).select("w.*")
    return each.groupBy("field", "wanted", "found").agg(F.count("*").alias("n"), F.count_if("lost").alias("n_lost"))
