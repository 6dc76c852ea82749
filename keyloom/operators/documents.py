"""JSON document commands over jd(key, doc); a path is one field of the root object, doc a JSON text.

Setters rebuild the root object from its fields as a map of JSON texts, so values of other fields stay as they are
written. Defined cases: a document that isn't an object, or null, stays; getters give null for a missing field or one of
another type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(field: str) -> Column:
    return F.schema_of_variant(F.variant_get(F.try_parse_json("doc"), f"$['{field}']", "variant"))


def _raw(field: str) -> Column:
    """JSON text of the field's value."""
    return F.to_json(F.variant_get(F.try_parse_json("doc"), f"$['{field}']", "variant"))


def _is_object() -> Column:
    return F.schema_of_variant(F.try_parse_json("doc")).startswith("OBJECT")


def _object(fields: Column) -> Column:
    """fields: array of (key, value) with JSON texts as values."""
    quoted = lambda k: F.substring(F.to_json(F.array(k)), 2, 1 << 30)  # noqa: E731 - ["k"] without its first bracket
    name = lambda k: F.regexp_replace(quoted(k), r"\]$", "")
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda e: F.concat(name(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def _entries() -> Column:
    """The root's fields in order of their names."""
    names = F.array_sort(F.json_object_keys("doc"))
    held = F.expr("try_variant_get(try_parse_json(doc), '$', 'map<string, variant>')")
    return F.transform(names, lambda k: F.struct(k.alias("key"), F.to_json(F.element_at(held, k)).alias("value")))


def _with(field: str, value: Column | None) -> Column:
    others = F.filter(_entries(), lambda e: e["key"] != field)
    if value is not None:
        others = F.array_sort(F.concat(others, F.array(F.struct(F.lit(field).alias("key"), value.alias("value")))))
    return F.when(_is_object(), _object(others)).otherwise(F.col("doc"))


def json_set(jd: DataFrame, field: str, value: str, only: str = "") -> DataFrame:
    """value: JSON text. only: "NX" where the field is missing, "XX" where it exists."""
    there = _raw(field).isNotNull()
    may = {"": F.lit(True), "NX": ~there, "XX": there}[only]
    return jd.select("key", F.when(may, _with(field, F.lit(value))).otherwise(F.col("doc")).alias("doc"))


def json_del(jd: DataFrame, field: str) -> DataFrame:
    return jd.select("key", _with(field, None).alias("doc"))


def json_toggle(jd: DataFrame, field: str) -> DataFrame:
    turned = F.when(_raw(field) == "true", "false").when(_raw(field) == "false", "true")
    return jd.select("key", F.when(turned.isNotNull(), _with(field, turned)).otherwise(F.col("doc")).alias("doc"))


def json_clear(jd: DataFrame, field: str) -> DataFrame:
    """Objects and arrays become empty, numbers 0; other values stay."""
    kind = _kind(field)
    empty = F.when(kind.startswith("OBJECT"), "{}").when(kind.startswith("ARRAY"), "[]").when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT"), "0")
    return jd.select("key", F.when(empty.isNotNull(), _with(field, empty)).otherwise(F.col("doc")).alias("doc"))


def json_arrappend(jd: DataFrame, field: str, value: str) -> DataFrame:
    """value: JSON text; fields that aren't arrays stay."""
    raw = _raw(field)
    longer = F.when(raw == "[]", F.lit(f"[{value}]")).otherwise(F.concat(F.regexp_replace(raw, r"\]$", ""), F.lit(f",{value}]")))
    return jd.select("key", F.when(_kind(field).startswith("ARRAY"), _with(field, longer)).otherwise(F.col("doc")).alias("doc"))


def json_arrlen(jd: DataFrame, field: str) -> DataFrame:
    return jd.select("key", F.when(_kind(field).startswith("ARRAY"), F.json_array_length(_raw(field))).cast("long").alias("n"))


def json_strlen(jd: DataFrame, field: str) -> DataFrame:
    """Characters of a string."""
    return jd.select("key", F.when(_kind(field) == "STRING", F.length(F.variant_get(F.try_parse_json("doc"), f"$['{field}']", "string"))).cast("long").alias("n"))


def json_objkeys(jd: DataFrame) -> DataFrame:
    return jd.select("key", F.explode(F.json_object_keys("doc")).alias("field"))


def json_mget(jd: DataFrame, wanted: DataFrame, field: str) -> DataFrame:
    """wanted: ord, key. The field of each, null where there is none."""
    return wanted.join(jd, "key", "left").select("ord", "key", _raw(field).alias("value"))
