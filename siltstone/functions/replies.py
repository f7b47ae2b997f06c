"""Reading a language model's reply: JSON in prose or fences, truthiness, text fields.

VARIANT keeps the types of JSON values, which ``from_json`` would turn into text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(raw: Column) -> Column:
    """Without ``` marks and the language name after them."""
    return F.regexp_replace(raw, r"(?i)```(?:json)?\s*", "")


def json_object(raw: Column) -> Column:
    """From the first { to the last }, parsed; null if that is no object."""
    got = F.try_parse_json(F.nullif(F.regexp_extract(unfenced(raw), r"(?s)\{.*\}", 0), F.lit("")))
    return F.when(F.schema_of_variant(got).startswith("OBJECT"), got)


def json_array(raw: Column) -> Column:
    """From the first [ to the last ], parsed; null if that is no array."""
    got = F.try_parse_json(F.nullif(F.regexp_extract(unfenced(raw), r"(?s)\[.*\]", 0), F.lit("")))
    return F.when(F.schema_of_variant(got).startswith("ARRAY"), got)


def first_flat_object(raw: Column) -> Column:
    """The first {...} without inner braces, parsed; null if it does not parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"\{[^{}]*\}", 0), F.lit("")))


def elements(array: Column) -> Column:
    """A variant array as array<variant>; null as an empty array."""
    return F.coalesce(F.try_variant_get(array, "$", "array<variant>"), F.expr("array()").cast("array<variant>"))


def strings(raw: Column) -> Column:
    """The non-blank strings of a JSON array; other elements and broken replies give none. Stripped."""
    texts = F.filter(elements(json_array(raw)), lambda v: F.schema_of_variant(v) == "STRING")
    return F.filter(F.transform(texts, lambda v: F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def texts(raw: Column) -> Column:
    """The elements of a JSON array as text, blanks dropped; null where no array was found."""
    got = json_array(raw)
    cleaned = F.transform(elements(got), lambda v: F.regexp_replace(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("None")), r"(?U)^\s+|\s+$", ""))
    return F.when(got.isNotNull(), F.filter(cleaned, lambda s: s != ""))


def truthy(v: Column) -> Column:
    """As a scripting language would: false for missing, null, false, 0, "" and empty containers; "false" is true."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
        .otherwise(F.try_variant_get(v, "$", "double") != 0)
    )


def text_field(v: Column, path: str) -> Column:
    """A field as stripped text; missing gives "", JSON null gives "None"."""
    got = F.try_variant_get(v, path, "variant")
    text = F.when(F.schema_of_variant(got) == "VOID", F.lit("None")).otherwise(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def number_field(v: Column, path: str, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string").try_cast("double"), F.lit(otherwise))


def passage(raw: Column) -> Column:
    """A hypothetical passage without a leading or trailing fence, stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), r"^```[A-Za-z]*(?U)\s*", ""), r"(?U)\s*```$", "")
