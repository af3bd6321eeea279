"""Looking into JSON values: kinds, dotted paths, sizes and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import registry as R

#: Names of kinds by the head of Spark's name of a variant's type.
KINDS = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "VOID": "null", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float"}


def parsed(text: Column) -> Column:
    """A variant; null for what is no JSON."""
    return F.try_parse_json(text)


def parsed_whole(text: Column) -> Column:
    """A variant; null also where more follows behind the first value, which parsed() lets pass.

    In brackets the text must be one element, and in an object one value: what
    follows a value cannot close both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(one & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), F.try_parse_json(text))


def kind(value: Column) -> Column:
    """dict, list, str, bool, null, int or float; null where there is no value."""
    return R.mapped(KINDS, F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1))


def navigate(value: Column, path: str) -> Column:
    """The value at a dotted path of keys and indices; null where the path leads nowhere, as negative indices do.

    A segment of digits is an index in a list and a key in an object.
    """
    out = value
    for segment in path.split("."):
        key = "['" + segment.replace("\\", "\\\\").replace("'", "\\'") + "']"
        own = F.try_variant_get(out, "$" + key, "variant")
        out = F.coalesce(F.try_variant_get(out, f"$[{int(segment)}]", "variant"), own) if segment.isdigit() else own
    return out


def size(text: Column) -> Column:
    """Keys of an object, elements of a list; null for anything else."""
    return F.coalesce(F.size(F.json_object_keys(text)), F.json_array_length(text))


def element_kinds(value: Column) -> Column:
    """Map of an object's keys to the kinds of their values."""
    return F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: kind(v))


def first_list_key(text: Column) -> Column:
    """The first key, in the order of the text, whose value is a list."""
    kinds = element_kinds(parsed(text))
    return F.get(F.filter(F.json_object_keys(text), lambda k: F.try_element_at(kinds, k) == "list"), F.lit(0))
