"""JSON functions of the dialect. JSON values are their text; scalars are told from objects and arrays through variants."""

from __future__ import annotations

import re

from tessera.functions.expr import Expr, literal, quote, rule, template


def _path(p) -> str:
    """A path literal with quoted members in brackets, as Spark reads them."""
    v = literal(p) if p is not None else "$"
    if not isinstance(v, str):
        return str(p)
    v = re.sub(r'\."([^"]*)"', r"['\1']", v)
    v = re.sub(r'\["([^"]*)"\]', r"['\1']", v)
    return quote(v)


def _at(x: str, p: str) -> str:
    return f"try_variant_get(try_parse_json({x}), {p}, 'variant')"


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def query(x, p=None) -> str:
    """The text of a part; strings keep their quotes, and objects their members' order."""
    path = _path(p)
    v = _at(x, path)
    return f"(CASE WHEN {_kind(v)} LIKE 'OBJECT%' OR {_kind(v)} LIKE 'ARRAY%' THEN get_json_object({x}, {path}) ELSE to_json({v}) END)"


def value(x, p=None) -> str:
    """The text of a scalar part, else null."""
    path = _path(p)
    v = _at(x, path)
    return f"(CASE WHEN {_kind(v)} LIKE 'OBJECT%' OR {_kind(v)} LIKE 'ARRAY%' OR {_kind(v)} = 'VOID' THEN NULL ELSE get_json_object({x}, {path}) END)"


rule("JSON_EXTRACT", "JSON_QUERY", type="JSON")(query)
rule("JSON_EXTRACT_SCALAR", "JSON_VALUE", type="STRING")(value)
rule("JSON_EXTRACT_ARRAY", "JSON_QUERY_ARRAY", type="ARRAY")(lambda x, p=None: f"ts_json_items({query(x, p)})")
rule("JSON_EXTRACT_STRING_ARRAY", "JSON_VALUE_ARRAY", type="ARRAY")(lambda x, p=None: f"try_variant_get(try_parse_json({x}), {_path(p)}, 'array<string>')")


def subscript(e: Expr, k: Expr) -> Expr:
    v = literal(k)
    step = f"['{v}']" if isinstance(v, str) else f"[{v}]"
    return Expr(query(e, Expr("", "STRING", ("literal", "$" + step))), "JSON")


@rule("JSON_TYPE", type="STRING")
def json_type(x):
    k = _kind(f"parse_json({x})")
    return (
        f"(CASE WHEN {k} LIKE 'OBJECT%' THEN 'object' WHEN {k} LIKE 'ARRAY%' THEN 'array' WHEN {k} = 'STRING' THEN 'string' "
        f"WHEN {k} = 'BOOLEAN' THEN 'boolean' WHEN {k} = 'VOID' THEN 'null' WHEN {k} IS NOT NULL THEN 'number' END)"
    )


def text_of(x: Expr) -> str:
    """Any value as JSON text; fields that are null stay."""
    if x.type == "JSON":
        return str(x)
    wrapped = f"to_json(named_struct('v', {x}), map('ignoreNullFields', 'false'))"
    return f"substring({wrapped}, 6, length({wrapped}) - 6)"


rule("TO_JSON_STRING", type="STRING")(lambda x, pretty=None: text_of(x))
rule("TO_JSON", type="JSON")(lambda x, *_: text_of(x))
template("PARSE_JSON", "to_json(parse_json({0}))", "JSON")


@rule("PARSE_JSON", type="JSON")
def parse_json(x, *_):
    """The text itself, once it is known to parse."""
    return f"if(parse_json({x}) IS NULL, NULL, ts_json_compact({x}))"


@rule("JSON_OBJECT", type="JSON")
def json_object(*args):
    pairs = [f"to_json(named_struct('k', cast({k} AS string)))" for k in args[::2]]
    members = [f"concat(substring({p}, 6, length({p}) - 6), ':', coalesce({text_of(v)}, 'null'))" for p, v in zip(pairs, args[1::2])]
    return f"concat('{{', {', \',\', '.join(members)}, '}}')" if members else "'{}'"


@rule("JSON_ARRAY", type="JSON")
def json_array(*args):
    items = [f"coalesce({text_of(a)}, 'null')" for a in args]
    return f"concat('[', {', \',\', '.join(items)}, ']')" if items else "'[]'"


rule("JSON_SET", type="JSON")(lambda x, *args: f"ts_json_set({x}, array({', '.join(args[::2])}), array({', '.join(text_of(a) for a in args[1::2])}))")
rule("JSON_ARRAY_INSERT", type="JSON")(lambda x, *args: f"ts_json_array_insert({x}, array({', '.join(args[::2])}), array({', '.join(text_of(a) for a in args[1::2])}))")
rule("JSON_REMOVE", type="JSON")(lambda x, *paths: f"ts_json_remove({x}, array({', '.join(paths)}))")
template("JSON_STRIP_NULLS", "ts_json_strip_nulls({0})", "JSON")
template("JSON_KEYS", "array_sort(json_object_keys({0}))", "ARRAY")


def strict(x: str, spark: str) -> str:
    return f"variant_get(parse_json({x}), '$', '{spark}')"


rule("BOOL", type="BOOL")(lambda x: strict(x, "boolean"))
rule("INT64", type="INT64")(lambda x: strict(x, "bigint"))
rule("FLOAT64", "DOUBLE", type="FLOAT64")(lambda x, *_: strict(x, "double"))


def _lax(spark: str):
    return lambda x: f"try_cast(get_json_object({x}, '$') AS {spark})"


rule("LAX_BOOL", type="BOOL")(_lax("boolean"))
rule("LAX_FLOAT64", "LAX_DOUBLE", type="FLOAT64")(_lax("double"))
rule("LAX_STRING", type="STRING")(lambda x: value(x))


@rule("LAX_INT64", type="INT64")
def lax_int64(x):
    v = f"get_json_object({x}, '$')"
    return f"coalesce(try_cast({v} AS bigint), cast(round(try_cast({v} AS double)) AS bigint), cast(try_cast({v} AS boolean) AS bigint))"
