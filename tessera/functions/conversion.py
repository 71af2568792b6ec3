"""Casts, typed literals and conditional functions."""

from __future__ import annotations

import json

from tessera.functions.expr import Expr, quote, rule, same, template

same("coalesce ifnull nullif")
template("IF", "if({0}, {1}, {2})")
template("PARSE_NUMERIC", "cast(regexp_replace({0}, '[ ,]', '') AS decimal(38,9))", "NUMERIC")
template("PARSE_BIGNUMERIC", "cast(regexp_replace({0}, '[ ,]', '') AS decimal(38,18))", "BIGNUMERIC")


@rule("COALESCE")
def coalesce(*args):
    return Expr(f"coalesce({', '.join(args)})", next((a.type for a in args if a.type), None))


@rule("IFNULL")
def ifnull(a, b):
    return Expr(f"coalesce({a}, {b})", a.type or b.type)


@rule("NULLIF")
def nullif(a, b):
    return Expr(f"nullif({a}, {b})", a.type)


@rule("IF")
def if_(c, a, b):
    return Expr(f"if({c}, {a}, {b})", a.type or b.type)


def typed_literal(name: str, text: str) -> Expr:
    if name == "DATE":
        return Expr(f"date{quote(_padded_date(text))}", "DATE", ("literal", text))
    if name == "DATETIME":
        return Expr(f"timestamp_ntz{quote(_padded_date(text.replace('T', ' ')))}", "DATETIME", ("literal", text))
    if name == "TIMESTAMP":
        return Expr(f"timestamp{quote(_padded_date(text))}", "TIMESTAMP", ("literal", text))
    if name == "TIME":
        return Expr(f"cast({quote(text)} AS time(6))", "TIME", ("literal", text))
    if name == "JSON":
        return Expr(quote(json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)), "JSON", ("literal", text))
    scale = 9 if name == "NUMERIC" else 18
    return Expr(f"cast({quote(text)} AS decimal(38,{scale}))", name, ("literal", text))


def _padded_date(text: str) -> str:
    day, sep, rest = text.partition(" ")
    parts = day.split("-")
    if len(parts) == 3 and all(p.isdigit() for p in parts):
        day = f"{int(parts[0]):04d}-{int(parts[1]):02d}-{int(parts[2]):02d}"
    return day + sep + rest


def cast(e: Expr, name: str, spark: str, safe: bool, pattern: str | None) -> str:
    f = "try_cast" if safe else "cast"
    if pattern is not None:
        from tessera.functions import dates

        if name == "STRING":
            return f"date_format({e}, {quote(dates.cast_format(pattern))})"
        return f"{f}(to_timestamp_ntz({e}, {quote(dates.cast_format(pattern))}) AS {spark})"
    if name == "INT64" and e.type in ("FLOAT64", "NUMERIC", "BIGNUMERIC"):
        return f"{f}(round({e}) AS bigint)"  # halves away from zero, not towards it
    if e.type is None and name in ("INT64", "STRING"):  # a column: typeof is constant, so only one branch is left in the plan
        text = f"cast({e} AS string)"
        if name == "INT64":
            return f"(CASE WHEN typeof({e}) IN ('double', 'float') OR typeof({e}) LIKE 'decimal%' THEN {f}(round({f}({text} AS decimal(38,9))) AS bigint) ELSE {f}({e} AS bigint) END)"
        return f"(CASE WHEN typeof({e}) IN ('double', 'float') THEN ts_float_text(try_cast({text} AS double)) WHEN typeof({e}) LIKE 'decimal%' THEN ts_decimal_text({text}) ELSE {text} END)"
    if name == "INT64" and e.type == "STRING":
        return f"(CASE WHEN lower(trim({e})) LIKE '0x%' THEN {f}(conv(substring(trim({e}), 3), 16, 10) AS bigint) ELSE {f}({e} AS bigint) END)"
    if name == "STRING" and e.type == "INTERVAL":
        from tessera.functions import dates

        return dates.interval_string(e)
    if name == "STRING" and e.type == "FLOAT64":
        return f"ts_float_text({e})"
    if name == "STRING" and e.type == "TIMESTAMP":
        return f"concat({_trimmed_text(e)}, '+00')"
    if name == "STRING" and e.type == "BYTES":  # bytes that are no UTF-8 are an error
        return f"{'try_' if safe else ''}validate_utf8(cast({e} AS string))"
    if name == "STRING" and e.type in ("NUMERIC", "BIGNUMERIC"):
        return f"ts_decimal_text(cast({e} AS string))"
    if name == "INTERVAL":
        return f"{e}"
    if name in ("NUMERIC", "BIGNUMERIC") and e.type == "FLOAT64":
        return f"{f}({e} AS {spark})"
    if name == "TIME" and e.type in ("DATETIME", "TIMESTAMP"):
        return f"{f}(date_format({e}, 'HH:mm:ss.SSSSSS') AS time(6))"
    return f"{f}({e} AS {spark})"


def _trimmed_text(e: str) -> str:
    """No, three or six digits of a second, as many as it takes."""
    return f"regexp_replace(date_format({e}, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '[.]000000$|(?<=[.][0-9]{{3}})000$', '')"


def safe(e: Expr) -> str:
    """SAFE.f(...): null where f fails; only Spark's own try forms can do that inside an expression."""
    text = str(e)
    for name, tried in (("cast(", "try_cast("), ("to_date(", "try_to_date("), ("to_timestamp(", "try_to_timestamp("), ("parse_json(", "try_parse_json("), ("element_at(", "try_element_at("), ("unhex(", "try_unhex("), ("substring(", "substring(")):
        if text.startswith(name):
            return tried + text[len(name) :]
    if "raise_error(" in text:
        import re

        return re.sub(r"raise_error\('[^']*'\)", "NULL", text)
    return text
