"""RANGE values as structs of start (inclusive) and end (exclusive); a null bound is unbounded."""

from __future__ import annotations

import re

from tessera.functions.expr import quote, rule, template
from tessera.functions.dates import _gap, interval

template("RANGE_START", "{0}.start")
template("RANGE_END", "{0}.end")
template("RANGE_CONTAINS_VALUE", "(({0}.start IS NULL OR {0}.start <= {1}) AND ({0}.end IS NULL OR {1} < {0}.end))", "BOOL")


@rule("RANGE", type="RANGE")
def range_(a, b):
    return f"named_struct('start', {a}, 'end', {b})"


def parsed(text: str, spark: str) -> str:
    m = re.fullmatch(r"\s*\[\s*(.+?)\s*,\s*(.+?)\s*\)\s*", text)
    if not m:
        raise TypeError("a RANGE literal is [start, end)")
    bounds = [f"cast({'NULL' if b.upper() in ('UNBOUNDED', 'NULL') else quote(b)} AS {spark})" for b in m.groups()]
    return f"named_struct('start', {bounds[0]}, 'end', {bounds[1]})"


def _overlap(a: str, b: str) -> str:
    return f"(({a}.start IS NULL OR {b}.end IS NULL OR {a}.start < {b}.end) AND ({b}.start IS NULL OR {a}.end IS NULL OR {b}.start < {a}.end))"


@rule("RANGE_CONTAINS", type="BOOL")
def range_contains(r, x):
    if x.type == "RANGE" or str(x).startswith("named_struct('start'"):
        return f"(({r}.start IS NULL OR ({x}.start IS NOT NULL AND {r}.start <= {x}.start)) AND ({r}.end IS NULL OR ({x}.end IS NOT NULL AND {x}.end <= {r}.end)))"
    return f"(({r}.start IS NULL OR {r}.start <= {x}) AND ({r}.end IS NULL OR {x} < {r}.end))"


rule("RANGE_OVERLAPS", type="BOOL")(_overlap)


@rule("RANGE_INTERSECT", type="RANGE")
def range_intersect(a, b):
    """greatest and least skip nulls, which is just what unbounded ends need of starts and ends."""
    return f"if({_overlap(a, b)}, named_struct('start', greatest({a}.start, {b}.start), 'end', least({a}.end, {b}.end)), NULL)"


@rule("GENERATE_RANGE_ARRAY", type="ARRAY<STRUCT>")
def generate_range_array(r, step, last=None):
    gap = interval(*_gap(step))
    whole = f"filter(sequence({r}.start, {r}.end, {gap}), _s -> _s < {r}.end)"
    if last is not None and str(last).upper() == "FALSE":
        whole = f"filter({whole}, _s -> _s + {gap} <= {r}.end)"
    return f"transform({whole}, _s -> named_struct('start', _s, 'end', least(cast(_s + {gap} AS date), {r}.end)))" if "date" in str(r) and "timestamp" not in str(r) else (
        f"transform({whole}, _s -> named_struct('start', _s, 'end', least(_s + {gap}, {r}.end)))"
    )


def sessionize_sql(args: list[str]) -> str:
    """RANGE_SESSIONIZE(table, range column, partition columns[, mode]): gaps and islands by two windows.

    MEETS (the default) joins ranges that touch, OVERLAPS only such as share a moment. A null range has a null
    session, and one in a partition bridges all of that partition's other ranges.
    """
    from tessera.functions.expr import literal

    table, column = args[0], str(literal(args[1]))
    keys = [str(literal(e)) for e in args[2].part[1]] if len(args) > 2 and getattr(args[2], "part", None) else []
    mode = str(literal(args[3])).upper() if len(args) > 3 else "MEETS"
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    order = f"ORDER BY `{column}`.start NULLS FIRST, `{column}`.end NULLS FIRST"
    breaks = ">" if mode == "MEETS" else ">="
    far = "coalesce({c}.end, cast('9999-12-31' AS date))".format(c=f"`{column}`")
    inner = (
        f"SELECT *, max(if(`{column}` IS NULL, NULL, {far})) OVER ({part}{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _reach, "
        f"max(`{column}` IS NULL) OVER ({part.strip()}) AS _bridge FROM {table}"
    )
    marked = (
        f"SELECT *, sum(CASE WHEN `{column}` IS NULL OR _bridge THEN 0 WHEN _reach IS NULL OR (`{column}`.start IS NOT NULL AND `{column}`.start {breaks} _reach) THEN 1 ELSE 0 END) "
        f"OVER ({part}{order} ROWS UNBOUNDED PRECEDING) AS _session FROM ({inner})"
    )
    own = f"PARTITION BY {', '.join([*[f'`{k}`' for k in keys], '_session'])}"
    return (
        f"(SELECT * EXCEPT (_reach, _bridge, _session), if(`{column}` IS NULL, NULL, named_struct("
        f"'start', if(max(if(`{column}` IS NOT NULL AND `{column}`.start IS NULL, 1, 0)) OVER ({own}) = 1, NULL, min(`{column}`.start) OVER ({own})), "
        f"'end', if(max(if(`{column}` IS NOT NULL AND `{column}`.end IS NULL, 1, 0)) OVER ({own}) = 1, NULL, max(`{column}`.end) OVER ({own})))) AS session_range FROM ({marked}))"
    )
