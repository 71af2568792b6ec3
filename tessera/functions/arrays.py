"""Array functions of the dialect as Spark SQL."""

from __future__ import annotations

from tessera.functions.expr import Expr, rule, template

template("ARRAY_LENGTH", "cast(array_size({0}) AS bigint)", "INT64")
template("ARRAY_REVERSE", "reverse({0})", "ARRAY")
template("ARRAY_FIRST", "element_at({0}, 1)")
template("ARRAY_LAST", "element_at({0}, -1)")
template("ARRAY_IS_DISTINCT", "(size({0}) = size(array_distinct({0})))", "BOOL")
template("FLATTEN", "flatten({0})", "ARRAY")


@rule("ARRAY_CONCAT", type="ARRAY")
def array_concat(*args):
    return f"concat({', '.join(args)})"


@rule("ARRAY_TO_STRING", type="STRING")
def array_to_string(x, by, null=None):
    return f"array_join({x}, {by}{f', {null}' if null else ''})"


@rule("GENERATE_ARRAY", type="ARRAY")
def generate_array(a, b, step="1L"):
    """A step against the direction gives an empty array where Spark's sequence fails."""
    if any(getattr(x, "type", None) == "FLOAT64" for x in (a, b, step)):
        n = f"cast(floor((({b}) - ({a})) / ({step}) + 1e-9) AS int)"
        return f"if({n} < 0, cast(array() AS array<double>), transform(sequence(0, greatest({n}, 0)), _i -> cast({a} AS double) + _i * ({step})))"
    return f"if(({step} > 0 AND {a} > {b}) OR ({step} < 0 AND {a} < {b}), filter(array({a}), _x -> false), sequence({a}, {b}, {step}))"


def element(e: Expr, how: str, k: Expr) -> str:
    if how == "OFFSET":
        return f"{e}[cast({k} AS int)]"
    if how == "ORDINAL":
        return f"element_at({e}, cast({k} AS int))"
    if how == "SAFE_OFFSET":
        return f"get({e}, cast({k} AS int))"
    return f"get({e}, cast({k} AS int) - 1)"


def from_query(inner: str) -> str:
    """ARRAY(subquery): the one column's values, nulls too; an empty query gives an empty array."""
    return f"(SELECT transform(collect_list(named_struct('c', __c)), _z -> _z.c) FROM ({inner}) AS __t(__c))"
