"""Aggregate and window functions of the dialect as Spark SQL."""

from __future__ import annotations

from collections.abc import Callable

#: name -> f(args, distinct, order, limit, nulls, having, windowed) -> (Spark SQL, type)
AGGREGATES: dict[str, Callable[..., tuple]] = {}


def _add(*names: str):
    def keep(f):
        for n in names:
            AGGREGATES[n] = f
        return f

    return keep


def _simple(spark: str, kind: str | None = None, text: str = "{f}({d}{x})"):
    def agg(args, distinct=False, having=None, **_):
        d = "DISTINCT " if distinct else ""
        if having:
            how, key = having
            f = "max_by" if how == "MAX" else "min_by"
            return f"{f}({args[0]}, {key})", kind
        return text.format(f=spark, d=d, x=", ".join(args)), kind or (args[0].type if args else None)

    return agg


for _n, _s, _k in (
    ("SUM", "sum", None), ("MAX", "max", None), ("MIN", "min", None), ("BIT_AND", "bit_and", "INT64"), ("BIT_OR", "bit_or", "INT64"), ("BIT_XOR", "bit_xor", "INT64"),
    ("LOGICAL_AND", "bool_and", "BOOL"), ("LOGICAL_OR", "bool_or", "BOOL"), ("CORR", "corr", "FLOAT64"), ("COVAR_POP", "covar_pop", "FLOAT64"), ("COVAR_SAMP", "covar_samp", "FLOAT64"),
    ("STDDEV", "stddev_samp", "FLOAT64"), ("STDDEV_SAMP", "stddev_samp", "FLOAT64"), ("STDDEV_POP", "stddev_pop", "FLOAT64"), ("VAR_POP", "var_pop", "FLOAT64"),
    ("VAR_SAMP", "var_samp", "FLOAT64"), ("VARIANCE", "var_samp", "FLOAT64"), ("COUNTIF", "count_if", "INT64"), ("COUNT", "count", "INT64"),
    ("MAX_BY", "max_by", None), ("MIN_BY", "min_by", None),
):
    AGGREGATES[_n] = _simple(_s, _k)
AGGREGATES["GROUPING"] = _simple("grouping", "INT64", "cast({f}({x}) AS bigint)")


@_add("AVG")
def avg(args, distinct=False, **_):
    x = args[0]
    text = f"avg({'DISTINCT ' if distinct else ''}{x})"
    return (f"cast({text} AS decimal(38,9))", "NUMERIC") if x.type == "NUMERIC" else (text, "FLOAT64")


@_add("ANY_VALUE")
def any_value(args, having=None, **_):
    if having:
        return f"{'max_by' if having[0] == 'MAX' else 'min_by'}({args[0]}, {having[1]})", args[0].type
    return f"any_value({args[0]})", args[0].type


def _before(keys: list[tuple[str, bool]]) -> str:
    """A comparator over structs _l and _r with fields k0, k1...; nulls come first ascending, last descending."""
    text = "0"
    for i in reversed(range(len(keys))):
        a, b = f"_l.k{i}", f"_r.k{i}"
        if keys[i][1]:
            a, b = b, a
        text = f"CASE WHEN {a} <=> {b} THEN {text} WHEN {a} IS NULL THEN -1 WHEN {b} IS NULL THEN 1 WHEN {a} < {b} THEN -1 ELSE 1 END"
    return f"(_l, _r) -> {text}"


def _gathered(x: str, distinct: bool, order, limit, skip_nulls: bool) -> str:
    """The values as an array, in order; structs keep nulls, which Spark's own lists drop."""
    keys = "".join(f", 'k{i}', {k}" for i, (k, _) in enumerate(order or []))
    collect = "collect_set" if distinct else "collect_list"
    text = f"{collect}(named_struct('v', {x}{keys}))"
    if skip_nulls:
        text = f"{collect}(if(({x}) IS NULL, NULL, named_struct('v', {x}{keys})))"
    if order:
        text = f"array_sort({text}, {_before(order)})"
    if limit:
        text = f"slice({text}, 1, {limit})"
    return f"transform({text}, _z -> _z.v)"


@_add("ARRAY_AGG")
def array_agg(args, distinct=False, order=None, limit=None, nulls=None, windowed=False, **_):
    text = _gathered(str(args[0]), distinct, order, limit, nulls == "IGNORE")
    if windowed:
        return text, "ARRAY"
    return f"nullif({text}, filter({text}, _z -> false))", "ARRAY"


@_add("ARRAY_CONCAT_AGG")
def array_concat_agg(args, order=None, limit=None, **_):
    return f"flatten({_gathered(str(args[0]), False, order, limit, True)})", "ARRAY"


@_add("STRING_AGG")
def string_agg(args, distinct=False, order=None, limit=None, **_):
    by = args[1] if len(args) > 1 else "','"
    x = str(args[0])
    text = _gathered(x, distinct, order, limit, True)
    return f"if(count({x}) = 0, NULL, array_join({text}, {by}))", args[0].type or "STRING"


@_add("APPROX_COUNT_DISTINCT")
def approx_count_distinct(args, **_):
    """Exact, so that results can be compared; engine option ``sketches`` turns to HyperLogLog++."""
    return (f"approx_count_distinct({args[0]})" if SKETCHES else f"count(DISTINCT {args[0]})"), "INT64"


#: Set for tables so large that exact distinct counts cost too much.
SKETCHES = False


@_add("APPROX_QUANTILES")
def approx_quantiles(args, distinct=False, **_):
    """Exact discrete quantiles; with ``SKETCHES`` within 1/10000 of the ranks."""
    n = int(str(args[1]).removesuffix("L"))
    x = f"{'DISTINCT ' if distinct else ''}{args[0]}"
    if SKETCHES:
        steps = ", ".join(f"{k / n!r}D" for k in range(n + 1))
        return f"percentile_approx({x}, array({steps}), 10000)", "ARRAY"
    rank = f"cast(greatest(1L, (_k * size(_l) + {n - 1}L) div {n}L) AS int)"
    picked = f"transform(array(array_sort(collect_list({x}))), _l -> transform(sequence(0L, {n}L), _k -> element_at(_l, {rank})))[0]"
    return f"if(count({args[0]}) = 0, NULL, {picked})", "ARRAY"


#: Values that APPROX_TOP_COUNT's sketch tracks in a group; it is exact up to three quarters of them.
TRACKED = 100_000
#: Different values of a group, as estimated, beyond which :func:`exact_top_count` counts them. The sketch lists twice as many,
#: so an estimate that is five in a hundred off leaves it far from its limits.
LISTED = 5_000


def _largest(items: str, by: str, n: str) -> str:
    """The first n of an array of structs (value, by): the largest first, of equals the least value."""
    order = f"(_l, _r) -> CASE WHEN _l.{by} > _r.{by} THEN -1 WHEN _l.{by} < _r.{by} THEN 1 WHEN _l.value < _r.value THEN -1 WHEN _l.value > _r.value THEN 1 ELSE 0 END"
    return f"slice(array_sort({items}, {order}), 1, {n})"


@_add("APPROX_TOP_COUNT")
def approx_top_count(args, **_):
    """By a sketch that is merged from the tasks' own, so that no group is gathered; values keep their type."""
    x, n = args[0], str(args[1]).removesuffix("L")
    counted = f"transform(filter(approx_top_k({x}, {max(int(n), 10_000)}, {TRACKED}), _t -> _t.item IS NOT NULL), _t -> named_struct('value', _t.item, 'count', _t.count))"
    return _largest(counted, "count", n), "ARRAY<STRUCT>"


def exact_top_count(args, source: str, keys: list[str]) -> str:
    """The first n from counts of every value, or null if no group of the source (FROM and WHERE) has more than ``LISTED``.

    Counts and ranks are merged from the tasks' own, so that no group is gathered; only n values of each are.
    """
    x, n = args[0], str(args[1]).removesuffix("L")
    held = [f"_g{k}" for k in range(len(keys))]
    names = ", ".join(held)
    first, group, part = (f"{names}, ", f" GROUP BY {names}", f"PARTITION BY {names} ") if keys else ("", "", "")
    rows = f"SELECT {''.join(f'({e}) AS {h}, ' for e, h in zip(keys, held))}({x}) AS _x{source}"
    many = f"(SELECT max(_d) > {LISTED} FROM (SELECT approx_count_distinct(_x) AS _d FROM ({rows}){group}))"
    counted = f"SELECT {first}_x, count(*) AS _n FROM ({rows}) WHERE _x IS NOT NULL AND {many} GROUP BY {first}_x"
    ranked = f"SELECT *, row_number() OVER ({part}ORDER BY _n DESC, _x) AS _r FROM ({counted})"
    listed = _largest("collect_set(named_struct('value', _x, 'count', _n))", "count", n)
    top = f"SELECT {first}if(count(*) = 0, NULL, {listed}) AS _top FROM ({ranked}) WHERE _r <= {n}{group}"
    own = f" WHERE {' AND '.join(f'{h} <=> ({e})' for e, h in zip(keys, held))}" if keys else ""
    return f"any_value((SELECT any_value(_top) FROM ({top}){own}))"


@_add("APPROX_TOP_SUM")
def approx_top_sum(args, **_):
    """True weights: the sums of a group's values; values keep their type. One pass over the sorted rows of a group."""
    x, w, n = args[0], args[1], str(args[2]).removesuffix("L")
    rows = f"array_sort(collect_list(if(({x}) IS NULL, NULL, named_struct('v', {x}, 'w', cast({w} AS double)))))"
    # the places where a value begins, then each value's stretch of the rows
    starts = "filter(transform(_rows, (_e, _i) -> if(_i = 0 OR _e.v <> _rows[_i - 1].v, _i, -1)), _i -> _i >= 0)"
    summed = (
        "transform(_starts, (_at, _k) -> named_struct('value', _rows[_at].v, 'sum', "
        "aggregate(slice(_rows, _at + 1, coalesce(get(_starts, _k + 1), size(_rows)) - _at), 0D, (_s, _e) -> _s + coalesce(_e.w, 0D))))"
    )
    # names for the arrays, as Spark SQL has no LET: a transform over an array of one
    inner = f"transform(array({starts}), _starts -> {_largest(summed, 'sum', n)})[0]"
    return f"transform(array({rows}), _rows -> {inner})[0]", "ARRAY<STRUCT>"


@_add("HLL_COUNT.INIT")
def hll_init(args, **_):
    return f"hll_sketch_agg({args[0]})", "BYTES"


@_add("HLL_COUNT.MERGE")
def hll_merge(args, **_):
    return f"hll_sketch_estimate(hll_union_agg({args[0]}, true))", "INT64"


@_add("HLL_COUNT.MERGE_PARTIAL")
def hll_merge_partial(args, **_):
    return f"hll_union_agg({args[0]}, true)", "BYTES"


@_add("HLL_COUNT.EXTRACT")
def hll_extract(args, **_):
    return f"hll_sketch_estimate({args[0]})", "INT64"


def _ranking(f: str):
    def rank(args, **_):
        if f == "ntile":
            return f"ntile(cast({args[0]} AS int))", "INT64"
        return f"{f}()", "INT64" if f not in ("percent_rank", "cume_dist") else "FLOAT64"

    return rank


for _f in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"):
    AGGREGATES[_f.upper()] = _ranking(_f)


def _navigation(f: str):
    def move(args, nulls=None, **_):
        x = args[0]
        more = "".join(f", {str(a).removesuffix('L')}" if k == 0 else f", {a}" for k, a in enumerate(args[1:]))
        return f"{f}({x}{more}){' IGNORE NULLS' if nulls == 'IGNORE' else ''}", x.type

    return move


for _f in ("lag", "lead", "first_value", "last_value", "nth_value"):
    AGGREGATES[_f.upper()] = _navigation(_f)


def _percentile(f: str):
    def at(args, nulls=None, **_):
        return f"{f}({args[1]}) WITHIN GROUP (ORDER BY {args[0]})", "FLOAT64" if f == "percentile_cont" else args[0].type

    return at


AGGREGATES["PERCENTILE_CONT"] = _percentile("percentile_cont")
AGGREGATES["PERCENTILE_DISC"] = _percentile("percentile_disc")

_INTEGERS = frozenset("ROW_NUMBER RANK DENSE_RANK NTILE".split())


def over(text: str, spec: str, name: str) -> str:
    """Attach a window; ranks become 64-bit."""
    windowed = f"{text} OVER {spec}"
    if name.upper() == "ARRAY_AGG":  # the window belongs to the aggregate inside
        cut = text.index("collect_")
        depth, k = 0, text.index("(", cut)
        for k in range(k, len(text)):
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            if not depth:
                break
        return f"{text[: k + 1]} OVER {spec}{text[k + 1 :]}"
    if name.upper() == "AVG" and text.startswith("cast("):
        return f"cast({text[5 : text.rindex(' AS ')]} OVER {spec} AS decimal(38,9))"
    return f"cast({windowed} AS bigint)" if name.upper() in _INTEGERS else windowed
