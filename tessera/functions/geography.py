"""Geography functions of the dialect: arithmetic on points stays in Spark, shapes go to Arrow-batched functions."""

from __future__ import annotations

from tessera.functions.expr import Expr, rule, template

_XY = r"^POINT\\s*\\(\\s*([-0-9.eE+]+)\\s+([-0-9.eE+]+)\\s*\\)$"

template("ST_X", f"try_cast(regexp_extract({{0}}, '{_XY}', 1) AS double)", "FLOAT64")
template("ST_Y", f"try_cast(regexp_extract({{0}}, '{_XY}', 2) AS double)", "FLOAT64")


def _coordinate(x: str) -> str:
    """A number as well-known text writes it: whole numbers without a point."""
    return f"regexp_replace(cast(cast({x} AS double) AS string), '[.]0$', '')"


@rule("ST_GEOGPOINT", type="GEOGRAPHY")
def point(lon, lat):
    return f"concat('POINT(', {_coordinate(lon)}, ' ', {_coordinate(lat)}, ')')"


for _name, _f, _kind in (
    ("ST_GEOGFROMTEXT", "ts_st_text", "GEOGRAPHY"), ("ST_ASTEXT", "ts_st_text", "STRING"), ("ST_GEOGFROMGEOJSON", "ts_st_from_geojson", "GEOGRAPHY"), ("ST_GEOGFROMWKB", "ts_st_from_wkb", "GEOGRAPHY"),
    ("ST_ASGEOJSON", "ts_st_geojson", "STRING"), ("ST_ASBINARY", "ts_st_wkb", "BYTES"), ("ST_BOUNDARY", "ts_st_boundary", "GEOGRAPHY"), ("ST_CENTROID", "ts_st_centroid", "GEOGRAPHY"),
    ("ST_CONVEXHULL", "ts_st_hull", "GEOGRAPHY"), ("ST_DUMP", "ts_st_dump", "ARRAY"), ("ST_DIMENSION", "ts_st_dimension", "INT64"), ("ST_LENGTH", "ts_st_length", "FLOAT64"),
    ("ST_PERIMETER", "ts_st_perimeter", "FLOAT64"), ("ST_AREA", "ts_st_area", "FLOAT64"), ("ST_ISCLOSED", "ts_st_closed", "BOOL"), ("ST_ISRING", "ts_st_ring", "BOOL"), ("ST_ISEMPTY", "ts_st_empty", "BOOL"),
    ("ST_ISCOLLECTION", "ts_st_collection", "BOOL"), ("ST_NPOINTS", "ts_st_npoints", "INT64"), ("ST_NUMPOINTS", "ts_st_npoints", "INT64"), ("ST_MAKEPOLYGON", "ts_st_make_polygon", "GEOGRAPHY"),
):
    template(_name, f"{_f}({{0}})", _kind)

for _name, _text, _kind in (
    ("ST_CLOSESTPOINT", "ts_st_closest({0}, {1})", "GEOGRAPHY"), ("ST_DIFFERENCE", "ts_st_difference({0}, {1})", "GEOGRAPHY"), ("ST_INTERSECTION", "ts_st_intersection({0}, {1})", "GEOGRAPHY"),
    ("ST_DISJOINT", "(NOT ts_st_intersects({0}, {1}))", "BOOL"), ("ST_EQUALS", "ts_st_equals({0}, {1})", "BOOL"), ("ST_INTERSECTS", "ts_st_intersects({0}, {1})", "BOOL"), ("ST_TOUCHES", "ts_st_touches({0}, {1})", "BOOL"),
    ("ST_WITHIN", "ts_st_contains({1}, {0})", "BOOL"), ("ST_CONTAINS", "ts_st_contains({0}, {1})", "BOOL"), ("ST_COVERS", "ts_st_covers({0}, {1})", "BOOL"), ("ST_COVEREDBY", "ts_st_covers({1}, {0})", "BOOL"),
    ("ST_MAXDISTANCE", "ts_st_max_distance({0}, {1})", "FLOAT64"), ("ST_POINTN", "ts_st_point_n({0}, {1})", "GEOGRAPHY"), ("ST_SIMPLIFY", "ts_st_simplify({0}, cast({1} AS double))", "GEOGRAPHY"),
    ("ST_SNAPTOGRID", "ts_st_snap({0}, cast({1} AS double))", "GEOGRAPHY"), ("ST_BUFFER", "ts_st_buffer({0}, cast({1} AS double))", "GEOGRAPHY"),
    ("ST_INTERSECTSBOX", "ts_st_in_box({0}, cast({1} AS double), cast({2} AS double), cast({3} AS double), cast({4} AS double))", "BOOL"),
):
    template(_name, _text, _kind)


def between_points(x1: str, y1: str, x2: str, y2: str) -> str:
    """Great-circle metres by the arc's tangent, accurate at every distance."""
    a1, a2, d = f"radians({y1})", f"radians({y2})", f"radians({x2} - {x1})"
    over = f"sqrt(pow(cos({a2}) * sin({d}), 2) + pow(cos({a1}) * sin({a2}) - sin({a1}) * cos({a2}) * cos({d}), 2))"
    return f"6371010D * atan2({over}, sin({a1}) * sin({a2}) + cos({a1}) * cos({a2}) * cos({d}))"


def _distance(a: str, b: str) -> str:
    if all(str(x).startswith("concat('POINT('") for x in (a, b)):  # two points: no function call needed
        from tessera.functions.expr import RULES

        x, y = (RULES[n][0] for n in ("ST_X", "ST_Y"))
        return between_points(x(a), y(a), x(b), y(b))
    return f"ts_st_distance({a}, {b})"


rule("ST_DISTANCE", type="FLOAT64")(_distance)
rule("ST_DWITHIN", type="BOOL")(lambda a, b, d: f"({_distance(a, b)} <= {d})")


@rule("ST_MAKELINE", type="GEOGRAPHY")
def make_line(a, b=None):
    if b is None:
        return f"aggregate(slice({a}, 2, size({a})), element_at({a}, 1), (_s, _p) -> concat('LINESTRING(', regexp_replace(_s, '^[A-Z]+\\\\s*\\\\(|\\\\)$', ''), ', ', regexp_replace(_p, '^[A-Z]+\\\\s*\\\\(|\\\\)$', ''), ')'))"
    return f"ts_st_make_line({a}, {b})"


@rule("ST_MAKEPOLYGONORIENTED", type="GEOGRAPHY")
def make_polygon_oriented(rings):
    return f"ts_st_make_polygon(element_at({rings}, 1))"


@rule("ST_UNION", type="GEOGRAPHY")
def union(a, b=None):
    return f"ts_st_union({a}, {b})" if b is not None else f"ts_st_union_all({a})"


@rule("ST_UNION_AGG", type="GEOGRAPHY")
def union_agg(x):
    return Expr(f"ts_st_union_all(collect_list({x}))", "GEOGRAPHY")


template("ST_GEOMETRYTYPE", "ts_st_type({0})", "STRING")
template("ST_STARTPOINT", "ts_st_end({0}, false)", "GEOGRAPHY")
template("ST_ENDPOINT", "ts_st_end({0}, true)", "GEOGRAPHY")
template("ST_ISVALID", "ts_st_valid({0})", "BOOL")
template("ST_ENVELOPE", "transform(array(ts_st_envelope({0})), _e -> concat('POLYGON((', array_join(array(concat(_e[0], ' ', _e[1]), concat(_e[2], ' ', _e[1]), concat(_e[2], ' ', _e[3]), concat(_e[0], ' ', _e[3]), concat(_e[0], ' ', _e[1])), ', '), '))'))[0]", "GEOGRAPHY")
template("ST_BOUNDINGBOX", "transform(array(ts_st_envelope({0})), _e -> named_struct('xmin', _e[0], 'ymin', _e[1], 'xmax', _e[2], 'ymax', _e[3]))[0]", "STRUCT")
