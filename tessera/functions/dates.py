"""Date and time functions of the dialect as Spark SQL. DATETIME is timestamp_ntz, TIMESTAMP is timestamp in UTC."""

from __future__ import annotations

import re

from tessera.functions.expr import Expr, literal, quote, rule, template, word

# The dialect's format elements and Spark's patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "k": "H", "l": "h", "M": "mm", "S": "ss", "j": "DDD", "p": "a", "P": "a", "A": "EEEE", "a": "EEE",
    "B": "MMMM", "b": "MMM", "h": "MMM", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "x": "MM/dd/yy", "X": "HH:mm:ss", "z": "xx", "Ez": "xxx", "Z": "'UTC'", "Q": "q",
    "c": "EEE MMM d HH:mm:ss yyyy", "n": "\n", "t": "\t", "f": "SSSSSS",
}
CAST_FORMAT = (("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("DAY", "EEEE"), ("DY", "EEE"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a"))
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000}
DAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def cast_format(pattern: str) -> str:
    out, at = "", 0
    while at < len(pattern):
        for name, java in CAST_FORMAT:
            if pattern.upper().startswith(name, at):
                out, at = out + java, at + len(name)
                break
        else:
            c = pattern[at]
            out, at = out + (f"'{c}'" if c.isalpha() else c), at + 1
    return out


def pieces(pattern: str) -> list[tuple[str, str]]:
    """A format as (element, text) pairs; text that stands for itself has an empty element."""
    out, at = [], 0
    for m in re.finditer(r"%(E[0-9#*]?S|E?[A-Za-z%]|E4Y)", pattern):
        if m.start() > at:
            out.append(("", pattern[at : m.start()]))
        out.append((m[1], m[0]))
        at = m.end()
    if at < len(pattern):
        out.append(("", pattern[at:]))
    return out


def formatted(x: str, pattern: str, zone: str = "UTC") -> str:
    """strftime, as a concatenation of Spark's own formats; %Y has no leading zeros."""
    found = []
    for element, text in pieces(pattern):
        if not element:
            found.append(quote(text))
        elif element == "%":
            found.append("'%'")
        elif element == "Y":
            found.append(f"cast(extract(YEAR FROM {x}) AS string)")
        elif element == "e":
            found.append(f"lpad(cast(extract(DAY FROM {x}) AS string), 2, ' ')")
        elif element in ("k", "l"):
            hour = f"extract(HOUR FROM {x})" if element == "k" else f"(extract(HOUR FROM {x}) + 11) % 12 + 1"
            found.append(f"lpad(cast({hour} AS string), 2, ' ')")
        elif element == "j":
            found.append(f"lpad(cast(dayofyear({x}) AS string), 3, '0')")
        elif element == "G":
            found.append(f"cast(extract(YEAROFWEEK FROM {x}) AS string)")
        elif element == "g":
            found.append(f"lpad(cast(extract(YEAROFWEEK FROM {x}) % 100 AS string), 2, '0')")
        elif element == "V":
            found.append(f"lpad(cast(weekofyear({x}) AS string), 2, '0')")
        elif element in ("U", "W"):
            found.append(f"lpad(cast({week_number(x, 'SUNDAY' if element == 'U' else 'MONDAY')} AS string), 2, '0')")
        elif element == "u":
            found.append(f"cast(weekday({x}) + 1 AS string)")
        elif element == "w":
            found.append(f"cast(dayofweek({x}) - 1 AS string)")
        elif element == "C":
            found.append(f"lpad(cast(extract(YEAR FROM {x}) div 100 AS string), 2, '0')")
        elif element == "Q":
            found.append(f"cast(quarter({x}) AS string)")
        elif element == "s":
            found.append(f"cast(unix_seconds(cast({x} AS timestamp)) AS string)")
        elif element == "P":
            found.append(f"lower(date_format({x}, 'a'))")
        elif element in ("z", "Ez"):
            found.append(quote("+0000" if element == "z" else "+00:00") if zone == "UTC" else f"ts_offset({x}, {quote(zone)}, {'true' if element == 'Ez' else 'false'})")
        elif element == "Z":
            found.append(quote("UTC" if zone == "UTC" else zone))
        elif re.fullmatch(r"E[0-9#*]?S", element):
            n = element[1:-1]
            digits = 6 if n in ("#", "*") else int(n or 0)
            text = f"date_format({x}, 'ss{'.' + 'S' * digits if digits else ''}')"
            found.append(f"regexp_replace({text}, '[.]?0+$', '')" if n in ("#", "*") else text)
        elif element == "E4Y":
            found.append(f"date_format({x}, 'yyyy')")
        elif element in STRFTIME:
            java = STRFTIME[element]
            if element in ("n", "t"):
                found.append(quote(java))
            elif "yyyy" in java and element == "F":
                found.append(f"concat(cast(extract(YEAR FROM {x}) AS string), date_format({x}, '-MM-dd'))")
            else:
                found.append(f"date_format({x}, {quote(java)})")
        else:
            raise TypeError(f"no format element %{element}")
    return f"concat({', '.join(found)})" if found else "''"


def parse_pattern(pattern: str) -> str:
    out = ""
    found = pieces(pattern)
    packed = any(a[0] and b[0] for a, b in zip(found, found[1:]))  # elements side by side have full width
    for element, text in found:
        if not element:
            out += "".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in text)
        elif re.fullmatch(r"E[0-9#*]?S", element):
            out += "ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"
        elif element in ("z", "Ez"):
            out += "[XXX][XX][X]"
        elif element == "E4Y":
            out += "yyyy"
        elif element == "%":
            out += "%"
        elif element == "Z":
            out += "VV"
        elif element in STRFTIME:
            # elsewhere parsing takes single digits too
            out += STRFTIME[element] if packed else {"yyyy": "yyyy", "MM": "M", "dd": "d", "HH": "H", "hh": "h", "mm": "m", "ss": "s", "yyyy-MM-dd": "yyyy-M-d", "HH:mm:ss": "H:m:s", "HH:mm": "H:m", "MM/dd/yy": "M/d/yy"}.get(STRFTIME[element], STRFTIME[element])
        else:
            raise TypeError(f"no format element %{element}")
    return out


# -- intervals


def interval(n: str, unit: str) -> str:
    places = {"YEAR": 0, "MONTH": 1, "WEEK": 2, "DAY": 3, "HOUR": 4, "MINUTE": 5}
    if unit == "QUARTER":
        return f"make_interval(0, cast({n} AS int) * 3)"
    if unit in places:
        return f"make_interval({'0, ' * places[unit]}cast({n} AS int))"
    if unit in ("SECOND", "MILLISECOND", "MICROSECOND"):
        scale = {"SECOND": 1, "MILLISECOND": 1000, "MICROSECOND": 1_000_000}[unit]
        return f"make_interval(0, 0, 0, 0, 0, 0, cast({n} AS decimal(18,6)) / {scale})"
    raise TypeError(f"no interval unit {unit}")


def interval_text(text: str, first: str, last: str) -> str:
    """INTERVAL '1-2 3 4:5:6.7' YEAR TO SECOND and its shorter forms."""
    units = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
    names = units[units.index(first) : units.index(last) + 1]
    values = dict.fromkeys(units, 0.0)
    sign = 1
    numbers = []
    for chunk in text.split():
        negative = chunk.startswith("-")
        for k, v in enumerate(re.split(r"[-:]", chunk.lstrip("+-"))):
            numbers.append(-float(v) if negative else float(v))
    for n, v in zip(names, numbers):
        values[n] = sign * v
    s = f"{values['SECOND']:.6f}"
    return f"make_interval({int(values['YEAR'])}, {int(values['MONTH'])}, 0, {int(values['DAY'])}, {int(values['HOUR'])}, {int(values['MINUTE'])}, {s})"


def _gap(gap: Expr) -> tuple[str, str]:
    if isinstance(gap.part, tuple) and gap.part[0] == "interval":
        return gap.part[1], gap.part[2]
    raise TypeError("needs an INTERVAL n unit")


def shifted(when: Expr, gap: Expr, sign: int) -> str:
    if when.type == "DATE" and isinstance(gap.part, tuple) and gap.part[2] in ("DAY", "WEEK", "MONTH", "QUARTER", "YEAR"):
        return _date_add(when, gap, sign)
    return f"({when} {'+' if sign > 0 else '-'} {gap})"


def _date_add(d: str, gap: Expr, sign: int) -> str:
    n, unit = _gap(gap)
    n = f"cast({'-' if sign < 0 else ''}({n}) AS int)"
    if unit in ("DAY", "WEEK"):
        return f"date_add({d}, {n}{' * 7' if unit == 'WEEK' else ''})"
    return f"add_months({d}, {n}{ {'QUARTER': ' * 3', 'YEAR': ' * 12'}.get(unit, '') })"


rule("DATE_ADD", type="DATE")(lambda d, gap: _date_add(d, gap, 1))
rule("DATE_SUB", type="DATE")(lambda d, gap: _date_add(d, gap, -1))


def _ntz(x: Expr) -> str:
    return f"cast({x} AS timestamp_ntz)"


def _moved(target: str):
    def add(sign: int):
        return lambda t, gap: f"(cast({t} AS {target}) {'+' if sign > 0 else '-'} {interval(*_gap(gap))})"

    return add


for _kind, _target in (("DATETIME", "timestamp_ntz"), ("TIMESTAMP", "timestamp")):
    rule(f"{_kind}_ADD", type=_kind)(_moved(_target)(1))
    rule(f"{_kind}_SUB", type=_kind)(_moved(_target)(-1))


def _time_micros(t: str) -> str:
    return f"(extract(HOUR FROM {t}) * 3600000000L + extract(MINUTE FROM {t}) * 60000000L + cast(extract(SECOND FROM {t}) * 1000000 AS bigint))"


def _time_of(micros: str) -> str:
    """A time of day from microseconds, which wrap at midnight."""
    m = f"pmod({micros}, 86400000000L)"
    return f"make_time(cast({m} div 3600000000L AS int), cast({m} div 60000000L % 60 AS int), cast(({m} % 60000000L) / 1000000BD AS decimal(16,6)))"


def _time_add(sign: int):
    def add(t, gap):
        n, unit = _gap(gap)
        return _time_of(f"{_time_micros(t)} {'+' if sign > 0 else '-'} ({n}) * {MICROS[unit]}L")

    return add


rule("TIME_ADD", type="TIME")(_time_add(1))
rule("TIME_SUB", type="TIME")(_time_add(-1))
rule("TIME_DIFF", type="INT64")(lambda a, b, part: f"({_time_micros(a)} div {MICROS[word(part)]}L - {_time_micros(b)} div {MICROS[word(part)]}L)")
rule("TIME_TRUNC", type="TIME")(lambda t, part: _time_of(f"({_time_micros(t)} div {MICROS[word(part)]}L * {MICROS[word(part)]}L)"))


# -- truncation, weeks, differences


def _week_start(part: str) -> int:
    """Days after Monday on which the week of WEEK, WEEK(day) or ISOWEEK begins."""
    if part == "ISOWEEK":
        return 0
    if part == "WEEK":
        return 6
    return DAYS.index(part[5:-1])


def truncated_date(d: str, part: str) -> str:
    if part in ("DAY", "DATE"):
        return f"cast({d} AS date)"
    if part.startswith("WEEK") or part == "ISOWEEK":
        return f"date_sub({d}, pmod(weekday({d}) - {_week_start(part)}, 7))"
    if part == "ISOYEAR":
        return f"trunc(make_date(extract(YEAROFWEEK FROM {d}), 1, 4), 'week')"
    if part in ("MONTH", "QUARTER", "YEAR"):
        return f"trunc({d}, '{part}')"
    raise TypeError(f"no date part {part}")


def week_number(x: str, day: str = "SUNDAY") -> str:
    """Weeks begun since the new year; days before its first such day are in week zero."""
    shift = (DAYS.index(day) + 1) % 7
    return f"((dayofyear({x}) + 6 - pmod(dayofweek({x}) - 1 - {shift}, 7)) div 7)"


rule("DATE_TRUNC", type="DATE")(lambda d, part: truncated_date(f"{d}", word(part)))


def _truncated(target: str):
    def cut(t, part, zone=None):
        p = word(part)
        if p in ("MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR"):
            local = f"date_trunc('{p}', {t})"
        else:
            local = truncated_date(f"cast({t} AS date)", p)
        if zone is not None:
            moved = f"from_utc_timestamp({t}, {zone})"
            inner = f"date_trunc('{p}', {moved})" if p in MICROS and p != "DAY" else truncated_date(f"cast({moved} AS date)", p)
            return f"to_utc_timestamp(cast({inner} AS timestamp), {zone})"
        return f"cast({local} AS {target})"

    return cut


rule("DATETIME_TRUNC", type="DATETIME")(_truncated("timestamp_ntz"))
rule("TIMESTAMP_TRUNC", type="TIMESTAMP")(_truncated("timestamp"))


def _date_diff(a: str, b: str, part: str) -> str:
    """Boundaries crossed from b to a."""
    if part == "DAY":
        return f"cast(datediff({a}, {b}) AS bigint)"
    if part.startswith("WEEK") or part == "ISOWEEK":
        return f"cast(datediff({truncated_date(a, part)}, {truncated_date(b, part)}) div 7 AS bigint)"
    year = "YEAROFWEEK" if part == "ISOYEAR" else "YEAR"
    y = f"(extract({year} FROM {a}) - extract({year} FROM {b}))"
    if part in ("YEAR", "ISOYEAR"):
        return f"cast({y} AS bigint)"
    if part == "MONTH":
        return f"cast({y} * 12 + month({a}) - month({b}) AS bigint)"
    if part == "QUARTER":
        return f"cast({y} * 4 + quarter({a}) - quarter({b}) AS bigint)"
    raise TypeError(f"no date part {part}")


rule("DATE_DIFF", type="INT64")(lambda a, b, part: _date_diff(a, b, word(part)))


@rule("DATETIME_DIFF", type="INT64")
def datetime_diff(a, b, part):
    p = word(part)
    if p not in MICROS or p == "DAY":
        return _date_diff(f"cast({a} AS date)", f"cast({b} AS date)", p)
    us = [f"unix_micros(cast(cast({x} AS timestamp_ntz) AS timestamp))" for x in (a, b)]
    return f"(cast(floor({us[0]} / {MICROS[p]}BD) AS bigint) - cast(floor({us[1]} / {MICROS[p]}BD) AS bigint))"


@rule("TIMESTAMP_DIFF", type="INT64")
def timestamp_diff(a, b, part):
    """Whole units elapsed, towards zero."""
    return f"((unix_micros({a}) - unix_micros({b})) div {MICROS[word(part)]}L)"


def extract(part: str, x: Expr, zone: Expr | None) -> tuple[str, str]:
    if zone is not None:
        x = Expr(f"from_utc_timestamp({x}, {zone})", "DATETIME")
    if x.type == "INTERVAL":
        if part in ("SECOND",):
            return f"cast(floor(extract(SECOND FROM {x})) AS bigint)", "INT64"
        if part in ("MILLISECOND", "MICROSECOND"):
            scale = {"MILLISECOND": 1000, "MICROSECOND": 1_000_000}[part]
            return f"cast((extract(SECOND FROM {x}) % 1) * {scale} AS bigint)", "INT64"
        return f"cast(extract({part} FROM {x}) AS bigint)", "INT64"
    if part == "DATE":
        return f"cast({x} AS date)", "DATE"
    if part == "DATETIME":
        return f"cast({x} AS timestamp_ntz)", "DATETIME"
    if part == "TIME":
        return f"cast(date_format({x}, 'HH:mm:ss.SSSSSS') AS time(6))", "TIME"
    if part == "DAYOFWEEK":
        text = f"dayofweek({x})"
    elif part == "DAYOFYEAR":
        text = f"dayofyear({x})"
    elif part.startswith("WEEK"):
        text = week_number(x, part[5:-1] if "(" in part else "SUNDAY")
    elif part == "ISOWEEK":
        text = f"weekofyear({x})"
    elif part == "ISOYEAR":
        text = f"extract(YEAROFWEEK FROM {x})"
    elif part == "SECOND":
        text = f"floor(extract(SECOND FROM {x}))"
    elif part in ("MILLISECOND", "MICROSECOND"):
        text = f"(extract(SECOND FROM {x}) % 1) * {1000 if part == 'MILLISECOND' else 1_000_000}"
    else:
        text = f"extract({part} FROM {x})"
    return f"cast({text} AS bigint)", "INT64"


@rule("LAST_DAY", type="DATE")
def last_day(d, part=None):
    p = word(part) if part is not None else "MONTH"
    if p == "MONTH":
        return f"last_day({d})"
    if p.startswith("WEEK") or p == "ISOWEEK":
        return f"date_add({truncated_date(d, p)}, 6)"
    if p == "QUARTER":
        return f"last_day(add_months(trunc({d}, 'QUARTER'), 2))"
    if p == "YEAR":
        return f"make_date(year({d}), 12, 31)"
    return f"date_sub(trunc(make_date(extract(YEAROFWEEK FROM {d}) + 1, 1, 4), 'week'), 1)"


# -- constructors and conversions

for _n, _t, _k in (
    ("DATE_FROM_UNIX_DATE", "date_from_unix_date(cast({0} AS int))", "DATE"), ("UNIX_DATE", "cast(unix_date({0}) AS bigint)", "INT64"),
    ("TIMESTAMP_SECONDS", "timestamp_seconds({0})", "TIMESTAMP"), ("TIMESTAMP_MILLIS", "timestamp_millis({0})", "TIMESTAMP"), ("TIMESTAMP_MICROS", "timestamp_micros({0})", "TIMESTAMP"),
    ("UNIX_SECONDS", "unix_seconds({0})", "INT64"), ("UNIX_MILLIS", "unix_millis({0})", "INT64"), ("UNIX_MICROS", "unix_micros({0})", "INT64"),
    ("CURRENT_DATE", "current_date()", "DATE"), ("CURRENT_TIMESTAMP", "current_timestamp()", "TIMESTAMP"), ("CURRENT_DATETIME", "localtimestamp()", "DATETIME"), ("CURRENT_TIME", "current_time()", "TIME"),
):
    template(_n, _t, _k)


@rule("DATE", type="DATE")
def date(*args):
    if len(args) == 3:
        return f"make_date({', '.join(f'cast({a} AS int)' for a in args)})"
    if len(args) == 2:
        return f"cast(from_utc_timestamp({args[0]}, {args[1]}) AS date)"
    return f"cast({args[0]} AS date)"


@rule("DATETIME", type="DATETIME")
def datetime(*args):
    if len(args) == 6:
        return f"make_timestamp_ntz({', '.join(f'cast({a} AS int)' for a in args)})"
    if len(args) == 2 and args[1].type == "TIME":
        return f"make_timestamp_ntz({args[0]}, {args[1]})"
    if len(args) == 2:
        return f"cast(from_utc_timestamp({args[0]}, {args[1]}) AS timestamp_ntz)"
    return f"cast({args[0]} AS timestamp_ntz)"


@rule("TIMESTAMP", type="TIMESTAMP")
def timestamp(x, zone=None):
    if zone is not None:
        return f"to_utc_timestamp(cast({x} AS timestamp), {zone})"
    return f"cast({x} AS timestamp)"


@rule("TIME", type="TIME")
def time(*args):
    if len(args) == 3:
        return f"make_time({', '.join(f'cast({a} AS int)' for a in args[:2])}, cast({args[2]} AS decimal(16,6)))"
    x = f"from_utc_timestamp({args[0]}, {args[1]})" if len(args) == 2 else args[0]
    return f"cast(date_format({x}, 'HH:mm:ss.SSSSSS') AS time(6))"


def _format(cast: str):
    def write(pattern, x, zone=None):
        v = literal(pattern)
        if not isinstance(v, str):
            raise TypeError("the format must be a literal")
        z = literal(zone) if zone is not None else "UTC"
        local = f"from_utc_timestamp({x}, {zone})" if zone is not None and z != "UTC" else cast.format(x)
        return formatted(local, v, z or "UTC")

    return write


rule("FORMAT_DATE", type="STRING")(_format("{}"))
rule("FORMAT_DATETIME", type="STRING")(_format("{}"))
rule("FORMAT_TIMESTAMP", type="STRING")(_format("{}"))
rule("FORMAT_TIME", type="STRING")(_format("make_timestamp_ntz(date'1970-01-01', {})"))


def _parsed(pattern) -> str:
    v = literal(pattern)
    if not isinstance(v, str):
        raise TypeError("the format must be a literal")
    return quote(parse_pattern(v))


rule("PARSE_DATE", type="DATE")(lambda p, s: f"to_date({s}, {_parsed(p)})")
rule("PARSE_DATETIME", type="DATETIME")(lambda p, s: f"to_timestamp_ntz({s}, {_parsed(p)})")
rule("PARSE_TIME", type="TIME")(lambda p, s: f"to_time({s}, {_parsed(p)})")


@rule("PARSE_TIMESTAMP", type="TIMESTAMP")
def parse_timestamp(p, s, zone=None):
    text = f"to_timestamp({s}, {_parsed(p)})"
    return f"to_utc_timestamp({text}, {zone})" if zone is not None else text


@rule("STRING", type="STRING")
def string(x, zone=None):
    if x.type == "JSON":
        from tessera.functions import json_text

        return json_text.strict(x, "string")
    if x.type in ("DATE", "DATETIME"):
        return f"cast({x} AS string)"
    local = f"from_utc_timestamp({x}, {zone})" if zone is not None else x
    z = literal(zone) if zone is not None else "UTC"
    offset = "'+00'" if z == "UTC" else f"regexp_replace(ts_offset({x}, {zone}, true), ':00$', '')"
    return f"concat(regexp_replace(date_format({local}, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '[.]000000$|(?<=[.][0-9]{{3}})000$', ''), {offset})"


def _series(default: str):
    def make(a, b, step=None):
        """A step against the direction gives an empty array."""
        if step is None:
            gap, n = default, "1"
        else:
            n, unit = _gap(step)
            gap = interval(n, unit)
        n = str(n).removesuffix("L")
        return f"if(({n} > 0 AND {a} > {b}) OR ({n} < 0 AND {a} < {b}), filter(array({a}), _x -> false), sequence({a}, {b}, {gap}))"

    return make


rule("GENERATE_DATE_ARRAY", type="ARRAY")(_series("interval 1 day"))
rule("GENERATE_TIMESTAMP_ARRAY", type="ARRAY")(_series("interval 1 day"))


# -- interval functions: structs of months, days and microseconds are built from Spark's calendar interval


@rule("MAKE_INTERVAL", type="INTERVAL")
def make_interval(*args):
    names = ("year", "month", "day", "hour", "minute", "second")
    values = dict.fromkeys(names, "0")
    for k, a in enumerate(args):
        if isinstance(a.part, tuple) and a.part[0] == "named":
            values[a.part[1]] = a.part[2]
        else:
            values[names[k]] = str(a)
    v = [f"cast({values[n]} AS int)" for n in names[:5]]
    return f"make_interval({v[0]}, {v[1]}, 0, {v[2]}, {v[3]}, {v[4]}, cast({values['second']} AS decimal(18,6)))"


def _parts(i: str) -> tuple[str, str, str]:
    months = f"(extract(YEAR FROM {i}) * 12 + extract(MONTH FROM {i}))"
    micros = f"(extract(HOUR FROM {i}) * 3600000000L + extract(MINUTE FROM {i}) * 60000000L + cast(extract(SECOND FROM {i}) * 1000000 AS bigint))"
    return months, f"extract(DAY FROM {i})", micros


def _interval(months: str, days: str, micros: str) -> str:
    return f"make_interval(0, cast({months} AS int), 0, cast({days} AS int), 0, 0, cast({micros} / 1000000BD AS decimal(18,6)))"


@rule("JUSTIFY_DAYS", type="INTERVAL")
def justify_days(i):
    m, d, u = _parts(i)
    return _interval(f"{m} + {d} div 30", f"{d} % 30", u)


@rule("JUSTIFY_HOURS", type="INTERVAL")
def justify_hours(i):
    m, d, u = _parts(i)
    return _interval(m, f"{d} + {u} div 86400000000L", f"{u} % 86400000000L")


@rule("JUSTIFY_INTERVAL", type="INTERVAL")
def justify_interval(i):
    m, d, u = _parts(i)
    day = f"({d} + {u} div 86400000000L)"
    return _interval(f"{m} + {day} div 30", f"{day} % 30", f"{u} % 86400000000L")


def interval_string(i: str) -> str:
    """Y-M D H:M:S[.F], as the warehouse writes intervals."""
    m, d, u = _parts(i)
    fraction = f"if({u} % 1000000L = 0, '', concat('.', lpad(cast(abs({u}) % 1000000L AS string), 6, '0')))"
    return (
        f"concat(if({m} < 0, '-', ''), abs({m}) div 12, '-', abs({m}) % 12, ' ', {d}, ' ', if({u} < 0, '-', ''), abs({u}) div 3600000000L, ':', "
        f"abs({u}) div 60000000L % 60, ':', abs({u}) div 1000000L % 60, {fraction})"
    )


def shown(df):
    """A result as its reader can take it: intervals, which Python has no type for, become the warehouse's text."""
    from pyspark.sql import functions as F

    if not any(kind == "interval" for _, kind in df.dtypes):
        return df
    return df.select(*[F.expr(interval_string(f"`{c}`")).alias(c) if kind == "interval" else F.col(f"`{c}`") for c, kind in df.dtypes])
