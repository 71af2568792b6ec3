"""String functions of the dialect as Spark SQL."""

from __future__ import annotations

from tessera.functions.expr import Expr, literal, quote, rule, same, template, word

same("ascii", "INT64")
template("ASCII", "cast(ascii({0}) AS bigint)", "INT64")
template("UNICODE", "cast(ascii({0}) AS bigint)", "INT64")
template("BYTE_LENGTH", "cast(octet_length({0}) AS bigint)", "INT64")
template("OCTET_LENGTH", "cast(octet_length({0}) AS bigint)", "INT64")
template("CHAR_LENGTH", "cast(char_length({0}) AS bigint)", "INT64")
template("CHARACTER_LENGTH", "cast(char_length({0}) AS bigint)", "INT64")
same("lower upper", "STRING")
# code points as UTF-32 behind a byte order mark, so that none of them is taken for one; zeros and nulls are left out
_POINTS = "decode(unhex(concat('0000FEFF', array_join(transform(filter({0}, _c -> _c <> 0), _c -> lpad(hex(_c), 8, '0')), ''))), 'UTF-32')"
template("CHR", _POINTS.replace("{0}", "array({0})"), "STRING")
template("CODE_POINTS_TO_STRING", _POINTS, "STRING")
template("CODE_POINTS_TO_BYTES", "unhex(array_join(transform({0}, _x -> lpad(hex(_x), 2, '0')), ''))", "BYTES")
template("FROM_BASE64", "unbase64({0})", "BYTES")
template("FROM_HEX", "unhex({0})", "BYTES")
template("TO_HEX", "lower(hex({0}))", "STRING")
template("NORMALIZE_AND_CASEFOLD", "ts_normalize_casefold({0}, 'NFKC')", "STRING")
template("SOUNDEX", "ts_soundex({0})", "STRING")
template("STRPOS", "cast(instr({0}, {1}) AS bigint)", "INT64")
template("LEFT", "left({0}, cast({1} AS int))", "STRING")
template("RIGHT", "right({0}, cast({1} AS int))", "STRING")
template("REPEAT", "repeat({0}, cast({1} AS int))", "STRING")
template("STARTS_WITH", "startswith({0}, {1})", "BOOL")
template("ENDS_WITH", "endswith({0}, {1})", "BOOL")
template("TRANSLATE", "translate({0}, {1}, {2})", "STRING")
template("CONTAINS_SUBSTR", "contains(ts_normalize_casefold(cast({0} AS string), 'NFKC'), ts_normalize_casefold({1}, 'NFKC'))", "BOOL")
template("REPLACE", "if({1} = '', {0}, replace({0}, {1}, {2}))", "STRING")


@rule("LENGTH")
def length(x):
    """Characters of a string, bytes of bytes: Spark's own distinction."""
    return Expr(f"cast(length({x}) AS bigint)", "INT64")


@rule("CONCAT")
def concat(*args):
    if not args:
        raise TypeError("needs an argument")
    return Expr(f"concat({', '.join(args)})", args[0].type or "STRING")


@rule("NORMALIZE", type="STRING")
def normalize(x, form="NFC"):
    return f"ts_normalize({x}, {quote(word(form))})"


@rule("REVERSE")
def reverse(x):
    if x.type == "BYTES":
        return Expr(f"unhex(array_join(reverse(regexp_extract_all(hex({x}), '..', 0)), ''))", "BYTES")
    return Expr(f"reverse({x})", "STRING")


@rule("COLLATE", type="STRING")
def collate(x, spec):
    if literal(spec) == "und:ci":
        return f"lower({x})"
    if literal(spec) in ("", None):
        return x
    raise TypeError("unsupported collation")


def _padded(f):
    def pad(x, n, fill=None):
        blank = "X'20'" if x.type == "BYTES" else "' '"
        return Expr(f"{f}({x}, cast({n} AS int), {fill or blank})", x.type or "STRING")

    return pad


rule("LPAD")(_padded("lpad"))
rule("RPAD")(_padded("rpad"))


def _trimmed(f):
    def trim(x, chars=None):
        # the default set is all white space, not just blanks
        anchored = {"trim": r"^[\s\p{Z}]+|[\s\p{Z}]+$", "ltrim": r"^[\s\p{Z}]+", "rtrim": r"[\s\p{Z}]+$"}[f]
        if chars is None:
            return f"regexp_replace({x}, {quote(anchored)}, '')"
        return {"trim": f"btrim({x}, {chars})", "ltrim": f"ltrim({chars}, {x})", "rtrim": f"rtrim({chars}, {x})"}[f]

    return trim


for _f in ("trim", "ltrim", "rtrim"):
    rule(_f, type="STRING")(_trimmed(_f))


@rule("SUBSTR", "SUBSTRING")
def substr(x, start, n=None):
    """Position zero counts as one; a start before the beginning counts as the beginning."""
    if literal(start) is not None:
        s = literal(start)
        begin = str(max(s, 1)) if s >= 0 else f"greatest({s}, -length({x}))"
    else:
        begin = f"cast(if({start} = 0, 1, if({start} < -length({x}), 1, {start})) AS int)"
    if n is None:
        return Expr(f"substring({x}, {begin})", x.type or "STRING")
    part, size = f"substring({x}, {begin}, cast({n} AS int))", literal(n)
    if not isinstance(size, int) or size < 0:
        part = f"if({n} < 0, raise_error('Third argument in SUBSTR() cannot be negative'), {part})"
    return Expr(part, x.type or "STRING")


# The digits of base 32, and what begins a new word.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_STOPS = " \t\n\r\f\v[](){}/|\\<>!?@\"^#$&~_,.:;*%+-="


def _let(name: str, value: str, text: str) -> str:
    """``text`` with a name for a value, as Spark SQL has no LET."""
    return f"transform(array({value}), {name} -> {text})[0]"


@rule("TO_BASE32", type="STRING")
def to_base32(x):
    """Bytes as bits, bits in fives, fives as digits, padded to eights."""
    bits = f"array_join(transform(regexp_extract_all(hex({x}), '..', 0), _h -> lpad(conv(_h, 16, 2), 8, '0')), '')"
    fives = "regexp_extract_all(rpad(_b, cast(ceil(length(_b) / 5) * 5 AS int), '0'), '.....', 0)"
    digits = f"array_join(transform({fives}, _g -> substring('{_BASE32}', cast(conv(_g, 2, 10) AS int) + 1, 1)), '')"
    padded = _let("_d", digits, "rpad(_d, cast(ceil(length(_d) / 8) * 8 AS int), '=')")
    return _let("_b", bits, padded)


@rule("FROM_BASE32", type="BYTES")
def from_base32(x):
    bits = f"array_join(transform(regexp_extract_all(_t, '.', 0), _c -> lpad(conv(cast(instr('{_BASE32}', _c) - 1 AS string), 10, 2), 5, '0')), '')"
    held = f"unhex(array_join(transform(regexp_extract_all({bits}, '........', 0), _o -> lpad(conv(_o, 2, 16), 2, '0')), ''))"
    checked = f"if(length({x}) % 8 <> 0 OR _t RLIKE '[^A-Z2-7]', raise_error('invalid base 32'), {held})"
    return _let("_t", f"rtrim('=', {x})", checked)


@rule("INITCAP", type="STRING")
def initcap(x, delimiters=None):
    """Words between delimiters, each with its first letter large; only delimiters that vary by row take Python."""
    stops = _STOPS if delimiters is None else literal(delimiters)
    if not isinstance(stops, str) or "\\E" in stops:
        return f"ts_initcap({x}, {delimiters})"
    large = "concat(upper(left({0}, 1)), lower(substring({0}, 2)))"
    if not stops:
        return large.format(x)
    within = quote(f"\\Q{stops}\\E")[1:-1]
    return f"array_join(transform(regexp_extract_all({x}, '[^{within}]+|[{within}]', 0), _p -> {large.format('_p')}), '')"


@rule("INSTR", type="INT64")
def instr(x, y, start="1", nth="1"):
    if start == "1" and nth == "1":
        return f"cast(instr({x}, {y}) AS bigint)"
    return f"ts_instr({x}, {y}, cast({start} AS bigint), cast({nth} AS bigint))"


@rule("SPLIT", type="ARRAY")
def split(x, by="','"):
    v = literal(by) if isinstance(by, Expr) else ","
    if v == "":
        return f"if({x} = '', array(''), split({x}, ''))"
    if v is not None:
        return f"split({x}, {quote(chr(92) + 'Q' + v + chr(92) + 'E')}, -1)"
    return f"split({x}, concat('\\\\Q', {by}, '\\\\E'), -1)"


def _group(pattern) -> str:
    """1 where the pattern has a capturing group, else 0; a pattern that is not a literal is taken whole."""
    import re

    v = literal(pattern)
    if not isinstance(v, str):
        return "0"
    return "1" if re.search(r"(?<!\\)\((?!\?)", re.sub(r"\[[^\]]*\]", "", v)) else "0"


def _java(pattern):
    """The dialect's patterns as Java's: groups lose their names, which no function asks for and Java spells otherwise."""
    import re

    v = literal(pattern)
    if isinstance(v, str):
        named = re.sub(r"((?:^|[^\\])(?:\\\\)*)\(\?P?<([A-Za-z_]\w*)>", r"\1(", v)
        return pattern if named == v else Expr(quote(named), "STRING", ("literal", named))
    return Expr(f"regexp_replace({pattern}, {quote(chr(92) + '(' + chr(92) + '?P?<[A-Za-z_]' + chr(92) + 'w*>')}, '(')", "STRING")


@rule("REGEXP_CONTAINS", type="BOOL")
def regexp_contains(x, pattern):
    return f"({x} RLIKE {_java(pattern)})"


@rule("REGEXP_EXTRACT", "REGEXP_SUBSTR", type="STRING")
def regexp_extract(x, pattern, position="1", nth="1"):
    """No match is null, unlike Spark's empty string."""
    pattern = _java(pattern)
    rest = x if str(position) in ("1", "1L") else f"substring({x}, cast({position} AS int))"
    return f"get(regexp_extract_all({rest}, {pattern}, {_group(pattern)}), cast({nth} AS int) - 1)"


@rule("REGEXP_EXTRACT_ALL", type="ARRAY")
def regexp_extract_all(x, pattern):
    pattern = _java(pattern)
    return f"regexp_extract_all({x}, {pattern}, {_group(pattern)})"


@rule("REGEXP_INSTR", type="INT64")
def regexp_instr(x, pattern, position="1", nth="1", side="0"):
    pattern = _java(pattern)
    if str(position) in ("1", "1L") and str(nth) in ("1", "1L") and str(side) in ("0", "0L"):
        return f"cast(regexp_instr({x}, {pattern}) AS bigint)"
    return f"ts_regexp_instr({x}, {pattern}, cast({position} AS bigint), cast({nth} AS bigint), cast({side} AS bigint))"


@rule("REGEXP_REPLACE", type="STRING")
def regexp_replace(x, pattern, by):
    """Group references are written \\1 in the dialect and $1 in Spark."""
    pattern, v = _java(pattern), literal(by)
    if isinstance(v, str):
        import re

        text = re.sub(r"\\(\d)", r"${\1}", v.replace("$", "\\$"))
        text = re.sub(r"\$\{(\d)\}", r"$\1", text)
        return f"regexp_replace({x}, {pattern}, {quote(text)})"
    return f"regexp_replace({x}, {pattern}, regexp_replace({by}, '\\\\\\\\([0-9])', '\\\\$$1'))"


@rule("SAFE_CONVERT_BYTES_TO_STRING", type="STRING")
def safe_convert(x):
    return f"make_valid_utf8(cast({x} AS string))"


@rule("TO_CODE_POINTS", type="ARRAY")
def to_code_points(x):
    if x.type == "BYTES":
        return f"transform(regexp_extract_all(hex({x}), '..', 0), _x -> cast(conv(_x, 16, 10) AS bigint))"
    return f"if({x} = '', cast(array() AS array<bigint>), transform(split({x}, ''), _x -> cast(ascii(_x) AS bigint)))"


@rule("TO_BASE64", type="STRING")
def to_base64(x):
    return f"regexp_replace(base64({x}), '[\\r\\n]', '')"


@rule("FORMAT", type="STRING")
def format_(pattern, *args):
    """printf with %t and %T, which write a value as text and as a literal."""
    import re

    v = literal(pattern)
    if not isinstance(v, str):
        raise TypeError("the format must be a literal")
    out, used, k = [], [], 0
    at = 0
    for m in re.finditer(r"%(%|[-+ 0#',]*(?:\d+|\*)?(?:\.(?:\d+|\*))?([a-zA-Z]))", v):
        out.append(v[at : m.start()].replace("%", "%%"))
        at = m.end()
        if m[1] == "%":
            out.append("%%")
            continue
        if k >= len(args):
            raise TypeError("too few arguments for the format")
        kind, a = m[2], args[k]
        k += 1
        flags = m[0][1:-1]
        if kind in "tT":
            text = f"cast({a} AS string)"
            if kind == "T" and a.type == "STRING":
                text = f"concat('\"', {a}, '\"')"
            out.append("%" + flags + "s")
            used.append(text)
        elif kind in "di":
            out.append("%" + flags.replace("'", ",") + "d")
            used.append(f"cast({a} AS bigint)")
        elif kind in "fFeEgG":
            out.append("%" + flags.replace("'", ",") + {"F": "f"}.get(kind, kind))
            used.append(f"cast({a} AS double)")
        elif kind in "xXo":
            out.append("%" + flags + kind)
            used.append(f"cast({a} AS bigint)")
        elif kind == "s":
            out.append("%" + flags + "s")
            used.append(f"{a}")
        elif kind in "pP":
            out.append("%" + flags + "s")
            used.append(f"{a}")
        else:
            raise TypeError(f"no format %{kind}")
    out.append(v[at:].replace("%", "%%"))
    text = f"format_string({', '.join([quote(''.join(out)), *used])})" if out != [""] else "''"
    missing = " OR ".join(f"({a}) IS NULL" for a in args if a)
    return f"if({missing}, NULL, {text})" if missing else text
