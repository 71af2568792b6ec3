"""A query for each scalar function of the surface, over the columns of the test tables."""

from __future__ import annotations

from tessera.plans.dialect import scalar

PART, ORDERS, EVENTS, CUSTOMER, DOCS = ("part", "p_partkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("customer", "c_custkey"), ("documents", "doc_id")

# name: (table, dialect, SQL for comparison)
STRINGS = {
    "ascii": (PART, "ASCII(p_name)", "ascii(p_name)::BIGINT"),
    "byte_length": (DOCS, "BYTE_LENGTH(text)", "octet_length(encode(text))::BIGINT"),
    "char_length": (DOCS, "CHAR_LENGTH(text)", "length(text)::BIGINT"),
    "chr": (PART, "CHR(p_partkey + 300)", "chr((p_partkey + 300)::INTEGER)"),
    "code_points_to_bytes": (PART, "TO_HEX(CODE_POINTS_TO_BYTES([65, MOD(p_partkey, 200)]))", "'41' || lower(lpad(to_hex(p_partkey % 200), 2, '0'))"),
    "code_points_to_string": (PART, "CODE_POINTS_TO_STRING([97, 300 + p_partkey])", "'a' || chr((300 + p_partkey)::INTEGER)"),
    "collate": (PART, "COLLATE(p_brand, 'und:ci')", "lower(p_brand)"),
    "concat": (PART, "CONCAT(p_name, '-', p_brand) || '!'", "p_name || '-' || p_brand || '!'"),
    "contains_substr": (PART, "CONTAINS_SUBSTR(p_name, 'A')", "contains(lower(p_name), 'a')"),
    "ends_with": (PART, "ENDS_WITH(p_name, '1')", "suffix(p_name, '1')"),
    "format": (PART, "FORMAT('%d|%s|%08.3f', p_partkey, p_brand, p_retailprice)", "printf('%d|%s|%08.3f', p_partkey, p_brand, p_retailprice)"),
    "from_base32": (PART, "SAFE_CONVERT_BYTES_TO_STRING(FROM_BASE32(TO_BASE32(CAST(p_brand AS BYTES))))", "p_brand"),
    "from_base64": (PART, "SAFE_CONVERT_BYTES_TO_STRING(FROM_BASE64(TO_BASE64(CAST(p_brand AS BYTES))))", "decode(from_base64(base64(encode(p_brand))))"),
    "from_hex": (PART, "SAFE_CONVERT_BYTES_TO_STRING(FROM_HEX(TO_HEX(CAST(p_brand AS BYTES))))", "decode(unhex(hex(encode(p_brand))))"),
    "initcap": (PART, "INITCAP(LOWER(p_brand))", "upper(lower(p_brand)[1]) || lower(p_brand)[2:]"),
    "instr": (PART, "INSTR(p_name, 'a')", "instr(p_name, 'a')::BIGINT"),
    "left": (PART, "LEFT(p_name, 3)", "left(p_name, 3)"),
    "length": (DOCS, "LENGTH(text)", "length(text)::BIGINT"),
    "lower": (DOCS, "LOWER(text)", "lower(text)"),
    "lpad": (PART, "LPAD(p_brand, 12, '*')", "lpad(p_brand, 12, '*')"),
    "ltrim": (PART, "LTRIM(CONCAT('xx', p_name), 'x')", "ltrim('xx' || p_name, 'x')"),
    "normalize": (DOCS, "NORMALIZE(text, NFC)", "nfc_normalize(text)"),
    "normalize_and_casefold": (PART, "NORMALIZE_AND_CASEFOLD(p_brand)", "lower(p_brand)"),
    "octet_length": (PART, "OCTET_LENGTH(p_name)", "octet_length(encode(p_name))::BIGINT"),
    "regexp_contains": (PART, "REGEXP_CONTAINS(p_name, r'[0-9]{2}')", "regexp_matches(p_name, '[0-9]{2}')"),
    "regexp_extract": (PART, "REGEXP_EXTRACT(p_brand, r'#([0-9])')", "nullif(regexp_extract(p_brand, '#([0-9])', 1), '')"),
    "regexp_extract_all": (PART, "ARRAY_TO_STRING(REGEXP_EXTRACT_ALL(p_name, r'[0-9]'), ',')", "array_to_string(regexp_extract_all(p_name, '[0-9]'), ',')"),
    "regexp_instr": (PART, "REGEXP_INSTR(p_brand, '[0-9]')", "CASE WHEN regexp_matches(p_brand, '[0-9]') THEN length(regexp_extract(p_brand, '^[^0-9]*')) + 1 ELSE 0 END::BIGINT"),
    "regexp_replace": (PART, "REGEXP_REPLACE(p_brand, r'([0-9])', r'<\\1>')", "regexp_replace(p_brand, '([0-9])', '<\\1>', 'g')"),
    "regexp_substr": (PART, "REGEXP_SUBSTR(p_brand, r'[0-9]+')", "nullif(regexp_extract(p_brand, '[0-9]+'), '')"),
    "repeat": (PART, "REPEAT(p_brand, 2)", "repeat(p_brand, 2)"),
    "replace": (PART, "REPLACE(p_name, 'a', 'AA')", "replace(p_name, 'a', 'AA')"),
    "reverse": (PART, "REVERSE(p_name)", "reverse(p_name)"),
    "right": (PART, "RIGHT(p_name, 3)", "right(p_name, 3)"),
    "rpad": (PART, "RPAD(p_brand, 12, '*')", "rpad(p_brand, 12, '*')"),
    "rtrim": (PART, "RTRIM(CONCAT(p_name, 'xx'), 'x')", "rtrim(p_name || 'xx', 'x')"),
    "safe_convert_bytes_to_string": (PART, "SAFE_CONVERT_BYTES_TO_STRING(CAST(p_name AS BYTES))", "p_name"),
    "soundex": (PART, "SOUNDEX(CONCAT('Rob', 'ert'))", "'R163'"),
    "split": (PART, "ARRAY_TO_STRING(SPLIT(p_brand, '#'), '/')", "array_to_string(string_split(p_brand, '#'), '/')"),
    "starts_with": (PART, "STARTS_WITH(p_name, 'p')", "starts_with(p_name, 'p')"),
    "strpos": (PART, "STRPOS(p_name, 'a')", "strpos(p_name, 'a')::BIGINT"),
    "substr": (PART, "SUBSTR(p_name, -3, 2)", "p_name[-3:-2]"),
    "substring": (PART, "SUBSTRING(p_name, 2, 3)", "substring(p_name, 2, 3)"),
    "to_base32": (PART, "TO_BASE32(CODE_POINTS_TO_BYTES([MOD(p_partkey, 8) * 8 + 1]))", "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((p_partkey % 8 * 8 + 1) // 8 + 1)::INTEGER, 1) || 'E======'"),
    "to_base64": (PART, "TO_BASE64(CAST(p_name AS BYTES))", "base64(encode(p_name))"),
    "to_code_points": (PART, "TO_CODE_POINTS(p_brand)[OFFSET(0)]", "unicode(p_brand)::BIGINT"),
    "to_hex": (PART, "TO_HEX(CAST(p_name AS BYTES))", "lower(hex(encode(p_name)))"),
    "translate": (PART, "TRANSLATE(p_brand, 'Bb#', 'Xx-')", "translate(p_brand, 'Bb#', 'Xx-')"),
    "trim": (PART, "TRIM(CONCAT('  ', p_name, ' '))", "trim('  ' || p_name || ' ')"),
    "unicode": (DOCS, "UNICODE(text)", "CASE WHEN text = '' THEN 0 ELSE unicode(text) END::BIGINT"),
    "upper": (DOCS, "UPPER(REPLACE(text, 'ß', 'ss'))", "upper(replace(text, 'ß', 'ss'))"),
}

X = "(p_size / 100.0)"
D = "(p_size / 100.0::DOUBLE)"


def _plain(name: str, low: str = "", oracle: str | None = None) -> tuple:
    x, d = (X, D) if not low else (f"({low} + p_size / 100.0)", f"({low} + p_size / 100.0::DOUBLE)")
    return (PART, f"ROUND({name.upper()}({x}), 9)", f"round({oracle.format(d) if oracle else f'{name}({d})'}, 9)")


NUMBERS = {
    "abs": (CUSTOMER, "ABS(c_acctbal)", "abs(c_acctbal)"),
    **{n: _plain(n) for n in "acos asin asinh atan atanh cos cosh sin sinh tan tanh cbrt exp sqrt".split()},
    "acosh": _plain("acosh", "1"),
    "atan2": (PART, f"ROUND(ATAN2({X}, 2.0), 9)", f"round(atan2({D}, 2.0), 9)"),
    "ceil": (CUSTOMER, "CEIL(c_acctbal)", "ceil(c_acctbal)"),
    "ceiling": (CUSTOMER, "CEILING(c_acctbal)", "ceil(c_acctbal)"),
    "cot": _plain("cot"),
    "coth": _plain("coth", "", "1 / tanh({0})"),
    "csc": _plain("csc", "", "1 / sin({0})"),
    "csch": _plain("csch", "", "1 / sinh({0})"),
    "sec": _plain("sec", "", "1 / cos({0})"),
    "sech": _plain("sech", "", "1 / cosh({0})"),
    "div": (PART, "DIV(p_partkey, 7)", "(p_partkey // 7)::BIGINT"),
    "floor": (CUSTOMER, "FLOOR(c_acctbal)", "floor(c_acctbal)"),
    "greatest": (PART, "GREATEST(p_partkey, 100, NULLIF(p_partkey, 5))", "CASE WHEN p_partkey = 5 THEN NULL ELSE greatest(p_partkey, 100) END::BIGINT"),
    "ieee_divide": (PART, "CAST(IEEE_DIVIDE(p_retailprice, MOD(p_partkey, 2)) = CAST('inf' AS FLOAT64) AS BOOL)", "p_partkey % 2 = 0"),
    "is_inf": (PART, "IS_INF(IEEE_DIVIDE(1.0, MOD(p_partkey, 2)))", "p_partkey % 2 = 0"),
    "is_nan": (PART, "IS_NAN(IEEE_DIVIDE(0.0, MOD(p_partkey, 2)))", "p_partkey % 2 = 0"),
    "least": (PART, "LEAST(p_partkey, 100)", "least(p_partkey, 100)::BIGINT"),
    "ln": _plain("ln"),
    "log": (PART, "ROUND(LOG(p_partkey + 1, 2), 9)", "round(ln(p_partkey + 1) / ln(2), 9)"),
    "log10": _plain("log10"),
    "mod": (PART, "MOD(p_partkey, 7)", "(p_partkey % 7)::BIGINT"),
    "pow": (PART, "POW(p_size, 2)", "pow(p_size, 2)"),
    "power": (PART, "POWER(p_size, 3)", "pow(p_size, 3)"),
    "range_bucket": (PART, "RANGE_BUCKET(p_partkey, [10, 20, 30])", "len(list_filter([10, 20, 30], lambda b: b <= p_partkey))::BIGINT"),
    "round": (CUSTOMER, "ROUND(c_acctbal, 1)", "round(c_acctbal, 1)"),
    "safe_add": (PART, "SAFE_ADD(9223372036854775800, p_partkey)", "CASE WHEN p_partkey <= 7 THEN 9223372036854775800 + p_partkey END::BIGINT"),
    "safe_divide": (PART, "SAFE_DIVIDE(p_partkey, MOD(p_partkey, 3))", "CASE WHEN p_partkey % 3 <> 0 THEN p_partkey / (p_partkey % 3) END"),
    "safe_multiply": (PART, "SAFE_MULTIPLY(p_partkey, 2)", "(p_partkey * 2)::BIGINT"),
    "safe_negate": (PART, "SAFE_NEGATE(p_partkey)", "(-p_partkey)::BIGINT"),
    "safe_subtract": (PART, "SAFE_SUBTRACT(p_partkey, 10)", "(p_partkey - 10)::BIGINT"),
    "sign": (CUSTOMER, "SIGN(c_acctbal)", "sign(c_acctbal)::DOUBLE"),
    "trunc": (CUSTOMER, "ROUND(TRUNC(c_acctbal, 1), 4)", "round(sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10, 4)"),
    "rand": (PART, "RAND() < 1.0", "true"),
}

O = "o_orderdate"  # noqa: E741
DATES = {
    "date": (ORDERS, "DATE(o_orderdate)", "o_orderdate::DATE"),
    "date_parts": (PART, "DATE(2020, 1 + MOD(p_partkey, 12), 28)", "make_date(2020, 1 + (p_partkey % 12), 28)"),
    "datetime": (PART, "DATETIME(2020, 1 + MOD(p_partkey, 12), 28, 10, 20, 30)", "make_timestamp(2020, 1 + (p_partkey % 12), 28, 10, 20, 30.0)"),
    "date_add": (ORDERS, "DATE_ADD(DATE(o_orderdate), INTERVAL 1 MONTH)", "(o_orderdate::DATE + INTERVAL 1 MONTH)::DATE"),
    "date_sub": (ORDERS, "DATE_SUB(DATE(o_orderdate), INTERVAL 3 WEEK)", "(o_orderdate::DATE - INTERVAL 21 DAY)::DATE"),
    "date_diff": (ORDERS, "DATE_DIFF(DATE '2002-01-01', DATE(o_orderdate), MONTH)", "date_diff('month', o_orderdate::DATE, DATE '2002-01-01')"),
    "date_diff_week": (ORDERS, "DATE_DIFF(DATE '2002-01-01', DATE(o_orderdate), ISOWEEK)", "((date_trunc('week', DATE '2002-01-01')::DATE - date_trunc('week', o_orderdate)::DATE) // 7)::BIGINT"),
    "date_from_unix_date": (PART, "DATE_FROM_UNIX_DATE(p_partkey)", "DATE '1970-01-01' + p_partkey::INTEGER"),
    "date_trunc": (ORDERS, "DATE_TRUNC(DATE(o_orderdate), QUARTER)", "date_trunc('quarter', o_orderdate::DATE)::DATE"),
    "date_trunc_week": (ORDERS, "DATE_TRUNC(DATE(o_orderdate), WEEK)", "o_orderdate::DATE - dayofweek(o_orderdate)::INTEGER"),
    "date_trunc_isoyear": (ORDERS, "DATE_TRUNC(DATE(o_orderdate), ISOYEAR)", "date_trunc('week', make_date(isoyear(o_orderdate), 1, 4))::DATE"),
    "datetime_add": (EVENTS, "DATETIME_ADD(ts, INTERVAL 90 MINUTE)", "ts + INTERVAL 90 MINUTE"),
    "datetime_sub": (EVENTS, "DATETIME_SUB(ts, INTERVAL 2 DAY)", "ts - INTERVAL 2 DAY"),
    "datetime_diff": (EVENTS, "DATETIME_DIFF(ts, DATETIME '2024-01-01 00:30:00', HOUR)", "date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts)"),
    "datetime_trunc": (EVENTS, "DATETIME_TRUNC(ts, HOUR)", "date_trunc('hour', ts)"),
    "extract_year": (ORDERS, "EXTRACT(YEAR FROM o_orderdate)", "year(o_orderdate)"),
    "extract_dayofweek": (ORDERS, "EXTRACT(DAYOFWEEK FROM o_orderdate)", "dayofweek(o_orderdate) + 1"),
    "extract_dayofyear": (ORDERS, "EXTRACT(DAYOFYEAR FROM o_orderdate)", "dayofyear(o_orderdate)"),
    "extract_week": (ORDERS, "EXTRACT(WEEK FROM o_orderdate)", "strftime(o_orderdate, '%U')::BIGINT"),
    "extract_isoweek": (ORDERS, "EXTRACT(ISOWEEK FROM o_orderdate)", "weekofyear(o_orderdate)"),
    "extract_isoyear": (ORDERS, "EXTRACT(ISOYEAR FROM o_orderdate)", "isoyear(o_orderdate)"),
    "extract_microsecond": (EVENTS, "EXTRACT(MICROSECOND FROM ts)", "microsecond(ts) % 1000000"),
    "format_date": (ORDERS, "FORMAT_DATE('%a %d %b %Y', DATE(o_orderdate))", "strftime(o_orderdate, '%a %d %b %Y')"),
    "format_datetime": (EVENTS, "FORMAT_DATETIME('%Y/%m/%d %H:%M:%S %j %U', ts)", "strftime(ts, '%Y/%m/%d %H:%M:%S %j %U')"),
    "format_time": (EVENTS, "FORMAT_TIME('%H:%M', EXTRACT(TIME FROM ts))", "strftime(ts, '%H:%M')"),
    "format_timestamp": (EVENTS, "FORMAT_TIMESTAMP('%F %T%Ez', TIMESTAMP(ts))", "strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00'"),
    "generate_date_array": (PART, "ARRAY_LENGTH(GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE_ADD(DATE '2024-01-01', INTERVAL MOD(p_partkey, 9) DAY)))", "(p_partkey % 9 + 1)::BIGINT"),
    "generate_timestamp_array": (PART, "ARRAY_LENGTH(GENERATE_TIMESTAMP_ARRAY(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 06:00:00', INTERVAL 2 HOUR))", "4::BIGINT"),
    "last_day": (ORDERS, "LAST_DAY(DATE(o_orderdate))", "last_day(o_orderdate)"),
    "last_day_week": (ORDERS, "LAST_DAY(DATE(o_orderdate), WEEK)", "o_orderdate::DATE + (6 - dayofweek(o_orderdate))::INTEGER"),
    "parse_date": (ORDERS, "PARSE_DATE('%d.%m.%Y', FORMAT_DATE('%d.%m.%Y', DATE(o_orderdate)))", "o_orderdate::DATE"),
    "parse_datetime": (EVENTS, "PARSE_DATETIME('%Y-%m-%d %H:%M:%S', FORMAT_DATETIME('%Y-%m-%d %H:%M:%S', ts))", "date_trunc('second', ts)"),
    "parse_time": (EVENTS, "FORMAT_TIME('%H:%M', PARSE_TIME('%H:%M', FORMAT_DATETIME('%H:%M', ts)))", "strftime(ts, '%H:%M')"),
    "parse_timestamp": (EVENTS, "UNIX_SECONDS(PARSE_TIMESTAMP('%Y-%m-%d %H:%M:%S', FORMAT_DATETIME('%Y-%m-%d %H:%M:%S', ts)))", "epoch(date_trunc('second', ts))::BIGINT"),
    "string": (EVENTS, "STRING(TIMESTAMP_TRUNC(TIMESTAMP(ts), SECOND))", "strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00'"),
    "time": (EVENTS, "FORMAT_TIME('%T', TIME(EXTRACT(HOUR FROM ts), EXTRACT(MINUTE FROM ts), 5))", "strftime(ts, '%H:%M:05')"),
    "time_add": (EVENTS, "FORMAT_TIME('%R', TIME_ADD(EXTRACT(TIME FROM ts), INTERVAL 45 MINUTE))", "strftime(ts + INTERVAL 45 MINUTE, '%H:%M')"),
    "time_sub": (EVENTS, "FORMAT_TIME('%R', TIME_SUB(EXTRACT(TIME FROM ts), INTERVAL 45 MINUTE))", "strftime(ts - INTERVAL 45 MINUTE, '%H:%M')"),
    "time_diff": (EVENTS, "TIME_DIFF(EXTRACT(TIME FROM ts), TIME '00:00:00', MINUTE)", "(hour(ts) * 60 + minute(ts))::BIGINT"),
    "time_trunc": (EVENTS, "FORMAT_TIME('%T', TIME_TRUNC(EXTRACT(TIME FROM ts), HOUR))", "strftime(ts, '%H:00:00')"),
    "timestamp": (EVENTS, "UNIX_MICROS(TIMESTAMP(ts))", "epoch_us(ts)"),
    "timestamp_add": (EVENTS, "UNIX_SECONDS(TIMESTAMP_ADD(TIMESTAMP(ts), INTERVAL 1 HOUR))", "(epoch_us(ts) // 1000000 + 3600)::BIGINT"),
    "timestamp_sub": (EVENTS, "UNIX_SECONDS(TIMESTAMP_SUB(TIMESTAMP(ts), INTERVAL 1 HOUR))", "(epoch_us(ts) // 1000000 - 3600)::BIGINT"),
    "timestamp_diff": (EVENTS, "TIMESTAMP_DIFF(TIMESTAMP(ts), TIMESTAMP '2024-01-01 00:30:00', HOUR)", "trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:30:00')) / 3600000000)::BIGINT"),
    "timestamp_trunc": (EVENTS, "UNIX_SECONDS(TIMESTAMP_TRUNC(TIMESTAMP(ts), DAY))", "epoch(date_trunc('day', ts))::BIGINT"),
    "timestamp_micros": (EVENTS, "UNIX_MICROS(TIMESTAMP_MICROS(UNIX_MICROS(TIMESTAMP(ts))))", "epoch_us(ts)"),
    "timestamp_millis": (EVENTS, "UNIX_MILLIS(TIMESTAMP_MILLIS(UNIX_MILLIS(TIMESTAMP(ts))))", "(epoch_us(ts) // 1000)::BIGINT"),
    "timestamp_seconds": (EVENTS, "UNIX_SECONDS(TIMESTAMP_SECONDS(UNIX_SECONDS(TIMESTAMP(ts))))", "(epoch_us(ts) // 1000000)::BIGINT"),
    "unix_date": (ORDERS, "UNIX_DATE(DATE(o_orderdate))", "(o_orderdate::DATE - DATE '1970-01-01')::BIGINT"),
    "unix_micros": (EVENTS, "UNIX_MICROS(TIMESTAMP(ts))", "epoch_us(ts)"),
    "unix_millis": (EVENTS, "UNIX_MILLIS(TIMESTAMP(ts))", "(epoch_us(ts) // 1000)::BIGINT"),
    "unix_seconds": (EVENTS, "UNIX_SECONDS(TIMESTAMP(ts))", "(epoch_us(ts) // 1000000)::BIGINT"),
    "current_date": (PART, "CURRENT_DATE() >= DATE '2024-01-01'", "true"),
    "current_datetime": (PART, "CURRENT_DATETIME() >= DATETIME '2024-01-01 00:00:00'", "true"),
    "current_time": (PART, "CURRENT_TIME() >= TIME '00:00:00'", "true"),
    "current_timestamp": (PART, "CURRENT_TIMESTAMP() >= TIMESTAMP '2024-01-01 00:00:00'", "true"),
    "at_time_zone": (EVENTS, "EXTRACT(HOUR FROM TIMESTAMP(ts) AT TIME ZONE '+05:30')", "hour(ts + INTERVAL 330 MINUTE)"),
}

ARRAYS = {
    "array": (PART, "ARRAY(SELECT x * 2 FROM UNNEST([1, 2, 3]) AS x)[OFFSET(1)]", "4::BIGINT"),
    "array_concat": (PART, "ARRAY_LENGTH(ARRAY_CONCAT([p_partkey], [1, 2]))", "3::BIGINT"),
    "array_length": (PART, "ARRAY_LENGTH(SPLIT(p_name, ' '))", "len(string_split(p_name, ' '))::BIGINT"),
    "array_reverse": (PART, "ARRAY_REVERSE([p_partkey, 5])[OFFSET(0)]", "5::BIGINT"),
    "array_to_string": (PART, "ARRAY_TO_STRING([p_name, NULL, p_brand], ',', 'none')", "p_name || ',none,' || p_brand"),
    "generate_array": (PART, "ARRAY_LENGTH(GENERATE_ARRAY(1, MOD(p_partkey, 5), 2))", "len(range(1, (p_partkey % 5) + 1, 2))::BIGINT"),
    "array_first": (PART, "ARRAY_FIRST(SPLIT(p_name, ' '))", "string_split(p_name, ' ')[1]"),
    "array_last": (PART, "ARRAY_LAST(SPLIT(p_name, ' '))", "string_split(p_name, ' ')[-1]"),
    "array_offset": (PART, "[p_partkey, 7][OFFSET(1)]", "7::BIGINT"),
    "array_ordinal": (PART, "[p_partkey, 7][ORDINAL(1)]", "p_partkey::BIGINT"),
    "array_safe_offset": (PART, "[p_partkey, 7][SAFE_OFFSET(9)]", "NULL::BIGINT"),
    "array_safe_ordinal": (PART, "[p_partkey, 7][SAFE_ORDINAL(2)]", "7::BIGINT"),
}

JSON = {
    "json_extract": (EVENTS, "JSON_EXTRACT(props, '$.k')", "json_extract(props, '$.k')::VARCHAR"),
    "json_extract_scalar": (EVENTS, "JSON_EXTRACT_SCALAR(props, '$.k')", "json_extract_string(props, '$.k')"),
    "json_extract_array": (EVENTS, "ARRAY_LENGTH(JSON_EXTRACT_ARRAY(CONCAT('[', props, ',2]')))", "2::BIGINT"),
    "json_extract_string_array": (EVENTS, "JSON_EXTRACT_STRING_ARRAY('[\"a\",\"b\"]')[OFFSET(1)]", "'b'"),
    "json_query": (EVENTS, "JSON_QUERY(CONCAT('{\"a\":', props, '}'), '$.a')", "json_extract('{\"a\":' || props || '}', '$.a')::VARCHAR"),
    "json_query_array": (EVENTS, "JSON_QUERY_ARRAY('{\"a\":[1,\"x\"]}', '$.a')[OFFSET(1)]", "'\"x\"'"),
    "json_value": (EVENTS, "JSON_VALUE(props, '$.k')", "json_extract_string(props, '$.k')"),
    "json_value_array": (EVENTS, "JSON_VALUE_ARRAY(CONCAT('[\"', event_type, '\",\"b\"]'))[OFFSET(0)]", "event_type"),
    "json_type": (EVENTS, "JSON_TYPE(props)", "lower(json_type(props))"),
    "json_object": (EVENTS, "JSON_OBJECT('id', event_id, 'type', event_type)", "json_object('id', event_id, 'type', event_type)::VARCHAR"),
    "json_array": (EVENTS, "JSON_ARRAY(event_id, event_type)", "json_array(event_id, event_type)::VARCHAR"),
    "json_array_insert": (EVENTS, "JSON_ARRAY_INSERT(JSON '[1,2]', '$[1]', event_id)", "'[1,' || event_id || ',2]'"),
    "json_remove": (EVENTS, "JSON_REMOVE(JSON_OBJECT('a', event_id, 'b', event_type), '$.a')", "'{\"b\":\"' || event_type || '\"}'"),
    "json_set": (EVENTS, "JSON_SET(JSON '{\"a\":1}', '$.b', event_id)", "'{\"a\":1,\"b\":' || event_id || '}'"),
    "json_strip_nulls": (EVENTS, "JSON_STRIP_NULLS(JSON_OBJECT('a', NULL, 'b', event_id))", "'{\"b\":' || event_id || '}'"),
    "json_keys": (EVENTS, "JSON_KEYS(props)[OFFSET(0)]", "json_keys(props)[1]"),
    "parse_json": (EVENTS, "JSON_VALUE(PARSE_JSON(props), '$.k')", "json_extract_string(props, '$.k')"),
    "to_json": (EVENTS, "TO_JSON(STRUCT(event_id AS id))", "'{\"id\":' || event_id || '}'"),
    "to_json_string": (EVENTS, "TO_JSON_STRING(STRUCT(event_id AS id, NULL AS n))", "'{\"id\":' || event_id || ',\"n\":null}'"),
    "json_bool": (EVENTS, "BOOL(JSON 'true')", "true"),
    "json_float64": (EVENTS, "FLOAT64(JSON '2.5')", "2.5::DOUBLE"),
    "json_int64": (EVENTS, "INT64(JSON_QUERY(props, '$.k'))", "json_extract(props, '$.k')::BIGINT"),
    "json_string": (EVENTS, "STRING(PARSE_JSON(CONCAT('\"', event_type, '\"')))", "event_type"),
    "lax_bool": (EVENTS, "LAX_BOOL(JSON '\"true\"')", "true"),
    "lax_float64": (EVENTS, "LAX_FLOAT64(JSON '\"1.5\"')", "1.5::DOUBLE"),
    "lax_int64": (EVENTS, "LAX_INT64(JSON_QUERY(props, '$.k'))", "json_extract(props, '$.k')::BIGINT"),
    "lax_string": (EVENTS, "LAX_STRING(JSON_QUERY(props, '$.k'))", "json_extract_string(props, '$.k')"),
}

OTHERS = {
    "cast": (PART, "CAST(p_retailprice AS INT64)", "round(p_retailprice)::BIGINT"),
    "cast_string": (PART, "CAST(p_size + 0.5 AS STRING)", "p_size || '.5'"),
    "safe_cast": (PART, "SAFE_CAST(p_name AS INT64)", "try_cast(p_name AS BIGINT)"),
    "parse_numeric": (PART, "PARSE_NUMERIC(CONCAT(CAST(p_partkey AS STRING), '.25'))", "(p_partkey || '.25')::DECIMAL(38,9)"),
    "parse_bignumeric": (PART, "CAST(PARSE_BIGNUMERIC('1.5') * 2 AS INT64)", "3::BIGINT"),
    "coalesce": (PART, "COALESCE(NULLIF(p_partkey, 5), -1)", "coalesce(nullif(p_partkey, 5), -1)::BIGINT"),
    "if": (PART, "IF(p_size > 25, 'big', 'small')", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
    "ifnull": (PART, "IFNULL(NULLIF(p_brand, 'Brand#11'), 'none')", "coalesce(nullif(p_brand, 'Brand#11'), 'none')"),
    "nullif": (PART, "NULLIF(p_size, 10)", "nullif(p_size, 10)"),
    "farm_fingerprint": (PART, "FARM_FINGERPRINT('hello')", "-5436999610281751320::BIGINT"),
    "md5": (PART, "TO_HEX(MD5(p_name))", "md5(p_name)"),
    "sha1": (PART, "TO_HEX(SHA1(p_name))", "sha1(p_name)"),
    "sha256": (PART, "TO_HEX(SHA256(p_name))", "sha256(p_name)"),
    "sha512": (PART, "LENGTH(SHA512(p_name))", "64::BIGINT"),
    "session_user": (PART, "SESSION_USER()", "'user@example.com'"),
    "current_user": (PART, "CURRENT_USER()", "'user@example.com'"),
    "generate_uuid": (PART, "LENGTH(GENERATE_UUID())", "36::BIGINT"),
    "make_interval": (PART, "EXTRACT(DAY FROM MAKE_INTERVAL(day => p_size))", "p_size::BIGINT"),
    "justify_days": (PART, "EXTRACT(MONTH FROM JUSTIFY_DAYS(MAKE_INTERVAL(day => p_size)))", "(p_size // 30)::BIGINT"),
    "justify_hours": (PART, "EXTRACT(DAY FROM JUSTIFY_HOURS(MAKE_INTERVAL(hour => p_size)))", "(p_size // 24)::BIGINT"),
    "justify_interval": (PART, "EXTRACT(MONTH FROM JUSTIFY_INTERVAL(MAKE_INTERVAL(day => p_size, hour => 30)))", "((p_size + 1) // 30)::BIGINT"),
    "interval_text": (PART, "CAST(MAKE_INTERVAL(day => p_size, minute => 5) AS STRING)", "'0-0 ' || p_size || ' 0:5:0'"),
    "range": (ORDERS, "RANGE_START(RANGE(DATE(o_orderdate), NULL))", "o_orderdate::DATE"),
    "range_contains": (ORDERS, "RANGE_CONTAINS(RANGE<DATE> '[1996-01-01, 1997-01-01)', DATE(o_orderdate))", "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"),
    "range_end": (ORDERS, "RANGE_END(RANGE(DATE '1990-01-01', DATE(o_orderdate)))", "o_orderdate::DATE"),
    "range_intersect": (ORDERS, "RANGE_START(RANGE_INTERSECT(RANGE(DATE(o_orderdate), DATE '2003-01-01'), RANGE(DATE '1997-01-01', NULL)))", "greatest(o_orderdate::DATE, DATE '1997-01-01')"),
    "range_overlaps": (ORDERS, "RANGE_OVERLAPS(RANGE(DATE(o_orderdate), DATE_ADD(DATE(o_orderdate), INTERVAL 30 DAY)), RANGE(DATE '1997-01-01', DATE '1997-02-01'))", "o_orderdate::DATE < DATE '1997-02-01' AND o_orderdate::DATE + 30 > DATE '1997-01-01'"),
    "range_start": (ORDERS, "RANGE_START(RANGE(DATE(o_orderdate), NULL))", "o_orderdate::DATE"),
    "generate_range_array": (PART, "ARRAY_LENGTH(GENERATE_RANGE_ARRAY(RANGE(DATE '2024-01-01', DATE_ADD(DATE '2024-01-01', INTERVAL p_size DAY)), INTERVAL 7 DAY))", "ceil(p_size / 7)::BIGINT"),
}

LON, LAT = "(c_custkey / 100.0)", "(c_nationkey * 2.0)"
P = f"ST_GEOGPOINT({LON}, {LAT})"
BOX = "ST_GEOGFROMTEXT('POLYGON((0 0, 10 0, 10 20, 0 20, 0 0))')"
LON_, LAT_ = "(c_custkey / 100.0::DOUBLE)", "(c_nationkey * 2.0::DOUBLE)"
INSIDE = f"({LON_} > 0 AND {LON_} < 10 AND {LAT_} > 0 AND {LAT_} < 20)"
ONEDGE = f"({LON_} >= 0 AND {LON_} <= 10 AND {LAT_} >= 0 AND {LAT_} <= 20)"
L2 = "ST_GEOGFROMTEXT('LINESTRING(0 0, 3 0, 3 4)')"
A, B = "ST_GEOGFROMTEXT('POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))')", "ST_GEOGFROMTEXT('POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))')"
GEOGRAPHY = {
    "st_geogpoint": (CUSTOMER, f"ST_X({P})", LON_),
    "st_geogfromtext": (CUSTOMER, f"ST_ASTEXT(ST_GEOGFROMTEXT('point( 1   2.50 )'))", "'POINT(1 2.5)'"),
    "st_geogfromgeojson": (CUSTOMER, "ST_ASTEXT(ST_GEOGFROMGEOJSON('{\"type\":\"Point\",\"coordinates\":[1,2]}'))", "'POINT(1 2)'"),
    "st_geogfromwkb": (CUSTOMER, f"ST_ASTEXT(ST_GEOGFROMWKB(ST_ASBINARY({A})))", "'POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))'"),
    "st_astext": (CUSTOMER, "ST_ASTEXT(ST_GEOGPOINT(c_custkey, 1))", "'POINT(' || c_custkey || ' 1)'"),
    "st_asgeojson": (CUSTOMER, "ST_ASGEOJSON(ST_GEOGPOINT(MOD(c_custkey, 90), 2))", "'{\"type\": \"Point\", \"coordinates\": [' || c_custkey % 90 || '.0, 2.0]}'"),
    "st_asbinary": (CUSTOMER, "LENGTH(ST_ASBINARY(ST_GEOGPOINT(1, 2)))", "21::BIGINT"),
    "st_boundary": (CUSTOMER, f"ST_ASTEXT(ST_BOUNDARY({A}))", "'LINESTRING(0 0, 2 0, 2 2, 0 2, 0 0)'"),
    "st_centroid": (CUSTOMER, f"ST_ASTEXT(ST_CENTROID({A}))", "'POINT(1 1)'"),
    "st_closestpoint": (CUSTOMER, "ST_ASTEXT(ST_CLOSESTPOINT(ST_GEOGFROMTEXT('LINESTRING(0 0, 4 0)'), ST_GEOGPOINT(MOD(c_custkey, 4), 3)))", "'POINT(' || c_custkey % 4 || ' 0)'"),
    "st_convexhull": (CUSTOMER, "ST_ASTEXT(ST_CONVEXHULL(ST_GEOGFROMTEXT('MULTIPOINT(0 0, 2 0, 2 2, 0 2, 1 1)')))", "'POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))'"),
    "st_difference": (CUSTOMER, f"ST_ASTEXT(ST_DIFFERENCE({A}, {B}))", "'POLYGON((0 0, 2 0, 2 1, 1 1, 1 2, 0 2, 0 0))'"),
    "st_dump": (CUSTOMER, "ARRAY_LENGTH(ST_DUMP(ST_GEOGFROMTEXT('MULTIPOINT(0 0, 1 1)')))", "2::BIGINT"),
    "st_dwithin": (CUSTOMER, f"ST_DWITHIN({P}, ST_GEOGPOINT(0, 0), 2000000)", f"2 * 6371010 * asin(sqrt(pow(sin(radians({LAT_}) / 2), 2) + cos(radians({LAT_})) * pow(sin(radians({LON_}) / 2), 2))) <= 2000000"),
    "st_dimension": (CUSTOMER, f"ST_DIMENSION({A})", "2::BIGINT"),
    "st_disjoint": (CUSTOMER, f"ST_DISJOINT({P}, {BOX})", f"NOT {ONEDGE}"),
    "st_distance": (CUSTOMER, f"ROUND(ST_DISTANCE({P}, ST_GEOGPOINT(0, 0)), 2)", f"round(2 * 6371010 * asin(sqrt(pow(sin(radians({LAT_}) / 2), 2) + cos(radians({LAT_})) * pow(sin(radians({LON_}) / 2), 2))), 2)"),
    "st_equals": (CUSTOMER, f"ST_EQUALS({A}, ST_GEOGFROMTEXT('POLYGON((2 2, 0 2, 0 0, 2 0, 2 2))'))", "true"),
    "st_intersection": (CUSTOMER, f"ST_ASTEXT(ST_INTERSECTION({A}, {B}))", "'POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))'"),
    "st_intersects": (CUSTOMER, f"ST_INTERSECTS({P}, {BOX})", ONEDGE),
    "st_intersectsbox": (CUSTOMER, f"ST_INTERSECTSBOX({P}, 0, 0, 10, 20)", ONEDGE),
    "st_isclosed": (CUSTOMER, f"ST_ISCLOSED({L2})", "false"),
    "st_iscollection": (CUSTOMER, "ST_ISCOLLECTION(ST_GEOGFROMTEXT('MULTIPOINT(0 0, 1 1)'))", "true"),
    "st_isempty": (CUSTOMER, f"ST_ISEMPTY({P})", "false"),
    "st_isring": (CUSTOMER, "ST_ISRING(ST_GEOGFROMTEXT('LINESTRING(0 0, 1 0, 1 1, 0 0)'))", "true"),
    "st_length": (CUSTOMER, "ROUND(ST_LENGTH(ST_MAKELINE(ST_GEOGPOINT(0, 0), ST_GEOGPOINT(0, MOD(c_custkey, 80)))), 3)", "round(6371010 * radians(c_custkey % 80), 3)"),
    "st_makeline": (CUSTOMER, "ST_ASTEXT(ST_MAKELINE(ST_GEOGPOINT(1, 1), ST_GEOGPOINT(c_custkey, 2)))", "'LINESTRING(1 1, ' || c_custkey || ' 2)'"),
    "st_makepolygon": (CUSTOMER, "ST_ASTEXT(ST_MAKEPOLYGON(ST_GEOGFROMTEXT('LINESTRING(0 0, 1 0, 1 1, 0 0)')))", "'POLYGON((0 0, 1 0, 1 1, 0 0))'"),
    "st_makepolygonoriented": (CUSTOMER, "ST_ASTEXT(ST_MAKEPOLYGONORIENTED([ST_GEOGFROMTEXT('LINESTRING(0 0, 1 0, 1 1, 0 0)')]))", "'POLYGON((0 0, 1 0, 1 1, 0 0))'"),
    "st_maxdistance": (CUSTOMER, "ROUND(ST_MAXDISTANCE(ST_GEOGPOINT(0, 0), ST_GEOGPOINT(0, MOD(c_custkey, 80))), 3)", "round(6371010 * radians(c_custkey % 80), 3)"),
    "st_npoints": (CUSTOMER, f"ST_NPOINTS({L2})", "3::BIGINT"),
    "st_perimeter": (CUSTOMER, "ROUND(ST_PERIMETER(ST_GEOGFROMTEXT('POLYGON((0 0, 90 0, 0 90, 0 0))')), 2)", "round(3 * 6371010 * radians(90), 2)"),
    "st_pointn": (CUSTOMER, f"ST_ASTEXT(ST_POINTN({L2}, 2))", "'POINT(3 0)'"),
    "st_simplify": (CUSTOMER, "ST_ASTEXT(ST_SIMPLIFY(ST_GEOGFROMTEXT('LINESTRING(0 0, 1 0.0000001, 2 0)'), 100))", "'LINESTRING(0 0, 2 0)'"),
    "st_snaptogrid": (CUSTOMER, "ST_ASTEXT(ST_SNAPTOGRID(ST_GEOGPOINT(MOD(c_custkey, 80) + 0.2, 2.38), 1))", "'POINT(' || c_custkey % 80 || ' 2)'"),
    "st_touches": (CUSTOMER, "ST_TOUCHES(ST_GEOGFROMTEXT('POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))'), ST_GEOGFROMTEXT('POLYGON((1 0, 2 0, 2 1, 1 1, 1 0))'))", "true"),
    "st_union": (CUSTOMER, f"ST_ASTEXT(ST_UNION({A}, {B}))", "'POLYGON((0 0, 2 0, 2 1, 3 1, 3 3, 1 3, 1 2, 0 2, 0 0))'"),
    "st_within": (CUSTOMER, f"ST_WITHIN({P}, {BOX})", INSIDE),
    "st_x": (CUSTOMER, f"ST_X({P})", LON_),
    "st_y": (CUSTOMER, f"ST_Y({P})", LAT_),
    "st_area": (CUSTOMER, "ROUND(ST_AREA(ST_GEOGFROMTEXT('POLYGON((0 0, 90 0, 0 90, 0 0))')) / 1e6, 3)", "round(pi() / 2 * pow(6371010::DOUBLE, 2) / 1e6, 3)"),
    "st_buffer": (CUSTOMER, "ROUND(ST_AREA(ST_BUFFER(ST_GEOGPOINT(5, 5), 1000)) / 1e6, 1)", "3.1::DOUBLE"),
    "st_contains": (CUSTOMER, f"ST_CONTAINS({BOX}, {P})", INSIDE),
    "st_covers": (CUSTOMER, f"ST_COVERS({BOX}, {P})", ONEDGE),
    "st_coveredby": (CUSTOMER, f"ST_COVEREDBY({P}, {BOX})", ONEDGE),
}

TYPES = {
    "int64": (PART, "CAST(CAST(p_partkey AS STRING) AS INT64) * 1000000007", "(p_partkey * 1000000007)::BIGINT"),
    "float64": (PART, "CAST(p_size AS FLOAT64) / 4", "p_size::DOUBLE / 4"),
    "numeric": (PART, "CAST(p_size AS NUMERIC)", "p_size::DECIMAL(38,9)"),
    "numeric_division": (PART, "CAST(p_size AS NUMERIC) / NUMERIC '8'", "(p_size / 8.0)::DECIMAL(38,9)"),
    "bignumeric": (PART, "CAST(p_size AS BIGNUMERIC)", "p_size::DECIMAL(38,18)"),
    "bool": (PART, "CAST(p_size > 10 AS BOOL)", "p_size > 10"),
    "string": (PART, "CAST(p_size AS STRING)", "p_size::VARCHAR"),
    "bytes": (PART, "TO_HEX(CAST(p_brand AS BYTES))", "lower(hex(encode(p_brand)))"),
    "date": (ORDERS, "CAST(o_orderdate AS DATE)", "o_orderdate::DATE"),
    "time": (EVENTS, "CAST(EXTRACT(TIME FROM DATETIME_TRUNC(ts, SECOND)) AS STRING)", "strftime(ts, '%H:%M:%S')"),
    "datetime": (EVENTS, "CAST(ts AS DATETIME)", "ts"),
    "timestamp": (EVENTS, "UNIX_MICROS(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"),
    "interval": (PART, "CAST(INTERVAL 1 DAY AS STRING)", "'0-0 1 0:0:0'"),
    "range": (ORDERS, "RANGE_END(RANGE(DATE(o_orderdate), DATE '2010-01-01'))", "DATE '2010-01-01'"),
    "geography": (CUSTOMER, "ST_ASTEXT(ST_GEOGPOINT(c_custkey, 0))", "'POINT(' || c_custkey || ' 0)'"),
    "json": (EVENTS, "JSON_TYPE(JSON '[1]')", "'array'"),
    "array": (PART, "ARRAY<INT64>[1, p_size][OFFSET(1)]", "p_size::BIGINT"),
    "struct": (PART, "STRUCT(p_size AS a, p_name AS b).b", "p_name"),
}
MORE = {
    "bit_count": (PART, "BIT_COUNT(p_partkey)", "bit_count(p_partkey)::BIGINT"),
    "safe_prefix": (PART, "SAFE.PARSE_DATE('%Y', p_name)", "NULL::DATE"),
    "interval_literal": (PART, "CAST(INTERVAL '1-2 3 4:5:6' YEAR TO SECOND AS STRING)", "'1-2 3 4:5:6'"),
    "date_minus_days": (ORDERS, "DATE(o_orderdate) - INTERVAL 5 DAY", "(o_orderdate - INTERVAL 5 DAY)::DATE"),
    "json_subscript": (EVENTS, "JSON '{\"a\":[1,2]}'.a[1]", "'2'"),
    "st_geometrytype": (CUSTOMER, f"ST_GEOMETRYTYPE({A})", "'ST_Polygon'"),
    "st_startpoint": (CUSTOMER, f"ST_ASTEXT(ST_STARTPOINT({L2}))", "'POINT(0 0)'"),
    "st_endpoint": (CUSTOMER, f"ST_ASTEXT(ST_ENDPOINT({L2}))", "'POINT(3 4)'"),
    "st_isvalid": (CUSTOMER, f"ST_ISVALID({A})", "true"),
    "st_envelope": (CUSTOMER, f"ST_ASTEXT(ST_ENVELOPE({L2}))", "'POLYGON((0 0, 3 0, 3 4, 0 4, 0 0))'"),
    "st_boundingbox": (CUSTOMER, f"ST_BOUNDINGBOX({L2}).ymax", "4::DOUBLE"),
}

for _group, _items in (("type", TYPES), ("more", MORE), ("string", STRINGS), ("math", NUMBERS), ("datetime", DATES), ("array", ARRAYS), ("json", JSON), ("scalar", OTHERS), ("geo", GEOGRAPHY)):
    for _name, ((_table, _key), _dialect, _oracle) in _items.items():
        scalar(f"{_group}_{_name}", _table, _key, _dialect, _oracle)
