"""Queries that run DML, DDL, scripts, routines, time travel, policies, catalog views, jobs and streams.

Each builds a warehouse of its own in the shared folder from the test tables, runs statements, and returns rows
whose SQL equivalent over the plain tables is given beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.plans import errors
from tessera.plans.registry import TABLES, add, load
from tessera.session import configure, scratch_path
from tessera.sources import files
from tessera.streaming import ingest, windows


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    configure(spark)
    e = Engine(spark, scratch_path(spark, "warehouse"))
    for t in TABLES:
        e.views[t] = _Lazy(spark, sf_dir, t)
    e.sql("CREATE SCHEMA d")
    return e


class _Lazy:
    """A table that is only opened when a statement names it."""

    def __init__(self, spark, sf_dir, name):
        self.open = lambda: load(spark, sf_dir, name)

    def createOrReplaceTempView(self, name):  # noqa: N802
        self.open().createOrReplaceTempView(name)


def script(name: str, text: str, oracle: str | None) -> None:
    add(name, oracle)(lambda spark, sf_dir: engine(spark, sf_dir).sql(text))


N = "CREATE TABLE d.n AS SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation;"
ALL = "SELECT k, name, r FROM d.n"
BASE = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"

SCRIPTS = {
    "dml_insert_values": (f"{N} INSERT INTO d.n (k, name, r) VALUES (100, 'a', 1), (101, NULL, 2); {ALL}", f"{BASE} UNION ALL SELECT 100, 'a', 1 UNION ALL SELECT 101, NULL, 2"),
    "dml_insert_select": (f"{N} INSERT INTO d.n SELECT k + 50, name, r FROM d.n WHERE r = 1; {ALL}", f"{BASE} UNION ALL SELECT n_nationkey + 50, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"),
    "dml_update": (f"{N} UPDATE d.n SET name = LOWER(name) WHERE r = 2; {ALL}", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS name, n_regionkey AS r FROM nation"),
    "dml_update_from": (f"{N} UPDATE d.n SET name = s.r_name FROM region AS s WHERE n.r = s.r_regionkey AND s.r_regionkey < 2; {ALL}", "SELECT n_nationkey AS k, CASE WHEN r_regionkey < 2 THEN r_name ELSE n_name END AS name, n_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "dml_delete": (f"{N} DELETE FROM d.n WHERE r = 3 OR name IS NULL; {ALL}", f"{BASE} WHERE n_regionkey <> 3"),
    "dml_merge": (
        f"""{N} MERGE d.n AS t USING (SELECT n_nationkey + 10 AS k, 'new' AS name FROM nation) AS s ON t.k = s.k
        WHEN MATCHED AND t.r = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET name = CONCAT(t.name, '*') WHEN NOT MATCHED THEN INSERT (k, name) VALUES (s.k, s.name); {ALL}""",
        """SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 10 THEN n_name || '*' ELSE n_name END AS name, n_regionkey AS r FROM nation WHERE NOT (n_nationkey >= 10 AND n_regionkey = 0)
        UNION ALL SELECT n_nationkey + 10, 'new', NULL FROM nation WHERE n_nationkey + 10 > 24""",
    ),
    "dml_truncate": (f"{N} TRUNCATE TABLE d.n; {ALL}", f"{BASE} WHERE false"),
    "ddl_create_table": ("CREATE TABLE d.t (a INT64 NOT NULL, b STRING DEFAULT 'x', c ARRAY<INT64>) OPTIONS(description='t'); INSERT INTO d.t (a) VALUES (1), (2); SELECT a, b, ARRAY_LENGTH(c) AS c FROM d.t", "SELECT * FROM (VALUES (1::BIGINT, 'x', NULL::BIGINT), (2, 'x', NULL)) AS t(a, b, c)"),
    "ddl_ctas": (f"{N} {ALL}", BASE),
    "ddl_ctas_with_schema": ("CREATE TABLE d.t (a STRING, b FLOAT64) AS SELECT n_nationkey, n_regionkey FROM nation; SELECT a, b FROM d.t", "SELECT n_nationkey::VARCHAR AS a, n_regionkey::DOUBLE AS b FROM nation"),
    "ddl_create_view": (f"{N} CREATE VIEW d.v AS SELECT k FROM d.n WHERE r = 1; SELECT k FROM d.v", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1"),
    "ddl_create_materialized_view": (f"{N} CREATE MATERIALIZED VIEW d.m AS SELECT r, COUNT(*) AS n FROM d.n GROUP BY r; SELECT r, n FROM d.m", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1"),
    "ddl_refresh_materialized_view": (f"{N} CREATE MATERIALIZED VIEW d.m AS SELECT COUNT(*) AS n FROM d.n; DELETE FROM d.n WHERE r = 0; CALL BQ.REFRESH_MATERIALIZED_VIEW('d.m'); SELECT n FROM d.m", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0"),
    "ddl_create_snapshot": (f"{N} CREATE SNAPSHOT TABLE d.s CLONE d.n; DELETE FROM d.n WHERE TRUE; SELECT k, name, r FROM d.s", BASE),
    "ddl_create_clone": (f"{N} CREATE TABLE d.c CLONE d.n; DELETE FROM d.c WHERE r = 1; SELECT k, name, r FROM d.c", f"{BASE} WHERE n_regionkey <> 1"),
    "ddl_create_schema": ("CREATE SCHEMA e; CREATE SCHEMA IF NOT EXISTS e; SELECT schema_name FROM INFORMATION_SCHEMA.SCHEMATA", "SELECT * FROM (VALUES ('d'), ('e')) AS t(schema_name)"),
    "ddl_drop_schema": ("CREATE SCHEMA e; DROP SCHEMA e CASCADE; SELECT schema_name FROM INFORMATION_SCHEMA.SCHEMATA", "SELECT 'd' AS schema_name"),
    "ddl_drop_table": (f"{N} DROP TABLE d.n; DROP TABLE IF EXISTS d.n; SELECT COUNT(*) AS n FROM d.INFORMATION_SCHEMA.TABLES", "SELECT 0::BIGINT AS n"),
    "ddl_drop_view": (f"{N} CREATE VIEW d.v AS SELECT k FROM d.n; DROP VIEW d.v; SELECT table_name FROM d.INFORMATION_SCHEMA.TABLES", "SELECT 'n' AS table_name"),
    "ddl_drop_materialized_view": (f"{N} CREATE MATERIALIZED VIEW d.m AS SELECT COUNT(*) AS n FROM d.n; DROP MATERIALIZED VIEW d.m; SELECT table_name FROM d.INFORMATION_SCHEMA.TABLES", "SELECT 'n' AS table_name"),
    "ddl_drop_snapshot": (f"{N} CREATE SNAPSHOT TABLE d.s CLONE d.n; DROP SNAPSHOT TABLE d.s; SELECT table_name FROM d.INFORMATION_SCHEMA.TABLES", "SELECT 'n' AS table_name"),
    "ddl_add_column": (f"{N} ALTER TABLE d.n ADD COLUMN z INT64; SELECT k, z FROM d.n", "SELECT n_nationkey AS k, NULL::BIGINT AS z FROM nation"),
    "ddl_drop_column": (f"{N} ALTER TABLE d.n DROP COLUMN name; SELECT * FROM d.n", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation"),
    "ddl_rename": (f"{N} ALTER TABLE d.n RENAME TO m; SELECT k FROM d.m", "SELECT n_nationkey AS k FROM nation"),
    "ddl_create_function": (f"{N} CREATE FUNCTION d.plus(x INT64, y INT64) RETURNS INT64 AS (x + y * 2); SELECT k, d.plus(k, r) AS v FROM d.n", "SELECT n_nationkey AS k, (n_nationkey + n_regionkey * 2)::BIGINT AS v FROM nation"),
    "ddl_create_table_function": (f"{N} CREATE TABLE FUNCTION d.f(x INT64) AS SELECT k, name FROM d.n WHERE r = x; SELECT k, name FROM d.f(2)", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 2"),
    "ddl_create_procedure": ("CREATE PROCEDURE d.p(IN a INT64, OUT b INT64) BEGIN SET b = a * 7; END; BEGIN DECLARE v INT64; CALL d.p(6, v); SELECT v AS v; END", "SELECT 42::BIGINT AS v"),
    "ddl_drop_function": ("CREATE FUNCTION d.f(x INT64) AS (x); DROP FUNCTION d.f; DROP FUNCTION IF EXISTS d.f; SELECT 1 AS ok", "SELECT 1::BIGINT AS ok"),
    "ddl_drop_table_function": (f"{N} CREATE TABLE FUNCTION d.f(x INT64) AS SELECT k FROM d.n; DROP TABLE FUNCTION d.f; SELECT 1 AS ok", "SELECT 1::BIGINT AS ok"),
    "ddl_drop_procedure": ("CREATE PROCEDURE d.p() BEGIN SELECT 1; END; DROP PROCEDURE d.p; SELECT 1 AS ok", "SELECT 1::BIGINT AS ok"),
    "ddl_row_access_policy": (f"{N} CREATE ROW ACCESS POLICY p ON d.n GRANT TO ('domain:example.com') FILTER USING (r = 1); CREATE ROW ACCESS POLICY q ON d.n GRANT TO ('user:nobody@x.org') FILTER USING (TRUE); {ALL}", f"{BASE} WHERE n_regionkey = 1"),
    "wildcard_tables": ("CREATE TABLE d.y_1 AS SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1; CREATE TABLE d.y_2 AS SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2; SELECT k, _TABLE_SUFFIX AS s FROM `d.y_*`", "SELECT n_nationkey AS k, n_regionkey::VARCHAR AS s FROM nation WHERE n_regionkey IN (1, 2)"),
    "table_suffix": ("CREATE TABLE d.y_1 AS SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1; CREATE TABLE d.y_2 AS SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2; SELECT k FROM `d.y_*` WHERE _TABLE_SUFFIX BETWEEN '2' AND '3'", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2"),
    "partition_pruning": ("CREATE TABLE d.o PARTITION BY day AS SELECT DATE(o_orderdate) AS day, o_orderkey AS k FROM orders; SELECT k FROM d.o WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-02-01'", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-02-01'"),
    "time_travel": (f"{N} CREATE TABLE d.stamp AS SELECT CURRENT_TIMESTAMP() AS t; BEGIN DECLARE t TIMESTAMP DEFAULT (SELECT t FROM d.stamp); DELETE FROM d.n WHERE TRUE; SELECT k, name, r FROM d.n FOR SYSTEM_TIME AS OF t; END", BASE),
    "script_declare_set": ("DECLARE a, b INT64 DEFAULT 2; SET a = a + 3; SET (a, b) = (SELECT AS STRUCT a * 2, b + 1); SELECT a AS a, b AS b", "SELECT 10::BIGINT AS a, 3::BIGINT AS b"),
    "script_if": ("DECLARE n INT64 DEFAULT (SELECT COUNT(*) FROM nation); IF n > 100 THEN SELECT 'many' AS r; ELSEIF n > 10 THEN SELECT 'some' AS r; ELSE SELECT 'few' AS r; END IF", "SELECT 'some' AS r"),
    "script_while": ("DECLARE i, s INT64 DEFAULT 0; WHILE i < 10 DO SET i = i + 1; SET s = s + i; END WHILE; SELECT s AS s", "SELECT 55::BIGINT AS s"),
    "script_loop_break": ("DECLARE i INT64 DEFAULT 1; LOOP SET i = i * 3; IF i > 50 THEN BREAK; END IF; END LOOP; SELECT i AS i", "SELECT 81::BIGINT AS i"),
    "script_continue": ("DECLARE i, s INT64 DEFAULT 0; WHILE i < 6 DO SET i = i + 1; IF MOD(i, 2) = 0 THEN CONTINUE; END IF; SET s = s + i; END WHILE; SELECT s AS s", "SELECT 9::BIGINT AS s"),
    "script_repeat": ("DECLARE i INT64 DEFAULT 0; REPEAT SET i = i + 2; UNTIL i >= 7 END REPEAT; SELECT i AS i", "SELECT 8::BIGINT AS i"),
    "script_for": ("DECLARE s INT64 DEFAULT 0; FOR row IN (SELECT r_regionkey AS k FROM region) DO SET s = s + row.k; END FOR; SELECT s AS s", "SELECT sum(r_regionkey)::BIGINT AS s FROM region"),
    "script_case": ("DECLARE x INT64 DEFAULT 2; CASE x WHEN 1 THEN SELECT 'one' AS r; WHEN 2 THEN SELECT 'two' AS r; ELSE SELECT 'more' AS r; END CASE", "SELECT 'two' AS r"),
    "script_exception": ("BEGIN SELECT ERROR('bad'); EXCEPTION WHEN ERROR THEN SELECT 'caught' AS r; END", "SELECT 'caught' AS r"),
    "script_raise": ("BEGIN RAISE USING MESSAGE = 'mine'; EXCEPTION WHEN ERROR THEN SELECT @@error.message AS r; END", "SELECT 'mine' AS r"),
    "script_return": ("SELECT 'kept' AS r; RETURN; SELECT 'never' AS r", "SELECT 'kept' AS r"),
    "script_call": ("CREATE PROCEDURE d.p(INOUT x INT64) BEGIN SET x = x + 1; END; BEGIN DECLARE v INT64 DEFAULT 4; CALL d.p(v); CALL d.p(v); SELECT v AS v; END", "SELECT 6::BIGINT AS v"),
    "script_execute_immediate": ("DECLARE v INT64; EXECUTE IMMEDIATE 'SELECT COUNT(*) FROM nation WHERE n_regionkey = @r' INTO v USING 1 AS r; SELECT v AS v", "SELECT count(*) AS v FROM nation WHERE n_regionkey = 1"),
    "script_transaction": (f"{N} BEGIN TRANSACTION; DELETE FROM d.n WHERE TRUE; ROLLBACK TRANSACTION; BEGIN TRANSACTION; DELETE FROM d.n WHERE r = 0; COMMIT TRANSACTION; {ALL}", f"{BASE} WHERE n_regionkey <> 0"),
    "script_labels": ("DECLARE i INT64 DEFAULT 0; outer_: LOOP LOOP SET i = i + 1; IF i > 4 THEN BREAK outer_; END IF; END LOOP; END LOOP; SELECT i AS i", "SELECT 5::BIGINT AS i"),
    "infoschema_schemata": ("SELECT schema_name FROM INFORMATION_SCHEMA.SCHEMATA", "SELECT 'd' AS schema_name"),
    "infoschema_tables": (f"{N} CREATE VIEW d.v AS SELECT k FROM d.n; SELECT table_name, table_type FROM d.INFORMATION_SCHEMA.TABLES", "SELECT * FROM (VALUES ('n', 'BASE TABLE'), ('v', 'VIEW')) AS t(table_name, table_type)"),
    "infoschema_columns": ("CREATE TABLE d.t (a INT64 NOT NULL, b STRUCT<x INT64, y STRING>, c ARRAY<FLOAT64>); SELECT column_name, ordinal_position, is_nullable, data_type FROM d.INFORMATION_SCHEMA.COLUMNS", "SELECT * FROM (VALUES ('a', 1::BIGINT, 'NO', 'INT64'), ('b', 2, 'YES', 'STRUCT<x INT64, y STRING>'), ('c', 3, 'YES', 'ARRAY<FLOAT64>')) AS t(column_name, ordinal_position, is_nullable, data_type)"),
    "infoschema_table_options": ("CREATE TABLE d.t (a INT64) OPTIONS(description='hi'); SELECT option_name, option_value FROM d.INFORMATION_SCHEMA.TABLE_OPTIONS", "SELECT 'description' AS option_name, '\"hi\"' AS option_value"),
    "infoschema_views": (f"{N} CREATE VIEW d.v AS SELECT k FROM d.n; SELECT table_name, view_definition FROM d.INFORMATION_SCHEMA.VIEWS", "SELECT 'v' AS table_name, 'SELECT k FROM d.n' AS view_definition"),
    "infoschema_partitions": ("CREATE TABLE d.o (day DATE, k INT64) PARTITION BY DATE_TRUNC(day, YEAR) AS SELECT DATE(o_orderdate), o_orderkey FROM orders; SELECT partition_id, total_rows FROM d.INFORMATION_SCHEMA.PARTITIONS", "SELECT strftime(o_orderdate, '%Y') AS partition_id, count(*) AS total_rows FROM orders GROUP BY 1"),
}

SCRIPTS |= {
    "infoschema_routines": ("CREATE FUNCTION d.f(x INT64) AS (x); CREATE PROCEDURE d.p() BEGIN SELECT 1; END; SELECT routine_name, routine_type FROM d.INFORMATION_SCHEMA.ROUTINES", "SELECT * FROM (VALUES ('f', 'FUNCTION'), ('p', 'PROCEDURE')) AS t(routine_name, routine_type)"),
    "infoschema_materialized_views": (f"{N} CREATE MATERIALIZED VIEW d.m AS SELECT COUNT(*) AS n FROM d.n; SELECT table_name FROM d.INFORMATION_SCHEMA.MATERIALIZED_VIEWS", "SELECT 'm' AS table_name"),
    "infoschema_row_access_policies": (f"{N} CREATE ROW ACCESS POLICY p ON d.n GRANT TO ('allUsers') FILTER USING (r = 1); SELECT policy_name, filter_predicate FROM d.INFORMATION_SCHEMA.ROW_ACCESS_POLICIES", "SELECT 'p' AS policy_name, 'r = 1' AS filter_predicate"),
    "create_model": ("CREATE MODEL d.m OPTIONS(model_type='linear_reg') AS SELECT n_nationkey AS x, n_regionkey AS label FROM nation; DROP MODEL d.m; SELECT 1 AS ok", "SELECT 1::BIGINT AS ok"),
    "temp_function": ("CREATE TEMP FUNCTION half(x FLOAT64) AS (x / 2); SELECT r_regionkey, half(r_regionkey) AS h FROM region", "SELECT r_regionkey, r_regionkey / 2 AS h FROM region"),
    "ddl_create_function_python": ("CREATE TEMP FUNCTION shout(s STRING) RETURNS STRING LANGUAGE python AS 'def shout(s): return s.upper() + \"!\"'; SELECT shout(r_name) AS s FROM region", "SELECT upper(r_name) || '!' AS s FROM region"),
    "alter_set_options": (f"{N} ALTER TABLE d.n SET OPTIONS(description='new'); SELECT option_value FROM d.INFORMATION_SCHEMA.TABLE_OPTIONS", "SELECT '\"new\"' AS option_value"),
    "default_collation_and_rename_column": (f"{N} ALTER TABLE d.n RENAME COLUMN name TO title; SELECT k, title FROM d.n", "SELECT n_nationkey AS k, n_name AS title FROM nation"),
    "view_over_policy": (f"{N} CREATE ROW ACCESS POLICY p ON d.n GRANT TO ('allAuthenticatedUsers') FILTER USING (r = 2); CREATE VIEW d.v AS SELECT k FROM d.n; SELECT k FROM d.v", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2"),
    "create_like_and_copy": (f"{N} CREATE TABLE d.a LIKE d.n; CREATE TABLE d.b COPY d.n; INSERT INTO d.a SELECT * FROM d.b WHERE r = 0; SELECT k FROM d.a", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0"),
    "assert": ("ASSERT (SELECT COUNT(*) FROM nation) > 0 AS 'empty'; SELECT 1 AS ok", "SELECT 1::BIGINT AS ok"),
}

for _name, (_text, _oracle) in SCRIPTS.items():
    script(f"stmt_{_name}", _text, _oracle)


def with_parameters(name: str, text: str, params, oracle: str) -> None:
    add(name, oracle)(lambda spark, sf_dir: engine(spark, sf_dir).sql(text, params))


with_parameters("param_named", "SELECT n_name FROM nation WHERE n_regionkey = @r", {"r": 1}, "SELECT n_name FROM nation WHERE n_regionkey = 1")
with_parameters("param_positional", "SELECT n_name FROM nation WHERE n_regionkey = ? AND n_name > ?", [1, "B"], "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_name > 'B'")
with_parameters("param_array", "SELECT n_name FROM nation WHERE n_regionkey IN UNNEST(@a)", {"a": ("ARRAY<INT64>", [1, 2])}, "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2)")
with_parameters("param_struct", "SELECT @s.a + 1 AS a, @s.b AS b", {"s": ("STRUCT<a INT64, b STRING>", {"a": 1, "b": "x"})}, "SELECT 2::BIGINT AS a, 'x' AS b")
with_parameters("param_null", "SELECT n_name FROM nation WHERE @x IS NULL", {"x": ("INT64", None)}, "SELECT n_name FROM nation")


def job(name: str, oracle: str | None = None):
    """Register a function over (engine, folder)."""

    def keep(f: Callable[[Engine, str], DataFrame]):
        add(name, oracle)(lambda spark, sf_dir: f(engine(spark, sf_dir), sf_dir))
        return f

    return keep


def _through(e: Engine, sf_dir: str, kind: str) -> DataFrame:
    """Extract nation in a format and load it again."""
    src = load(e.spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    uri = scratch_path(e.spark, "export")
    if kind == "ORC":  # there is no ORC extract; the file comes from elsewhere
        src.write.orc(uri)
    else:
        files.extract(src, f"{uri}/*", kind)
        uri = f"{uri}/shards"
    e.warehouse.load("d.loaded", files.load(e.spark, uri, kind, src.schema))
    return e.sql("SELECT k, name FROM d.loaded")


ROUND_TRIP = "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation"
for _kind in ("CSV", "NEWLINE_DELIMITED_JSON", "PARQUET", "ORC"):
    job(f"job_load_{_kind.lower()}", ROUND_TRIP)(lambda e, d, _k=_kind: _through(e, d, _k))


@job("job_load_autodetect", "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_nationkey / 2 AS h FROM nation")
def autodetect(e: Engine, sf_dir: str) -> DataFrame:
    """CSV without a schema: types are detected."""
    uri = scratch_path(e.spark, "detect")
    src = load(e.spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_nationkey") / 2).alias("h"))
    files.extract(src, f"{uri}/*", "CSV")
    e.warehouse.load("d.loaded", files.load(e.spark, f"{uri}/shards", "CSV", autodetect=True))
    return e.sql("SELECT CAST(k AS INT64) AS k, name, h FROM d.loaded")


@job("job_dry_run", "SELECT * FROM (VALUES ('n', 'bigint'), ('m', 'string')) AS t(name, kind)")
def dry_run(e: Engine, sf_dir: str) -> DataFrame:
    schema = e.dry_run("SELECT COUNT(*) AS n, MAX(n_name) AS m FROM nation")
    return e.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "name string, kind string")


def _error(kind: str, text: str) -> None:
    @job(f"error_{kind.lower()}", f"SELECT '{kind}' AS reason")
    def fail(e: Engine, sf_dir: str) -> DataFrame:
        try:
            e.sql(text)
            found = "none"
        except Exception as x:  # noqa: BLE001  the reason is the result
            found = errors.reason(x)
        return e.spark.createDataFrame([(found,)], "reason string")


_error("invalidQuery", "SELECT 1 +")
_error("notFound", "SELECT * FROM d.missing")
_error("duplicate", "CREATE TABLE d.t (x INT64); CREATE TABLE d.t (x INT64)")
_error("accessDenied", f"{N} CREATE ROW ACCESS POLICY p ON d.n GRANT TO ('user:a@x.org') FILTER USING (k = 1); CREATE TABLE d.c CLONE d.n")


@job("job_copy", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation")
def copy(e: Engine, sf_dir: str) -> DataFrame:
    e.sql("CREATE TABLE d.a AS SELECT n_nationkey AS k FROM nation")
    e.warehouse.copy(["d.a", "d.a"], "d.b")
    return e.sql("SELECT k FROM d.b")


@job("job_write_dispositions", "SELECT n_nationkey AS k, NULL::VARCHAR AS x FROM nation UNION ALL SELECT 99, 'new'")
def dispositions(e: Engine, sf_dir: str) -> DataFrame:
    nation = load(e.spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    e.warehouse.load("d.t", nation.limit(3))
    e.warehouse.load("d.t", nation, "WRITE_TRUNCATE")
    more = e.spark.range(1).select(F.lit(99).alias("k"), F.lit("new").alias("x"))
    e.warehouse.load("d.t", more, "WRITE_APPEND", add_fields=True)
    return e.sql("SELECT k, x FROM d.t")


@job("job_export_data", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def export(e: Engine, sf_dir: str) -> DataFrame:
    uri = scratch_path(e.spark, "exported")
    e.sql(f"EXPORT DATA OPTIONS(uri='{uri}/*.csv', format='CSV', header=true) AS SELECT n_name FROM nation WHERE n_regionkey = 1")
    return e.spark.read.option("header", True).csv(f"{uri}/shards.csv").agg(F.count("*").alias("n"))


@job("job_insert_all", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (3, 'c')) AS t(k, s)")
def insert_all(e: Engine, sf_dir: str) -> DataFrame:
    e.sql("CREATE TABLE d.t (k INT64, s STRING)")
    ingest.insert_all(e.warehouse, "d.t", ['{"k": 1, "s": "a"}', '{"k": "no", "s": "b"}', '{"k": 3, "s": "c"}'], skip_invalid=True)
    return e.sql("SELECT k, s FROM d.t")


@job("job_list_rows", "SELECT n_nationkey AS k FROM nation ORDER BY 1 LIMIT 5 OFFSET 10")
def list_rows(e: Engine, sf_dir: str) -> DataFrame:
    e.sql("CREATE TABLE d.t AS SELECT n_nationkey AS k, n_name AS name FROM nation")
    return ingest.list_rows(e.frame("d.t").orderBy("k"), ["k"], 10, 5)


@job("job_read_session", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def read_session(e: Engine, sf_dir: str) -> DataFrame:
    session = ingest.ReadSession(load(e.spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], "o_totalprice > 100000", 4)
    out = session.stream(0)
    for k in range(1, session.streams):
        out = out.unionByName(session.stream(k))
    return out


def _stream(kind: str, oracle: str):
    @job(f"stream_{kind.lower()}", oracle)
    def append(e: Engine, sf_dir: str) -> DataFrame:
        e.sql("CREATE TABLE d.t (k INT64)")
        w = ingest.WriteStream(e.warehouse, "d.t", kind)
        batches = [e.spark.range(0, 10).withColumnRenamed("id", "k"), e.spark.range(10, 15).withColumnRenamed("id", "k")]
        for at, b in zip((0, 10), batches):
            w.append(b, None if kind == "DEFAULT" else at)
        if kind == "PENDING":
            w.finalize()
            ingest.commit(e.warehouse, [w])
        if kind == "BUFFERED":
            w.flush(11)
        return e.sql("SELECT k FROM d.t")


_stream("DEFAULT", "SELECT range AS k FROM range(15)")
_stream("COMMITTED", "SELECT range AS k FROM range(15)")
_stream("PENDING", "SELECT range AS k FROM range(15)")
_stream("BUFFERED", "SELECT range AS k FROM range(12)")


@job("rest_rows", "SELECT '{\"f\":[{\"v\":\"' || n_nationkey || '\"},{\"v\":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE '\"' || n_name || '\"' END || '},{\"v\":[{\"v\":\"1\"},{\"v\":\"2\"}]}]}' AS row_json FROM nation")
def rest_rows(e: Engine, sf_dir: str) -> DataFrame:
    """Rows as the warehouse's wire format has them: nested records, repeated fields and nulls."""
    return ingest.wire_rows(e.sql("SELECT n_nationkey AS k, IF(n_regionkey = 0, NULL, n_name) AS name, [1, 2] AS a FROM nation"))


@job("rest_nested", "SELECT '{\"f\":[{\"v\":{\"f\":[{\"v\":\"' || n_nationkey || '\"},{\"v\":[{\"v\":\"' || n_name || '\"}]}]}}]}' AS row_json FROM nation")
def rest_nested(e: Engine, sf_dir: str) -> DataFrame:
    return ingest.wire_rows(e.sql("SELECT STRUCT(n_nationkey AS a, [n_name] AS b) AS s FROM nation"))


@job("job_default_dataset", f"{BASE} WHERE n_regionkey = 1")
def default_dataset(e: Engine, sf_dir: str) -> DataFrame:
    """Names without a dataset mean the session's own."""
    e.dataset = "d"
    e.sql("CREATE TABLE n AS SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation; DELETE FROM n WHERE r <> 1")
    return e.sql("SELECT n.k, name, r FROM n")


@job("job_backup_restore", f"{BASE} WHERE n_nationkey <> 3")
def backup_restore(e: Engine, sf_dir: str) -> DataFrame:
    e.sql(f"{N} DELETE FROM d.n WHERE k = 3")
    place = scratch_path(e.spark, "backup")
    e.warehouse.backup(place)
    e.sql("DROP TABLE d.n")
    return type(e.warehouse).restore(e.spark, place, scratch_path(e.spark, "restored")).read("d.n")


@job("stream_arrow_rows", "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders")
def arrow_rows(e: Engine, sf_dir: str) -> DataFrame:
    """Rows out of a session as Arrow messages, and into a table again."""
    e.sql("CREATE TABLE d.t (k INT64, s STRING, p FLOAT64)")
    session = ingest.ReadSession(e.sql("SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders"), streams=2)
    for k in range(session.streams):
        rows = session.stream(k)
        e.warehouse.append("d.t", ingest.from_arrow(ingest.arrow_rows(rows), rows.schema))
    return e.sql("SELECT k, s, p FROM d.t")


@job("stream_windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(e: Engine, sf_dir: str) -> DataFrame:
    """Hourly counts of the event stream, by Structured Streaming with a watermark."""
    return windows.hourly_counts(e.spark, f"{sf_dir}/events.parquet")


@job("stream_exactly_once", "SELECT event_id FROM events")
def exactly_once(e: Engine, sf_dir: str) -> DataFrame:
    """The event stream into a table, each micro-batch once whatever is replayed."""
    e.sql("CREATE TABLE d.ev (event_id INT64)")
    source = windows.source(e.spark, f"{sf_dir}/events.parquet").select("event_id")
    for _ in range(2):  # the second run finds everything done
        ingest.run_stream(e.warehouse, "d.ev", source, f"{e.warehouse.root}/checkpoints/ev")
    return e.sql("SELECT event_id FROM d.ev")
