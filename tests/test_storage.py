"""What changes to tables touch: files that hold no changed row are named as before."""

import uuid

import pyarrow as pa
import pytest

from tessera.engine import Engine
from tessera.sources import files
from tessera.sources.storage import Warehouse
from tessera.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")
    e.sql("CREATE SCHEMA d; CREATE TABLE d.t (k INT64, s STRING)")
    for k in range(4):
        e.sql(f"INSERT INTO d.t VALUES ({2 * k}, 'a'), ({2 * k + 1}, 'b')")
    return e


def named(engine, table="d.t"):
    found = engine.warehouse.version_at(table, None)["paths"]
    return {files.plain(f) for p in found for f in files.listing(engine.spark, p)}


def rows(engine, table="d.t"):
    return sorted(map(tuple, engine.sql(f"SELECT * FROM {table}").collect()), key=str)


CHANGES = [
    ("UPDATE d.t SET s = 'x' WHERE k = 3", 1, lambda r: [(k, "x" if k == 3 else s) for k, s in r]),
    ("DELETE FROM d.t WHERE k = 3", 1, lambda r: [x for x in r if x[0] != 3]),
    ("DELETE FROM d.t WHERE k IN (SELECT 3)", 1, lambda r: [x for x in r if x[0] != 3]),
    ("UPDATE d.t SET s = n.v FROM (SELECT 3 AS j, 'y' AS v) AS n WHERE k = n.j", 1, lambda r: [(k, "y" if k == 3 else s) for k, s in r]),
    ("MERGE d.t USING (SELECT 3 AS j) AS n ON k = n.j WHEN MATCHED THEN UPDATE SET s = 'z'", 1, lambda r: [(k, "z" if k == 3 else s) for k, s in r]),
    ("MERGE d.t USING (SELECT 3 AS j UNION ALL SELECT 50) AS n ON k = n.j WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (k) VALUES (n.j)", 1, lambda r: [x for x in r if x[0] != 3] + [(50, None)]),
    ("MERGE d.t USING (SELECT 3 AS j UNION ALL SELECT 50) AS n ON k = n.j WHEN NOT MATCHED THEN INSERT (k) VALUES (n.j)", 0, lambda r: [*r, (50, None)]),
    ("MERGE d.t USING (SELECT 3 AS j) AS n ON k = n.j WHEN NOT MATCHED BY SOURCE AND k > 5 THEN DELETE", None, lambda r: [x for x in r if x[0] <= 5]),
    ("UPDATE d.t SET s = 'x' WHERE k = 99", 0, list),
    ("DELETE FROM d.t WHERE k IN (SELECT 99)", 0, list),
]


@pytest.mark.parametrize("statement,touched,change", CHANGES)
def test_changes_keep_untouched_files(engine, statement, touched, change):
    before, held = named(engine), rows(engine)
    engine.sql(statement)
    assert rows(engine) == sorted(change(held), key=str)
    if touched is not None:
        per_file = {f: engine.spark.read.parquet(f).count() for f in before}
        gone = before - named(engine)
        assert sum(f in gone for f, n in per_file.items() if n) == touched


def test_changes_of_an_empty_table(engine):
    engine.sql("CREATE TABLE d.e (k INT64)")
    for statement in ("UPDATE d.e SET k = 1 WHERE TRUE", "DELETE FROM d.e WHERE TRUE", "DELETE FROM d.e WHERE k IN (SELECT 1)"):
        assert engine.execute(statement).affected == 0
    engine.sql("MERGE d.e USING (SELECT 1 AS j) AS n ON k = n.j WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (k) VALUES (n.j)")
    assert rows(engine, "d.e") == [(1,)]


def test_purge_keeps_files_of_folders_that_changed(engine):
    engine.sql("CREATE TABLE d.p AS SELECT id AS k FROM UNNEST(GENERATE_ARRAY(1, 1000)) AS id")
    engine.warehouse.replace("d.p", engine.warehouse.read("d.p").repartition(5, "k"))
    engine.sql("DELETE FROM d.p WHERE k = 7")
    engine.sql("DELETE FROM d.p WHERE k = 8")
    engine.warehouse.purge(0)
    assert engine.warehouse.read("d.p").count() == 998


def test_small_writes_make_no_folders(engine):
    engine.sql("CREATE TABLE d.few (day DATE, k INT64) PARTITION BY day AS SELECT DATE_ADD(DATE '2024-01-01', INTERVAL i DAY), i FROM UNNEST(GENERATE_ARRAY(0, 99)) AS i")
    assert not any("day=" in f for f in named(engine, "d.few"))
    found = engine.sql("SELECT k FROM d.few WHERE day = DATE '2024-01-03'")
    assert "PushedFilters: [IsNotNull(day), EqualTo(day" in found._jdf.queryExecution().executedPlan().toString()
    engine.warehouse.daily_bytes = 0  # from now on writes are large: both layouts are read together
    engine.sql("INSERT INTO d.few VALUES (DATE '2024-01-03', 500)")
    assert any("day=" in f for f in named(engine, "d.few"))
    assert sorted(r[0] for r in found.collect()) == [2]
    assert sorted(r[0] for r in engine.sql("SELECT k FROM d.few WHERE day = DATE '2024-01-03'").collect()) == [2, 500]
    assert engine.execute("DELETE FROM d.few WHERE day = DATE '2024-01-03'").affected == 2


def test_days_are_folders(engine):
    engine.warehouse.daily_bytes = 0
    engine.sql("CREATE TABLE d.days (day DATE, k INT64) PARTITION BY day AS SELECT DATE_ADD(DATE '2024-01-01', INTERVAL MOD(i, 10) DAY), i FROM UNNEST(GENERATE_ARRAY(0, 99)) AS i")
    engine.sql("INSERT INTO d.days VALUES (NULL, 1000), (DATE '2024-01-03', 1001)")
    assert engine.warehouse.read("d.days").columns == ["day", "k"]
    found = engine.sql("SELECT k FROM d.days WHERE day = DATE '2024-01-03'")
    assert sorted(r[0] for r in found.collect()) == [2, 12, 22, 32, 42, 52, 62, 72, 82, 92, 1001]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: []" in plan
    assert all("day=2024-01-03" in f for f in found.inputFiles()) or len(found.inputFiles()) == len(named(engine, "d.days"))
    assert engine.sql("SELECT k FROM d.days WHERE day IS NULL").first()[0] == 1000
    before = named(engine, "d.days")
    assert engine.execute("UPDATE d.days SET k = -1 WHERE day = DATE '2024-01-05' AND k = 4").affected == 1
    assert {f for f in before - named(engine, "d.days")} == {f for f in before if "day=2024-01-05" in f}
    engine.sql("CREATE TABLE d.twin CLONE d.days; INSERT INTO d.twin VALUES (DATE '2024-02-01', 5); DELETE FROM d.twin WHERE day = DATE '2024-01-01'")
    assert engine.warehouse.read("d.twin").count() == 93 and engine.warehouse.read("d.days").count() == 102
    engine.sql("CREATE TABLE d.flat AS SELECT * FROM d.days")
    assert engine.warehouse.read("d.flat").count() == 102


def test_backup_and_restore(engine, tmp_path):
    engine.warehouse.daily_bytes = 0
    engine.sql("CREATE TABLE d.days (day DATE, k INT64) PARTITION BY day AS SELECT DATE '2024-01-01', 1 UNION ALL SELECT DATE '2024-01-02', 2")
    engine.sql("DELETE FROM d.t WHERE k = 3; CREATE SNAPSHOT TABLE d.snap CLONE d.t")
    place = f"file://{tmp_path}/backup folder"
    n = engine.warehouse.backup(place)
    with pytest.raises(ValueError, match="Already"):
        engine.warehouse.backup(place)
    engine.sql("DELETE FROM d.t WHERE TRUE; DROP TABLE d.days")
    restored = Warehouse.restore(engine.spark, place, f"file://{tmp_path}/again")
    assert sorted(restored.read("d.t").collect()) == [(k, "ab"[k % 2]) for k in range(8) if k != 3] and n > 4
    assert restored.read("d.snap").count() == 7 and sorted(r["k"] for r in restored.read("d.days").where("day > date'2024-01-01'").collect()) == [2]
    assert len(restored.entries["d.t"].versions) == len(engine.warehouse.entries["d.t"].versions) - 1
    assert restored.delete("d.t", "k = 4") == 1 and restored.read("d.t").count() == 6


def test_export_and_seed(engine, tmp_path):
    out = f"file://{tmp_path}/out"
    assert engine.warehouse.export(out) == ["d.t"]
    engine.spark.read.parquet(f"{out}/d.t/*").write.parquet(f"file://{tmp_path}/in/copy.parquet")
    assert engine.warehouse.seed("e", f"file://{tmp_path}/in", ["copy"]) == {"copy": 8}
    assert rows(engine, "e.copy") == rows(engine)


def test_rows_in_arrow_messages(engine):
    schema = engine.warehouse.schema("d.t")
    messages = ingest.arrow_rows(engine.warehouse.read("d.t"), 3)
    assert sum(r["row_count"] for r in messages.collect()) == 8 and max(r["row_count"] for r in messages.collect()) <= 3
    header = pa.ipc.read_schema(pa.py_buffer(ingest.arrow_schema(schema)))
    assert header.names == ["k", "s"]
    before = rows(engine)
    engine.warehouse.append("d.t", ingest.from_arrow(messages, schema))
    assert rows(engine) == sorted(before * 2, key=str)


def test_paths_in_one_form():
    for path in ("file:/a/b=c d", "file:///a/b=c%20d", "/a/b=c d"):
        assert files.plain(path) == "file:/a/b=c d"
    assert files.uri("file:/a/b c") == "file:///a/b%20c" and files.uri("hdfs://nn:8020/x/y=1") == "hdfs://nn:8020/x/y=1" and files.uri("file:///a") == "file:///a"
    assert files.plain("hdfs://nn:8020/x") == files.plain("hdfs://nn:8020/x") != files.plain("/x")
