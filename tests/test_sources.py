import json
import os

from pool import fact, table
from pyspark.sql import functions as F

from factlake.operators import lifecycle
from factlake.operators import textindex
from factlake.sources import json_lines, sql_functions, tables


def test_import_file(spark, tmp_path):
    lines = [
        '{"content": "one", "tags": ["a", "b"], "repo": "r", "importance": "high"}', "", "  ",
        "not json", "[1]", '"text"', "null", '{"content": 5}', '{"content": "  "}',
        json.dumps({"content": "z" * 2001}),
        '{"content": "two", "tags": [1], "repo": 7, "importance": "urgent"}',
        '{"content": "three", "tags": [], "repo": null}',
        '{"content": "four", "tags": ["x", null]}',
    ]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines))
    entries, warnings = json_lines.read_import_jsonl(spark, str(path))
    got = {r.ordinal: tuple(r)[1:] for r in entries.collect()}
    assert got == {
        1: ("one", ["a", "b"], "r", "high"), 9: ("two", None, None, None),
        10: ("three", [], None, None), 11: ("four", None, None, None)}
    notes = [r.warning for r in warnings.orderBy("line_no").collect()]
    assert [n.split()[1] for n in notes] == ["2", "3", "4", "5", "6", "7", "8", "9", "9", "9", "10", "11"]
    assert notes[0] == "line 2 is not valid JSON, skipping"
    assert notes[3] == "line 5 is not a JSON object, skipping"


def test_line_numbers_of_very_many_files(spark):
    rows = [(f"file-{(i * 7919) % 20011:06d}", i % 5) for i in range(20011)]
    files = spark.createDataFrame(rows, "file string, n long")
    before = json_lines._files_before(files)
    want, total = {}, 0
    for name, n in sorted(rows):
        want[name], total = total, total + n
    assert {r.file: r.file_start for r in before.collect()} == want
    assert "NestedLoop" not in before._jdf.queryExecution().toString()


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(f"{i}\n\n" if i % 10 == 0 else f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = json_lines.numbered_lines(spark, str(path))
        assert numbered.count() == 20000
        assert numbered.filter(F.col("line_no") != F.col("line").cast("long") + 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tool_log_keeps_bad_lines(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"timestamp": "2025-01-01T00:00:00Z", "tool": "recall", "duration_ms": 3, "success": true}\nbad\n')
    rows = json_lines.read_tool_log(spark, str(path)).collect()
    assert [r.tool for r in rows if r._corrupt_record is None] == ["recall"]
    assert [r._corrupt_record for r in rows if r.tool is None] == ["bad"]


def test_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "memory")
    memory = table(spark, [fact("a"), fact("b", archived=True), fact("c", project="q")])
    tables.write_memory(memory, path)
    scan = tables.scan_memory(spark, path, "p", archived=False).select("id")
    assert [r.id for r in scan.collect()] == ["a"]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan and "ReadSchema: struct<id:string>" in plan


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "state")
    memory = table(spark, [fact("a"), fact("b")])
    assert tables.write_snapshot(memory, root) == 0
    pinned, _ = lifecycle.set_pinned(
        tables.read_snapshot(spark, root), spark.createDataFrame([("a",)], "id string"), True,
        "2025-02-01 00:00:00")
    assert tables.write_snapshot(pinned, root) == 1
    assert tables.read_snapshot(spark, root).filter("pinned").count() == 1
    assert tables.read_snapshot(spark, root, 0).filter("pinned").count() == 0
    assert tables.write_snapshot(memory, root, version=1) == 1
    assert tables.read_snapshot(spark, root).filter("pinned").count() == 1


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_write_only_what_they_touch(spark, tmp_path):
    root, as_of = str(tmp_path / "state"), "2025-02-01 00:00:00"
    memory = table(spark, [fact(f"f{i}", archived=i % 7 == 0) for i in range(200)])

    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "id string")

    def rows(version=None):
        found = tables.read_snapshot(spark, root, version).collect()
        assert len({r.id for r in found}) == len(found)
        return {r.id: r for r in found}

    assert tables.write_snapshot(memory, root, bucket_rows=20) == 0
    base = _files(root)
    pin = lambda names: lambda facts: lifecycle.set_pinned(facts, ids(*names), True, as_of)[0]
    assert tables.change_snapshot(spark, root, ids("f3", "none"), pin(["f3"])) == 1
    touched = [f for f in _files(root) - base if "/buckets/" not in f]
    assert {f.split("/bucket=")[1].split("/")[0] for f in touched} and len(touched) <= 2
    assert spark.read.parquet(*touched).count() < 60
    assert [i for i, r in rows().items() if r.pinned] == ["f3"] and len(rows()) == 200
    assert not any(r.pinned for r in rows(0).values())
    # An added fact in a changed bucket, a change of it, facts that move to the archive, facts that go.
    assert tables.append_snapshot(table(spark, [fact("new")]), root) == 2
    assert tables.change_snapshot(spark, root, ids("new", "f5"), pin(["new", "f5"])) == 3
    gone = ids(*[f"f{i}" for i in range(100, 200)])
    assert tables.change_snapshot(spark, root, gone, lambda facts: lifecycle.forget(facts, gone)[0]) == 4
    assert tables.change_snapshot(
        spark, root, ids("f1"), lambda facts: lifecycle.set_archived(facts, ids("f1"), True, as_of)[0]) == 5
    now = rows()
    assert set(now) == {f"f{i}" for i in range(100)} | {"new"} and now["f1"].archived
    assert {i for i, r in now.items() if r.pinned} == {"f3", "f5", "new"}
    assert tables.change_snapshot(spark, root, gone, lambda facts: lifecycle.forget(facts, gone)[0], version=4) == 4
    assert len(rows(3)) == 201 and tables.latest_version(spark, root) == 5
    # Complete again, and everything goes.
    assert tables.write_snapshot(tables.read_snapshot(spark, root), root) == 6 and len(rows()) == 101
    every = tables.read_snapshot(spark, root).select("id")
    assert tables.change_snapshot(spark, root, every, lambda facts: lifecycle.forget(facts, every)[0]) == 7
    assert rows() == {}


def test_a_snapshot_of_nothing(spark, tmp_path):
    root = str(tmp_path / "state")
    assert tables.write_snapshot(table(spark, [fact("a")]).filter("false"), root) == 0
    assert tables.read_snapshot(spark, root).count() == 0
    assert tables.append_snapshot(table(spark, [fact("a")]), root) == 1
    assert [r.id for r in tables.read_snapshot(spark, root).collect()] == ["a"]


def test_export_order(spark, tmp_path):
    memory = table(spark, [
        fact("old", created="2025-01-01 00:00:00"), fact("new", created="2025-01-03 00:00:00"),
        fact("gone", archived=True, created="2025-01-09 00:00:00")])
    path = str(tmp_path / "out")
    tables.write_export(tables.export_memories(memory), path)
    files = sorted(f for f in os.listdir(path) if f.endswith(".json"))
    rows = [json.loads(line) for f in files for line in open(os.path.join(path, f))]
    assert [r["id"] for r in rows] == ["new", "old", "gone"]
    assert rows[0]["createdAt"] == "2025-01-03T00:00:00.000Z" and "embedding" not in rows[0]
    assert rows[0]["repo"] is None


def test_sql_functions(spark):
    table(spark, [fact("a", [1, 0]), fact("b", [1, 0.1], archived=True), fact("c", None, content="Find me")]) \
        .createOrReplaceTempView("memory")
    sql_functions.register(spark)
    vector = "array(float(1), float(0))"
    assert [r.id for r in spark.sql(f"SELECT id FROM recall('p', {vector})").collect()] == ["a"]
    found = spark.sql(f"SELECT id FROM recall('p', {vector}, p_include_archived => true, p_query_text => 'me find')")
    assert [r.id for r in found.collect()] == ["a", "b", "c"]
    assert [r.id for r in spark.sql(f"SELECT id FROM dedup_check('p', {vector})").collect()] == ["a"]
    swept, affected = sql_functions.archive_stale(spark, "2025-03-01 00:00:00")
    assert affected == 2 and swept.filter("archived").count() == 3
    touched = sql_functions.touch_memories(spark, spark.createDataFrame([("a",)], "id string"), "2025-03-01 00:00:00")
    assert touched.filter("access_count = 1").count() == 1


def test_sql_recall_searches_in_english(spark):
    facts = [fact("a", None, content="Running to the houses"), fact("b", None, content="a house runs"),
             fact("c", None, content="a dog", archived=True), fact("d", None, content="the and of")]
    for stored in (False, True):
        memory = table(spark, facts)
        (textindex.refresh_tsv(memory) if stored else memory).createOrReplaceTempView("memory")
        sql_functions.register(spark)
        ask = lambda more: sorted(r.id for r in spark.sql(
            f"SELECT id FROM recall('p', array(float(1), float(0)), p_query_text => {more})").collect())
        assert ask("'run House'") == ["a", "b"]
        assert ask("'the and'") == [] and ask("NULL") == []
        assert ask("'dogs', p_include_archived => true") == ["c"]
        if not stored:
            assert ask("'a house runs', p_text_config => 'simple'") == ["b"]
