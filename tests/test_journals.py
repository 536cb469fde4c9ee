import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import merging
from assayer.streaming import journals

SCHEMA = "id string, x long, tags array<string>"


def lines(n, start=0):
    return "".join(json.dumps({"id": f"k{i}", "x": i, "tags": ["é", "b"]}, ensure_ascii=False) + "\n" for i in range(start, start + n))


@pytest.mark.parametrize(("tail", "torn"), [("", 0), ('{"id": "k9', 1), ('{"id": "z", "x": 1, "tags": []}', 0), ("\n\n", 0)])
def test_torn_tail_over_many_splits(spark, tmp_path, tail, torn):
    (tmp_path / "a").write_text(lines(300) + tail)
    (tmp_path / "b").write_text("﻿" + lines(3, 500) + '{"torn')
    for size in ("200", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows, bad = journals.journal_rows(spark, str(tmp_path), SCHEMA)
            assert rows.count() == 303 + ("z" in tail) and bad.count() == torn + 1
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [lines(2) + '{"id"\n' + lines(2), lines(2) + '{"id"\n', '{"id\n{"id', lines(1) + '{"id": "\n\n'])
def test_corrupt_lines_inside_raise(spark, tmp_path, text):
    (tmp_path / "a").write_text(text)
    with pytest.raises(ValueError, match="corrupt line inside"):
        journals.journal_rows(spark, str(tmp_path), SCHEMA)


def test_journal_keeps_keys_in_state(spark, tmp_path):
    source, journal, check = str(tmp_path / "in"), str(tmp_path / "journal"), str(tmp_path / "check")
    run = lambda: journals.append_journal(spark.readStream.schema(SCHEMA).json(source), journal, check, "id").start().awaitTermination()
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
    read = lambda: sorted((r.id, r.x) for r in spark.read.schema(SCHEMA).parquet(journal).collect())
    spark.createDataFrame([("old", 0, ["t"])], SCHEMA).write.parquet(journal)
    put([("a", 1, ["t"]), ("a", 1, ["t"]), ("b", 2, None), ("old", 0, ["t"])])
    run()
    assert read() == [("a", 1), ("b", 2), ("old", 0)]
    # A batch reads the state and not the journal: a file that nothing can read doesn't hurt it.
    (tmp_path / "journal" / "junk.parquet").write_bytes(b"junk")
    put([("b", 2, None), ("c", None, []), ("old", 0, ["t"])])
    run()
    (tmp_path / "journal" / "junk.parquet").unlink()
    assert read() == [("a", 1), ("b", 2), ("c", None), ("old", 0)]
    put([("d", 4, None), ("a", 9, ["t"])])
    for _ in range(2):
        with pytest.raises(Exception, match="conflicting rows"):
            run()
        assert read() == [("a", 1), ("b", 2), ("c", None), ("old", 0)]


def test_a_journal_is_appended_to_without_python_for_each_key(spark, tmp_path):
    source, journal, check = str(tmp_path / "in"), str(tmp_path / "journal"), str(tmp_path / "check")
    schema = "k long, v double"
    spark.createDataFrame([(None, 0.0), (1, None)], schema).write.parquet(journal)
    spark.createDataFrame([(None, 0.0), (1, None), (2, 0.5), (2, 0.5), (3, None)], schema).write.parquet(source)
    query = journals.append_journal(spark.readStream.schema(schema).parquet(source), journal, check, "k").start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)  # what explain() prints
    assert "StateStoreSave" in plan and "Python" not in plan and "Pandas" not in plan
    assert sorted(map(str, spark.read.schema(schema).parquet(journal).collect())) == sorted(map(str, spark.createDataFrame([(None, 0.0), (1, None), (2, 0.5), (3, None)], schema).collect()))
    # A row that conflicts with one that the journal had before the query stops it.
    spark.createDataFrame([(1, 7.0)], schema).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="conflicting rows in the journal: 1"):
        journals.append_journal(spark.readStream.schema(schema).parquet(source), journal, check, "k").start().awaitTermination()
    assert spark.read.schema(schema).parquet(journal).count() == 4


def test_a_batch_that_runs_again_replaces_its_files(spark, tmp_path):
    journal = str(tmp_path / "j")
    for n in (3, 2):
        journals._put(spark.range(20).repartition(n), journal, "run-000000000007")
        assert sorted(r.id for r in spark.read.parquet(journal).collect()) == list(range(20))
    journals._put(spark.range(20, 22), journal, "run-000000000008")
    assert spark.read.parquet(journal).count() == 22


def test_appended(spark):
    journal = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    fresh, conflicts = merging.appended(journal, spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (3, None)], "k int, v string"), "k")
    assert [tuple(r) for r in fresh.collect()] == [(3, None)] and [r.k for r in conflicts.collect()] == [2]


def test_polling_and_failures(spark, tmp_path):
    spark.createDataFrame([("a", "ok"), ("b", "oom"), ("c", None)], "id string, status string").write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id string, status string").json(str(tmp_path / "in"))
    journals.route_failures(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).start().awaitTermination()
    assert {(r.id, r._status) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "ok"), ("b", "oom"), ("c", "unknown")}
    seen = []
    query = journals.polled(stream(), 1, lambda batch, epoch: seen.append((epoch, batch.count())), str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, 3)]
    now = spark.range(1).select(journals.is_ready(F.current_timestamp() - F.expr("interval 2 minutes")).alias("old"), journals.is_ready(F.current_timestamp()).alias("new")).first()
    assert now.old and not now.new
