import json
import os
import time

import pytest

from assayer.functions import expressions as X
from assayer.sources import readers, writers


def test_tagged_directories(spark, tmp_path):
    for name, rows in (("count_test.jsonl", 2), ("deep/train_a.json", 3), ("Test_b.json", 1), ("notes.txt", 9)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps({"k": i}) + "\n" for i in range(rows)))
    got = readers.tagged_directory(spark, str(tmp_path), "k long").groupBy("file_name", "split").count().collect()
    assert {(r.file_name, r.split, r["count"]) for r in got} == {("count_test.jsonl", "test", 2), ("train_a.json", "train", 3), ("Test_b.json", "test", 1)}


def test_files_of_items_are_found_in_the_order_of_roots(spark, tmp_path):
    for root, names in (("first", ["1.jpg", "2.jpg"]), ("second", ["2.jpg", "3.jpg"]), ("other", ["4.jpg"])):
        (tmp_path / root).mkdir()
        for n in names:
            (tmp_path / root / n).write_bytes(b"x")
    items = spark.createDataFrame([("vg:1",), ("2",), ("3",), ("4",), ("5.jpg",), ("dir/2.jpg",), (None,)], "image string")
    listing = readers.files(spark, str(tmp_path), "*.jpg")
    got = {r.image: r.resolved_path for r in readers.resolved(items, listing, ["/first/", "/second/"], readers.raw_filename("image")).collect()}
    assert {k: v and "/".join(v.split("/")[-2:]) for k, v in got.items()} == {"vg:1": "first/1.jpg", "2": "first/2.jpg", "3": "second/3.jpg", "4": "other/4.jpg", "5.jpg": None, "dir/2.jpg": "first/2.jpg", None: None}


def test_raw_filenames(spark):
    names = ["vg:12", "12", "a/b.png", "vg:a/9.jpg", "x.y"]
    got = [r.n for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, image string").orderBy("i").select(readers.raw_filename("image").alias("n")).collect()]
    assert got == ["12.jpg", "12.jpg", "b.png", "9.jpg", "x.y"]


def test_synthetic_rows_are_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, False), (2, None)], "k int, synthetic boolean")
    writers.guard_synthetic(rows).write.parquet(str(tmp_path / "ok"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2
    with pytest.raises(Exception, match="a synthetic row"):
        writers.guard_synthetic(rows.union(spark.createDataFrame([(3, True)], rows.schema))).write.parquet(str(tmp_path / "bad"))


def test_quiet_folders(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("x")
    assert not readers.quiet(readers.files(spark, str(tmp_path))).first().ready
    for name in ("a", "b"):
        os.utime(tmp_path / name, (time.time() - 300,) * 2)
    assert readers.quiet(readers.files(spark, str(tmp_path))).first().ready
    assert not readers.quiet(readers.files(spark, str(tmp_path)), 3600).first().ready


def test_preferred_letters(spark):
    rows = spark.createDataFrame([(1, "cat", "cat", "dog"), (2, "dog", "cat", "dog")], "k int, gold string, a string, b string")
    assert [r.p for r in rows.orderBy("k").select(X.preferred_for("a", "b", "gold").alias("p")).collect()] == ["A", "B"]
    for gold in ("owl", None):
        with pytest.raises(Exception, match="neither candidate"):
            spark.createDataFrame([(gold, "cat", "dog")], "gold string, a string, b string").select(X.preferred_for("a", "b", "gold")).collect()
