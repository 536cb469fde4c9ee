import threading

import pytest
from pyspark.sql import functions as F

from assayer.sources import versions


def test_a_reader_never_fails_during_100_publications(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish_version(spark.range(1), path)
    seen, failed, over = [], [], threading.Event()

    def read():
        try:
            while not over.is_set():
                number, folder = versions.current(spark, path)
                seen.append((number, spark.read.schema("id long").parquet(folder).count()))
        except Exception as e:
            failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 101):
        assert versions.publish_version(spark.range(n).coalesce(1), path) == n
        if n % 30 == 0:
            versions.expire(spark, path, keep=20)
    over.set()
    reader.join()
    assert not failed and all(number == rows for number, rows in seen) and [x for x, _ in seen] == sorted(x for x, _ in seen)
    assert versions.expire(spark, path, keep=1) > 0 and versions.read_version(spark, path).count() == 100
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 1


def test_unfinished_work_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    versions.publish_version(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        versions.publish_version(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), path)
    (tmp_path / "t" / "_pointers" / "000000000002").write_text("version-half")  # a writer that died before the line's end
    assert versions.current(spark, path)[0] == 1 and versions.read_version(spark, path).count() == 3
    assert versions.publish_version(spark.range(5), path) == 3 and versions.read_version(spark, path).count() == 5
    assert not versions._point(spark, path, 3, "other")
