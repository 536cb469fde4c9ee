"""Publication without a gap: immutable version folders, and numbered pointer files put by create-if-absent.

A version is written whole into a folder of its own before anything names it. Then a pointer with the next number names it; a
file system creates a file only once, so of two writers with one number one goes on to the next. Readers take the pointer with
the highest number that is complete. Nothing is renamed or overwritten, so this holds on object stores too, and a reader always
finds a version, the old one or the new one. Old versions stay until `expire` deletes them, for readers that are still at them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .readers import _path

POINTERS = "_pointers"


def _content(fs, place) -> str:
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """Numbers and files of all pointers, the latest first."""
    fs, folder = _path(spark, f"{path}/{POINTERS}")
    if not fs.exists(folder):
        return []
    return sorted(((int(s.getPath().getName()), s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), key=lambda x: -x[0])


def current(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, folder) of the latest complete version; a pointer whose writer hasn't finished its one line doesn't count."""
    fs, _ = _path(spark, path)
    for number, place in _pointers(spark, path):
        try:
            name = _content(fs, place)
        except Exception as e:  # the pointer went between the listing and now: expired, so a later one is there
            if "FileNotFound" in str(e):
                return current(spark, path)
            raise
        if name.endswith("\n"):
            return number, f"{path}/{name.strip()}"
    return None


def _point(spark: SparkSession, path: str, number: int, name: str) -> bool:
    """Put a pointer if no other has its number."""
    fs, place = _path(spark, f"{path}/{POINTERS}/{number:012d}")
    try:
        out = fs.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(f"{name}\n".encode())
    finally:
        out.close()
    return True


def publish_version(df: DataFrame, path: str, form: str = "parquet", **options: str) -> int:
    """Write df as a new version of the table at path and make it the current one; its number."""
    spark = df.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    df.write.options(**options).format(form).save(f"{path}/{name}")
    number = max((n for n, _ in _pointers(spark, path)), default=0) + 1
    while not _point(spark, path, number, name):
        number += 1
    return number


def read_version(spark: SparkSession, path: str, form: str = "parquet", **options: str) -> DataFrame:
    """The current version, fixed when this is called."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.options(**options).format(form).load(found[1])


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all versions but the last few, and what no pointer names, save while its writer may be at work: those newer than
    the current version. How many went."""
    if keep < 1:
        raise ValueError("the current version has to stay")
    fs, folder = _path(spark, path)
    pointers = [(n, p, _content(fs, p).strip()) for n, p in _pointers(spark, path)]
    stay = {name for _, _, name in pointers[:keep]}
    if not stay:
        return 0
    newest = fs.getFileStatus(_path(spark, f"{path}/{pointers[0][2]}")[1]).getModificationTime()
    for _, place, _ in pointers[keep:]:
        fs.delete(place, False)
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version-") and s.getPath().getName() not in stay and s.getModificationTime() <= newest]
    for place in gone:
        fs.delete(place, True)
    return len(gone)
