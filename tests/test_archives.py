import io
import random
import zipfile

import pytest

from assayer.sources import archives, readers


def packed(members, **options):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", **options) as z:
        z.mkdir("folder")
        for name, content, method in members:
            z.writestr(name, content, method)
        z.comment = b"the end"
    return sink.getvalue()


@pytest.mark.parametrize("entry_bytes", [archives.ENTRY_BYTES, 0])
def test_members_over_many_splits(spark, tmp_path, entry_bytes):
    rng = random.Random(2)
    inner = packed([(f"i{k}.txt", rng.randbytes(300), k % 2 * 8) for k in range(5)])
    members = [(f"folder/{k}.jpg", rng.randbytes(rng.randrange(4000)), rng.choice([0, 8])) for k in range(40)]
    members += [("näme.txt", "ü" * 900, 8), ("empty", b"", 0), ("inner.zip", inner, 0), ("signatures", b"PK\x03\x04" * 50, 0), ("last.zip", inner, 0)]
    (tmp_path / "a.zip").write_bytes(packed(members))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z, z.open("wide", "w", force_zip64=True) as f:
        f.write(b"x" * 5000)
    with zipfile.ZipFile(tmp_path / "c.zip", "w"):
        pass
    (tmp_path / "other.txt").write_text("not an archive")
    want = {("a.zip", n, c.encode() if isinstance(c, str) else c) for n, c, _ in members} | {("b.zip", "wide", b"x" * 5000)}
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert len({r.split for r in archives._rows(spark, str(tmp_path)).select("split").collect()}) > 20
        got = archives.members(spark, str(tmp_path), entry_bytes).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert {(r.archive.rpartition("/")[2], r.path, bytes(r.content)) for r in got} == want and len(got) == len(want)
    assert all(r.name == r.path.rpartition("/")[2] and r.length == len(r.content) for r in got)


def test_what_cannot_be_read_raises(spark, tmp_path):
    good = packed([("a.jpg", b"content of a" * 40, 0), ("in/a.jpg", b"b", 8)])
    (tmp_path / "x.zip").write_bytes(good)
    with pytest.raises(Exception, match="ambiguous file name"):
        readers.by_basename(archives.members(spark, str(tmp_path))).collect()
    for broken, match in ((good.replace(b"of a", b"of b"), "wrong checksum"), (good[:-40], "not an archive"), (b"x" + good, "isn't where"), (b"nothing", "not an archive")):
        (tmp_path / "x.zip").write_bytes(broken)
        with pytest.raises(Exception, match=match):
            archives.members(spark, str(tmp_path)).collect()
