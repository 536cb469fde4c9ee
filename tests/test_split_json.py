import json
import random

import pytest

from assayer.sources import readers, split_json

SPLITS = {"spark.sql.files.maxPartitionBytes": "350", "spark.sql.files.openCostInBytes": "16", "spark.sql.files.minPartitionNum": "40", "spark.sql.shuffle.partitions": "2"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(rng, deep=2):
    kind = rng.randrange(6 if deep else 4)
    if kind == 0:
        return rng.choice(["", "a,b", 'say "x", {y} [z]', "\\", '\\\\"', "é😀,", "]}", "\n,\t", "," * 70])
    if kind == 1:
        return rng.choice([None, True, 17, -2.5])
    if kind in (2, 3):
        return "word " * rng.randrange(20)
    if kind == 4:
        return [value(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "a,b", 'q"', "items"]) + str(i): value(rng, deep - 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("indent", [None, 2])
def test_entries_of_objects_over_many_splits(small_splits, tmp_path, indent):
    rng = random.Random(indent)
    docs = [{f"id {i},{n}": {"v": json.dumps(value(rng)), "n": n} for n in range(k)} for i, k in enumerate((60, 0, 1, 9))]
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(i % 2)))
    assert split_json.starts(small_splits, str(tmp_path)).count() > 20
    want = sorted((k, x["v"], x["n"]) for doc in docs for k, x in doc.items())
    assert sorted(tuple(r) for r in readers.json_map(small_splits, str(tmp_path), "v string, n int").collect()) == want
    longest = max(len(json.dumps(e)) for doc in docs for e in doc.items())
    assert max(len(r.piece) for r in split_json.pieces(small_splits, str(tmp_path)).collect()) < longest + 40


@pytest.mark.parametrize("indent", [None, 1])
def test_items_of_lists_and_wrappers(small_splits, tmp_path, indent):
    rng = random.Random(7)
    items = [{"k": i, "t": json.dumps(value(rng))} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps({"about": {"items": [1, 2], "x": "y" * 90}, "items": [], "records": items[:20], "triplets": items, "n": [9]}, indent=indent))
    (tmp_path / "c.json").write_text(json.dumps({"other": items, "items": items[3:9]}, indent=indent))
    for name, rows in (("a", items), ("b", items[:20]), ("c", items[3:9])):
        got = readers.json_items(small_splits, str(tmp_path / f"{name}.json"), "k int, t string").collect()
        assert sorted(tuple(r) for r in got) == sorted((x["k"], x["t"]) for x in rows)


def test_later_documents_win_in_the_order_given(small_splits, tmp_path):
    for name, v in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"x": {"v": v}, name: {"v": v}}))
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    for paths, v in (([a, b], 2), ([b, a], 1), (str(tmp_path), 2)):
        assert {r.id: r.v for r in readers.json_map(small_splits, paths, "v int").collect()} == {"x": v, "a": 1, "b": 2}
    (tmp_path / "a.json").write_text('{"x": {"v": 1}, "x": {"v": 5}}')
    assert [tuple(r) for r in readers.json_map(small_splits, a, "v int").collect()] == [("x", 5)]


@pytest.mark.parametrize(("text", "match"), [('{"a": {"v": 1}', "not a whole"), ('{"a": {"v": "1}}', "not a whole"), ("[1, 2]", "not the kind"), ('{"a": {"v": oops}}', "MALFORMED|Malformed|malformed")])
def test_broken_documents_raise(small_splits, tmp_path, text, match):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=match):
        readers.json_map(small_splits, str(tmp_path), "v int").collect()
