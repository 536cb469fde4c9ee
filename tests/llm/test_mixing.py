import pytest

from assayer.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, None: 0.2}, {"a": 1.0}, {f"s{i}": 1.0 / (i + 1) for i in range(40)}])
def test_every_prefix_is_within_a_block(weights):
    slots = mixing.slots_of(weights, 1024)
    places = mixing.one_cycle(slots)
    at = {p: n for n, ps in places.items() for p in ps}
    assert sorted(at) == list(range(1024))
    got = dict.fromkeys(slots, 0)
    for t in range(1024):
        got[at[t]] += 1
        assert all(abs(got[n] - slots[n] / 1024 * (t + 1)) < 1 for n in slots)


def scheduled(df):
    return df.select("*", "mix.*") if "block" not in df.columns else df.drop("block").select("*", "mix.*")


def test_blocks_against_brute_force(spark, awkward):
    weights = {"s0": 0.5, "s1": 0.25, "s2": 0.2, None: 0.05}
    out = mixing.mix(awkward, weights, block_chars=500, cycle=64)
    assert out.columns == [*awkward.columns, "mix"] and out.select(*awkward.columns).exceptAll(awkward).isEmpty()
    got = scheduled(out).collect()
    assert len(got) == awkward.count()
    slots = mixing.slots_of(weights, 64)
    places = mixing.one_cycle(slots)
    for name in weights:
        own = [r for r in got if r.source == name]
        n = slots[name]
        for r in own:
            assert r.slot == r.block // n * 64 + places[name][r.block % n]
            assert r.release <= r.slot < r.deadline and r.admitted
        volume, blocks = sum(len(r.text or "") for r in own), sorted(r.block for r in own)
        assert blocks[0] == 0 and blocks[-1] <= volume // 500


def test_characters_stay_near_the_shares(spark, awkward):
    weights = {"s0": 0.4, "s1": 0.3, "s2": 0.2, None: 0.1}
    got = scheduled(mixing.mix(awkward, weights, block_chars=300, cycle=64)).collect()
    longest = max(len(r.text or "") for r in got)
    slots = mixing.slots_of(weights, 64)
    for name, n in slots.items():
        own = sorted((r.slot, len(r.text or "")) for r in got if r.source == name)
        total = sum(v for _, v in own)
        for t in range(own[-1][0] + 1):
            done = sum(v for s, v in own if s <= t)
            assert done <= (t + 1) * n / 64 * 300 + 300 + longest
            assert done >= min(total, (t + 1) * n / 64 * 300 - 300)


def test_stream_ends_and_cap(spark, awkward, nothing):
    weights, below = mixing.capped_weights({"a": 800, "b": 100, "c": 60, "d": 40}, 0.3)
    assert weights["a"] == 0.3 and abs(sum(weights.values()) - 1) < 1e-9 and "a" not in below
    assert mixing.capped_weights({}, 0.3) == ({}, [])
    assert mixing.mixed(nothing).count() == 0
    some = scheduled(mixing.mix(awkward, {"s0": 0.5, "s1": 0.5}, until=["s1"], block_chars=100, cycle=64)).collect()
    assert all(not r.admitted for r in some if r.source in (None, "s2")) and all(r.admitted for r in some if r.source == "s1")
    assert len(mixing.mixed(awkward).collect()) == awkward.count()
    assert not any(r.admitted for r in scheduled(mixing.mixed(awkward.where("doc_id in (0, 1)"))).collect())


def test_many_sources_most_of_them_empty(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 0 THEN 'text' WHEN id % 4 = 1 THEN '' END AS text", "concat('source', id) AS source")
    got = scheduled(mixing.mixed(docs)).groupBy("admitted", "text").count().collect()
    assert {(r.admitted, r.text): r["count"] for r in got} == {(True, "text"): 10_000, (False, ""): 10_000, (False, None): 20_000}


def test_too_many_sources_are_named(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 10)
    docs = spark.range(40).selectExpr("id AS doc_id", "CASE WHEN id < 25 THEN 'text' END AS text", "concat('source', id) AS source")
    with pytest.raises(ValueError, match="25 sources"):
        mixing.mixed(docs)


def test_the_query_against_its_target(spark, tmp_path):
    sizes = {"hot": 6000, "b": 2000, "c": 1200, "d": 800}
    rows = [(i, "x" * 20, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n // 20))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op2_source_mixing(spark, str(tmp_path)).collect()
    over = {"hot", "b"}  # scaled up, b passes 0.3 too
    slots = mixing.slots_of({n: 0.3 if n in over else 0.4 * v / 2000 for n, v in sizes.items()})
    places = mixing.one_cycle(slots)
    assert len(got) == len(rows) and all(r.block == 0 and r.slot == places[r.source][0] for r in got)


@pytest.mark.parametrize("n_rest", [1, 2, 3, 9])
def test_one_rule_for_any_number_of_sources(spark, n_rest):
    """The hot source is admitted until the others have run dry, whether its share is bounded by MAX_SHARE or by the equal share."""
    rows = [(i, "x" * 1000, "hot") for i in range(1900)] + [(2000 + i, "x" * 1000, f"s{i % n_rest}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.volumes(docs)
    weights, below = mixing.capped_weights(sizes)
    cap = max(mixing.MAX_SHARE, 1 / (1 + n_rest))
    assert abs(weights["hot"] - cap) < 1e-12 and max(weights.values()) <= cap + 1e-12 and abs(sum(weights.values()) - 1) < 1e-9 and "hot" not in below and below
    got = mixing.mix(docs, weights, below, sizes, block_chars=2000).select("source", "mix.*").where("admitted").groupBy("source").count().collect()
    got = {r.source: r["count"] for r in got}
    assert all(got[f"s{i}"] == 90 // n_rest for i in range(n_rest))
    assert abs(got["hot"] - 90 * cap / (1 - cap)) <= 2 + 2 * n_rest


def test_alone_or_equal_sources_keep_all():
    assert mixing.capped_weights({"a": 5, "b": 0}) == ({"a": 1.0}, ["a"])
    weights, below = mixing.capped_weights({"a": 7, "b": 7, "c": 7})
    assert set(weights.values()) == {1 / 3} and below == ["a", "b", "c"]
