from pyspark.sql import functions as F

import corpus_pipeline as cp
from assayer.llm import mixing, ngram_join, packing, pii, toxicity


def test_stages_work_on_what_is_kept(spark, awkward, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity.fit, "__defaults__", (toxicity.Settings(sample=200, epochs=2, dim=2), "doc_id", "text", "toxic"))
    work = ("base", "spans", "block", "slot", "admitted", "mix", "_mix", "_before", "_toxicity", "n", "kept", "node", "component_id", "score", "_base", "_pii", "g", "_scored")
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{w} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(w) for w in work])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (now, spark.read.parquet(f"{tmp_path}/{name}"))
        now = seen[name][1]
        if name != "packing":
            assert now.columns == docs.columns
            assert all(r[w] == f"{w} of {'none' if r.doc_id is None else r.doc_id}" for r in now.collect() for w in work)
    before, after = seen["near_duplicates"]
    groups = ngram_join.near_groups(before).where("doc_id is not null").collect()
    kept = [r.doc_id for r in after.collect() if r.doc_id is not None]
    assert sorted(kept) == sorted({r.component_id for r in groups})
    before, after = seen["personal_data"]
    assert before.count() == after.count() and all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.collect())
    assert all(not r.base for r in pii.personal_spans(after.where("text not like '%<%'")).collect())
    before, after = seen["source_mixing"]
    assert after.exceptAll(before).isEmpty() and before.exceptAll(after).isEmpty()
    pieces = seen["packing"][1].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen["source_mixing"][1].collect()} and max(r.offset + r.length for r in pieces) <= packing.CAPACITY
    assert cp.run(spark, str(tmp_path)).count() == len(pieces)


def test_empty_documents(spark, nothing, tmp_path):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_mixing_keeps_every_document_and_its_order_reaches_the_sequences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing.mix, "__defaults__", (None, None, 40, 64, *mixing.mix.__defaults__[4:]))
    sources = ["hot"] * 97 + ["a", "b", "c", "empty"]
    rows = [(i, None if s == "empty" else f"text {i} of the source", "en", s, 20) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    cp.mixing_stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    after = spark.read.parquet(f"{tmp_path}/mixed")
    assert sorted(after.collect()) == sorted(docs.collect(), key=lambda r: r.doc_id)
    slot = {r.doc_id: r.mix.slot for r in mixing.mixed(docs).collect()}
    pieces = packing.best_fit_in_order(after, 10).collect()
    assert sorted(r.doc_id for r in pieces) == list(range(len(rows)))
    order = lambda r: slot[r.doc_id] if slot[r.doc_id] is not None else 1 << 62
    stretch = [[order(r) for r in pieces if r.sequence_id >> 40 == k] for k in range(11)]
    assert all(5 <= len(s) <= 15 for s in stretch) and all(max(a) <= min(b) for a, b in zip(stretch[:-1], stretch[1:], strict=True))
    own = [r for r in pieces if r.sequence_id >> 40 == 0]
    assert [order(r) for r in sorted(own, key=lambda r: (r.sequence_id, r.offset))] == sorted(map(order, own))
