import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from assayer.llm import packing


def exact(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers(awkward):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    encode = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(1)
    texts = [r.text or "" for r in awkward.collect()]
    texts += ["".join(rng.choices("aA1'.,s \n\t́éÉßΣςİ漢_-²<|>", k=80)) for _ in range(300)] + ["<|endoftext|> don't I'LL x\x1cy\x85z ª①"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == exact(tokenizer, t)


def test_pieces_and_sequences(spark, awkward, nothing):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = []
    for r in awkward.collect():
        ids = np.asarray([*exact(tokenizer, r.text or ""), 1], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    got = packing.best_fit(awkward).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= sum(ends.values()) / 4096 + 1
    assert packing.best_fit(nothing).count() == 0


def test_bounded_best_fit():
    bins = packing.OpenSequences(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.count == 0 and bins.free == 0
    bins = packing.OpenSequences(10, 2)
    assert [bins.place(n)[0] for n in (9, 5, 8)] == [0, 1, 2] and bins.count == 2
    assert bins.place(1) == (2, 8)  # sequence 0, the fullest, was closed


def plain_best_fit(lengths, capacity, limit):
    """The same rule over a list of open sequences."""
    free, out, opened = [], [], 0
    for n in lengths:
        fits = [(f, -at) for at, (f, _) in enumerate(free) if f >= n]
        if fits:
            f, at = min(fits)
            f, number = free.pop(-at)
        else:
            if len(free) >= limit:
                fullest = min(range(len(free)), key=lambda i: (free[i][0], -i))
                free.pop(fullest)
            f, number = capacity, opened
            opened += 1
        out.append((number, capacity - f))
        if f > n:
            free.append((f - n, number))
    return out


def test_against_a_plain_list():
    rng = random.Random(8)
    for limit in (1, 3, 40):
        lengths = [rng.randint(1, 100) for _ in range(500)]
        bins = packing.OpenSequences(100, limit)
        assert [bins.place(n) for n in lengths] == plain_best_fit(lengths, 100, limit)


def test_arrival_does_not_depend_on_length_and_the_bound_holds(spark):
    rows = [(i, 1 + i * 37 % 100) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), 1, 100, 8).collect()
    lengths = [r.length for r in got]
    assert [(r.sequence_id, r.offset) for r in got] == plain_best_fit(lengths, 100, 8) and lengths != sorted(lengths, reverse=True)
    assert len({r.sequence_id for r in got}) <= 1.1 * sum(lengths) / 100


@pytest.mark.parametrize("from_files", [True, False])
def test_in_order_of_any_table(spark, tmp_path, from_files):
    rows = [(i, "word " * (i % 7), "mine", i) for i in range(30)] + [(None, None, "mine", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _metadata string, _row int").coalesce(1)
    if from_files:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    got = packing.best_fit_in_order(docs).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))] == [r[0] for r in rows] and len(got) == 31
