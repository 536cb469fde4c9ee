import numpy as np
import pytest

from assayer.llm import census


@pytest.mark.parametrize("groups", [1, 2, 7, 5000])
def test_a_group_sends_each_bucket_it_has_once(groups):
    rng = np.random.default_rng(groups)
    values = np.unique(census.short(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2), groups))
    counts = rng.integers(1, 400, len(values))
    rows = census.sent(3, values, counts, groups).to_pylist()
    back = np.concatenate([(np.uint64(r["bucket"]) << np.uint64(32)) | np.frombuffer(r["found"], np.uint32) for r in rows])
    assert (back == values).all() and len({r["bucket"] for r in rows}) == len(rows) and {r["g"] for r in rows} == {3}
    assert (np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows]) == np.minimum(counts, 255)).all()


def test_no_hashes():
    assert census.sent(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), 8).num_rows == 0
