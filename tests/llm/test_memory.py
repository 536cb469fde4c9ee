"""What a Python worker holds while it scores or sends rows back doesn't grow with its batches."""

import numpy as np
import pyarrow as pa

from assayer.llm import common, toxicity


def test_scoring_keeps_few_words():
    model = toxicity.Model(np.zeros(1 << 16, np.float32), 0.0)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(2000)]
    assert len(model.score(texts)) == 2000 and len(model.words) <= 64_000


def test_batches_come_in_slices():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}, pa.schema([("x", pa.int64())])) for a, b in ((0, 1300), (1300, 1300), (1300, 1301))]
    found = list(common.sliced(iter(batches)))
    assert [b.num_rows for b in found] == [512, 512, 276, 1] and [x for b in found for x in b.column(0).to_pylist()] == list(range(1301))
