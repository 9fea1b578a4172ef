"""What a worker of op1 holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
from courtside.llm import lm_scoring as lm


def test_counting_holds_little():
    rnd = np.random.default_rng(1)
    texts = [bytes(rnd.integers(97, 123, 40_000, dtype=np.uint8)).decode() + " x" for _ in range(100)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(100, np.int32)), pa.array([True] * 100), pa.array(texts)], names=["chunk", "train", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in lm._counted(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 3_000_000 and peak < 230_000_000, peak
