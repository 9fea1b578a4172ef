"""What Python workers hold: it stays in a worker when the next stage runs in it."""

import random
import tracemalloc
from sys import getsizeof

import pyarrow as pa
from courtside.llm import language_id, pieces
from courtside.llm.common import settle


def test_known_parts_are_small():
    with open(pieces.public_model(), "rb") as f:
        own = pieces.BpePieces(f.read())
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(3000)}
    ids, text = own.packed(" ".join(words))
    assert text == " ".join(words) == own.decode(memoryview(ids).cast("i"))
    size = sum(getsizeof(k) + (getsizeof(v) + sum(map(getsizeof, v)) * isinstance(v, tuple)) for k, v in own._parts.items())
    assert len(own._parts) == len(words) and size <= 120 * len(words)
    assert own._held >= size


def test_languages_are_told_in_small_slices():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(700)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    language_id.features(["a"])
    tracemalloc.start()
    try:
        (out,) = language_id._frequencies(iter([batch]))
        assert out.num_rows and tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()


def test_written_tables_come_in_small_batches(spark):
    kept = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(kept)
    df = spark.range(4000, numPartitions=1).selectExpr("id", "repeat('ab ', 800) as text")
    sizes = settle(df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long"))
    assert max(r.n for r in sizes.collect()) < 2 << 20 and spark.conf.get(kept) == before
