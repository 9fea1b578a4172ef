"""Packing: ids against the library, places against their definition, numbers of sequences against bounds."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from courtside.llm import packing
from courtside.llm.packing import Encoder, configurations, cut, encoded, pack, plan, public_tokenizer, token_pieces
from hypothesis import given, settings
from hypothesis import strategies as st

TEXTS = [None, "", " \n", "a", "Don't DON'T we'll x'S 's", "Crème BRÛLÉE übermäßig naïve", "İstanbul ΣΑΣ ΑΣ.", "á ́b ç ẹ́", "x<|endoftext|>y <|startoftext|>", "q\x1cw\x85e\xa0r t\x0bu", "漢字かな交じり文 한국어", "12,345.67% *** --- ½ ² µ ª", "\x00 � \U0001f600\U0001f600", "http://a.b/c?d=e&f=1", "wOrD," * 40 + " " + "z" * 500]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer())


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def ids(parts):
    pieces = list(cut(parts, 7, 1))
    assert all(len(p) == 7 for p in pieces[:-1]) and 0 < len(pieces[-1]) <= 7
    return np.concatenate(pieces).tolist()


def test_ids_are_the_librarys(library, monkeypatch):
    rnd = random.Random(8)
    some = ["".join(rnd.choice("aB é'ßÀ\n1.<|>-漢́\xa0ſÿ×") for _ in range(rnd.randrange(60))) for _ in range(400)]
    some += ["".join(rnd.choice("aB 'sStTrReEvVmMlLdD12.,-!éÀÿ\n") for _ in range(rnd.randrange(60))) for _ in range(400)]  # plain ones
    encoder = Encoder(public_tokenizer())
    assert encoder.blanks_drop
    texts = [*TEXTS, *some, *TEXTS]  # the second time from what is kept
    assert [ids(p) for p in encoded([t or "" for t in texts], encoder)] == [whole(library, t) for t in texts]
    monkeypatch.setattr(packing, "KEPT", 3000)  # parts are forgotten all the time
    monkeypatch.setattr(packing, "TEXT", 10)
    encoder = Encoder(public_tokenizer())
    texts = [*TEXTS, *some[:100], *TEXTS]
    assert [ids(p) for p in encoded([t or "" for t in texts], encoder)] == [whole(library, t) for t in texts]
    assert len(encoder.young) + len(encoder.old) < 60


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    assert not encoder.blanks_drop
    for text in TEXTS:
        assert np.concatenate(list(cut(next(encoded([text or ""], encoder)), 50, 50256))).tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 50256]


def check_plan(histogram, rows, n, capacity):
    """Every piece has one place, sequences are gapless and none is too long."""
    numbers, places = defaultdict(list), defaultdict(list)
    for length, first, count, sequence, offset in rows.tolist():
        numbers[length] += range(first, first + count)
        for k in range(count):
            places[sequence + k].append((offset, length))
    assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(c)) for k, c in histogram.items() if c}
    assert sorted(places) == list(range(n))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25), st.sampled_from([1, 3, 8]), st.sampled_from([2, 5, 50]))
def test_plans_are_whole(histogram, large, groups):
    rows, n = plan(histogram, 40, large, groups)
    check_plan(histogram, rows, n, 40)
    total = sum(k * c for k, c in histogram.items())
    assert -(-total // 40) <= n <= 2 * total / 40 + 1  # no two sequences are half empty


@pytest.mark.parametrize("shape", ["lognormal", "uniform", "middle", "one"])
def test_few_sequences(shape):
    rng = np.random.default_rng(9)
    lengths = {"lognormal": np.clip(rng.lognormal(6, 1.2, 20_000), 1, 4096).astype(int), "uniform": rng.integers(1, 4097, 20_000), "middle": rng.integers(1100, 3000, 20_000), "one": np.full(20_000, 1000)}[shape]
    histogram = dict(Counter(lengths.tolist()))
    rows, n = plan(histogram)
    check_plan(histogram, rows, n, 4096)
    assert n <= -(-int(lengths.sum()) // 4096) * {"one": 1.03}.get(shape, 1.015) + 1 and len(rows) < 30_000


def test_the_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(10)
    few = Counter(np.clip(rng.lognormal(6, 1.2, 50_000), 1, 4096).astype(int).tolist())
    sizes = [len(plan({k: c * m for k, c in few.items()})[0]) for m in (10, 10_000_000)]
    assert sizes[1] < 1.5 * sizes[0]


def test_configurations_cover_what_is_needed():
    sizes, need = np.array([50, 30, 20]), np.array([10, 10, 10])
    found = configurations(sizes, need, 100)
    assert all((c * sizes).sum() <= 100 for c, _ in found) and (sum(c * x for c, x in found) >= need - 1e-6).all()
    assert sum(x for _, x in found) == pytest.approx(10)  # one of each


def test_whole_operator(spark, library):
    rnd = random.Random(11)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a"), (3, "a")] + [(100 + i, " ".join(rnd.choice(["alpha", "Beta", "gamma,"]) for _ in range(rnd.randrange(90)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, length long, sequence_id long")
    pieces = token_pieces(docs, public_tokenizer(), capacity=64)
    got = pack(pieces.withColumn("more", pieces.piece + 1), capacity=64).collect()
    want = []
    for i, t in rows:
        ids = whole(library, t)
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.more == r.piece + 1 for r in got)
    loads = defaultdict(list)
    for r in got:
        loads[r.sequence_id].append((r.offset, r.length))
    for x in loads.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert len(loads) <= 1.05 * sum(w[3] for w in want) / 64 + 1


def test_hot_length_and_empty(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    got = pack(spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7L, id % 11 + 1) as length"), capacity=32).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000 == len({r.id for r in got})
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 32 * 1.02 + 1
    assert pack(spark.createDataFrame([], "length int")).collect() == []
    with pytest.raises(Exception, match="no piece has length"):
        pack(spark.createDataFrame([(0,)], "length int")).collect()
