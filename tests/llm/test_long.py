"""Texts of very many lines, and parts without spaces: linear work and bounded memory."""

import random
import time

import sentencepiece
from courtside.llm import pieces
from courtside.llm.line_dedup import dedup_lines
from test_dedup import brute_lines


def test_text_of_very_many_lines(spark):
    rng = random.Random(3)
    line = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(6))
    run = [line() for _ in range(20)]
    own = [line() for _ in range(100_000)]
    text = "\n".join([*own[:50_000], *run, *own[50_000:80_000], *run, *own[80_000:], *run])
    docs = spark.createDataFrame([(1, text), (2, "\n".join(["a b", *run, "c d"])), (3, None)], "doc_id int, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert got == {1: "\n".join([*own[:50_000], *run, *own[50_000:]]), 2: "a b\nc d", 3: None}


def test_cuts_that_overlap_and_nest_equal_brute_force(spark):
    rng = random.Random(11)
    lines = [" ".join(f"w{k}" for k in range(n, n + rng.choice((0, 1, 2, 7, 30, 60)))) for n in range(40)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 9)):
            at = rng.randrange(len(lines))
            text += lines[at : at + rng.randrange(1, 12)]
        rows.append((i, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == brute_lines(rows, 50)


def test_known_parts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "PARTS_KEPT", 20_000)
    rng = random.Random(5)
    path = pieces.public_model()
    with open(path, "rb") as f:
        own = pieces.BpePieces(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(60):
        text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.choice((3, 90, 700)))) + " the the " + "".join(rng.choice("abcdef ") for _ in range(200))
        assert own.encode(text) == [*library.encode(text), own.end]
        assert own._held <= 10_000 and len(own._parts) <= 50 and len(own._older) <= 50
    own.encode("中" * 5000)
    assert "▁" + "中" * 5000 not in own._parts | own._older
