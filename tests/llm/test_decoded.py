"""What a text decodes to comes from its ids, as in the library, also where they name pieces that no text encodes to."""

import random

import sentencepiece
from courtside.llm import pieces


def own():
    with open(pieces.public_model(), "rb") as f:
        return pieces.BpePieces(f.read())


def test_every_text_is_decoded_from_its_ids():
    b, asked, decode = own(), [], pieces.BpePieces.decode
    b.decode = lambda ids: asked.append(list(ids)) or decode(b, asked[-1])
    texts = ["plain words", "", "more\nlines  here", "中 and é", "plain words"]
    for text in texts:
        ids, decoded = b.packed(text)
        assert asked[-1] == memoryview(ids).cast("i").tolist() and decoded == text
    assert len(asked) == len(texts)
    b.texts = [t.upper() if t else t for t in b.texts]
    assert b.packed("plain words")[1] == "PLAIN WORDS"


def test_any_ids_decode_as_in_the_library():
    b, lib, rnd = own(), sentencepiece.SentencePieceProcessor(model_file=pieces.public_model()), random.Random(6)
    odd = [0, 1, 2, *b.byte_ids[:12], *b.byte_ids[0xC0:0xC8], *b.byte_ids[0xE0:0xF5], *b.byte_ids[0x80:0x90], b.ids["▁"], b.ids["▁the"]]
    for _ in range(3000):
        ids = [rnd.choice(odd) if rnd.random() < 0.7 else rnd.randrange(len(b.pieces)) for _ in range(rnd.randrange(9))]
        assert b.decode(ids) == lib.decode(ids), ids
