"""Whether neighbouring pieces fit is told from their own merges, and each piece is merged once."""

import random

import pyarrow.parquet as pq
from courtside.llm import pieces

from conftest import SF


def own():
    with open(pieces.public_model(), "rb") as f:
        return pieces.BpePieces(f.read())


def test_fits_as_merging_anew():
    b, rnd = own(), random.Random(5)
    ids, marks = [*b.ids.values()], [i for p, i in b.ids.items() if not p.strip(pieces.SPACE_MARK)]
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(4000)] + [(x, y) for x in marks for y in [*marks, *rnd.sample(ids, 50)]]
    for piece in rnd.sample([p for p in b.ids if len(p) > 1], 4000):  # halves of pieces, which mostly merge
        k = rnd.randrange(1, len(piece))
        if piece[:k] in b.ids and piece[k:] in b.ids:
            pairs.append((b.ids[piece[:k]], b.ids[piece[k:]]))
    wanted = [b.merged(b.pieces[x] + b.pieces[y]) == [x, y] for x, y in pairs]
    assert [b.fits(x, y) for x, y in pairs] == wanted and 1000 < sum(wanted) < len(pairs) - 1000


def test_a_piece_is_merged_once():
    b, asked, merged = own(), [], pieces.BpePieces.merged
    b.merged = lambda text, *steps: asked.append(text) or merged(b, text, *steps)
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    for text in texts:
        b.packed(text or "")
    once = [t for t in asked if not t.startswith(pieces.SPACE_MARK * 2)]
    assert len(b._fits) > len(once) and len(once) == len({*once}) and {*once} <= b.ids.keys()
