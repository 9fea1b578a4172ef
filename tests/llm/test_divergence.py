"""Source divergence against sums over plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from courtside.llm import divergence
from courtside.llm.divergence import divergences, terms_of, weights

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, rank string"  # the last three clash


def brute(rows, least, top):
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        held[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= least]
        p = {}
        for s in [*sources, None]:
            c = {t: sum(n[lang, x][t] for x in (sources if s is None else [s])) for t in kept}
            total = sum(c.values())
            p[s] = {t: (1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)), c[t]) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            found = {"pair": [(x, sum(f(p[s][t][0], p[x][t][0]) for t in kept)) for x in sources - {s}], "term": [(t, f(p[s][t][0], p[None][t][0])) for t in kept if p[s][t][1] and p[s][t][0] > p[None][t][0]]}
            for part, items in found.items():
                for rank, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, v, rank))
    return out


def got(spark, rows, **options):
    df = divergences(spark.createDataFrame([(7, *r, "x", 1, "y") for r in rows], SCHEMA), **options)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("options", [{}, {"block": 3, "tile": 2}, {"block": 1, "tile": 1}])
def test_against_brute_force(spark, options):
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choice(["the", "The", "of", "Été", "été", "漢字", "x-y", "a1b", "z" * 300, "\x00q"]) for _ in range(rnd.randrange(30))), rnd.choice(["en", "fr", None, ""]), rnd.choice(["s1", "s1", "s1", "s2", "é", None, "t3"])) for _ in range(150)]
    rows += [("rare words only here", "de", "s1"), (None, "de", "s2"), ("", "xx", None), ("alone", "yy", "only")] + [("same text", "en", "s1")] * 20
    assert got(spark, rows, least_docs=5, top=3, **options) == brute(rows, 5, 3)


def test_ties_and_empty(spark):
    rows = [("b a c", "en", "s"), ("b a c", "en", "s"), ("d d", "en", "t"), ("d d", "en", "t")]  # a, b, c tie everywhere
    assert got(spark, rows, least_docs=2) == brute(rows, 2, 10)
    assert got(spark, []) == set()
    assert got(spark, [(None, None, None)]) == set()


def test_hot_source_and_long_text(spark):
    rows = [("a b " * 200_000 + "é" * 3_000_000, "en", "hot")] + [("a c", "en", "hot")] * 300 + [("b c", "en", f"s{i % 30}") for i in range(300)]
    assert got(spark, rows, tile=4) == brute(rows, 10, 10)


def test_few_entries_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "ENTRIES", 2)
    batch = pa.RecordBatch.from_pydict({"lang": ["e"] * 4, "source": ["s", "t", "s", "s"], "text": ["a b", "b", "a a c", ""]})
    total = Counter()
    for part in divergence._counted(iter([batch])):
        for r in part.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert +total == {("s", "a"): 3, ("s", "b"): 1, ("s", "c"): 1, ("t", "b"): 1}


def test_cut_texts_and_large_counts(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 5)
    assert [t for part in terms_of(b"Ab cde\xc3\xa9f-gh  ijklmnopq r") for t in part] == [b"ab", b"cde\xc3\xa9f", b"gh", b"ijklmnopq", b"r"]
    for n, total, v in ((10**14, 2 * 10**14, 10**6), (0, 0, 1), (5, 5, 1), (123_456_789_012, 987_654_321_098, 77)):
        assert weights(np.array([n]), np.array(total), np.array(v))[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_a_task_counts_texts_together(monkeypatch):
    """Terms aren't counted one by one, and what a task has counted is sent once, not every few texts."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "Counter", None)
    rows = [{"lang": "e", "source": f"s{i % 2}", "text": f"A{'bcdefghij'[i % 9]} x{'yz'[i % 2]} {chr(97 + i % 26) * (1 + i % 40)}é"} for i in range(6000)]
    parts = list(divergence._counted(iter(pa.RecordBatch.from_pylist(rows[i : i + 500]) for i in range(0, 6000, 500))))
    found = [(r["source"], r["term"], r["n"], r["docs"]) for p in parts for r in p.to_pylist()]
    assert len({x[:2] for x in found}) == len(found) and sum(x[2] for x in found) == 18_000
    wanted = Counter((r["source"], t) for r in rows for t in r["text"].lower().split())
    assert {x[:2]: x[2] for x in found if x[1]} == wanted and all(x[2] == x[3] for x in found)


@pytest.mark.parametrize("part, held", [(5, 20), (20, 30), (1 << 20, 1 << 30)])
def test_texts_apart_or_together(spark, monkeypatch, part, held):
    monkeypatch.setattr(divergence, "PART", part)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [("ab c", "e", "s"), ("d", "e", "s"), ("", "f", "s"), ("ab ab Éé x1y", "e", "t"), ("c" * 40 + " c", "f", "t")]
    total, docs = Counter(), Counter()
    import pyarrow as pa

    for p in divergence._counted(iter([pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), r, strict=True)) for r in rows])])):
        for r in p.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    assert total == {("e", "s", None): 0, ("f", "s", None): 0, ("e", "t", None): 0, ("f", "t", None): 0, ("e", "s", "ab"): 1, ("e", "s", "c"): 1, ("e", "s", "d"): 1, ("e", "t", "ab"): 2, ("e", "t", "Éé"): 1, ("e", "t", "x"): 1, ("e", "t", "y"): 1, ("f", "t", "c" * 40): 1, ("f", "t", "c"): 1}
    assert docs["e", "t", "ab"] == 1 and docs["f", "t", "c"] == 1
