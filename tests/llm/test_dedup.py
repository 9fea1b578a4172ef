"""Exact, line and near dedup and decontamination against brute force, on small awkward tables."""

import hashlib
import random
import re
import string

import pytest
from courtside.llm.decontamination import decontaminate
from courtside.llm.exact_dedup import exact_dedup
from courtside.llm.line_dedup import dedup_lines
from courtside.llm.near_dedup import near_groups
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, id long, body string"  # the last two clash with inner names
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "x") for i, t in rows], SCHEMA)


def prose(rnd, n, words=300):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (6, "A"), (7, " a"), (8, "a\tb"), (9, "a \n b"), (9, "a \n b"), (10, "é" * 20000 + " z"), (None, "a"), (11, "\x00 b"), (12, "\u00a0")]


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string")])
def test_exact(spark, digest):
    rows = AWKWARD + [(100 + i, "same  text") for i in range(40)]
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs(spark, rows), digest=digest).collect())
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i or -1, keep or -1, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_tables(spark):
    none, items = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup(none).count() == dedup_lines(none, counts=True).count() == near_groups(none).count() == decontaminate(none, items).count() == 0
    one = docs(spark, [(1, "a b")])
    assert decontaminate(one, items).head().n_hit == 0


def brute_lines(rows, least):
    """Cuts later repeated runs, by comparing all runs of all texts."""
    lines = {i: [(k, l, len(re.findall(r"[^\x20\x09-\x0D]+", l))) for k, l in enumerate(t.split("\n"))] for i, t in rows}
    worded = {i: [x for x in ls if x[2]] for i, ls in lines.items()}
    first, cut = {}, {i: set() for i in lines}
    for i in sorted(worded):
        w = worded[i]
        for a in range(len(w)):
            for b in range(a, len(w)):
                if (size := sum(x[2] for x in w[a : b + 1])) >= least:
                    run = tuple(x[1] for x in w[a : b + 1])
                    j, end = first.setdefault(run, (i, b))
                    if (j, end) != (i, b) and (j != i or a > end):
                        shortest = size - max(w[a][2], w[b][2]) < least  # then wordless lines in it go too
                        cut[i].update(range(w[a][0], w[b][0] + 1) if shortest else [x[0] for x in w[a : b + 1]])
    return {i: "\n".join(l for k, l, _ in ls if k not in cut[i]) for i, ls in lines.items()}


def test_lines(spark):
    rnd = random.Random(3)
    pool = [prose(rnd, n) for n in (3, 5, 8, 12, 20, 60)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else prose(rnd, rnd.randrange(1, 15)) for _ in range(rnd.randrange(1, 12)))) for i in range(40)]
    rows.append((99, "\n".join([pool[4], pool[3]] * 3)))
    got = {r.doc_id: r.text for r in dedup_lines(docs(spark, rows), least=20).collect()}
    assert got == brute_lines(rows, 20)
    kept = dedup_lines(docs(spark, AWKWARD)).collect()
    assert len(kept) == len(AWKWARD) and kept[0].asDict().keys() == {"doc_id", "text", "lang", "id", "body"}
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted((i or -1, t or "") for i, t in AWKWARD)


def shingles(t):
    w = (t or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near(spark):
    rnd = random.Random(5)
    rows = [r for r in AWKWARD if r[0] is not None]
    at = 200
    for _ in range(12):  # chains of near copies, some just above and some just below the threshold
        words = prose(rnd, rnd.choice([6, 40, 150])).split()
        for _ in range(rnd.randrange(1, 14)):
            rows.append((at, " ".join(words)))
            at += 1
            words = words[:]
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(1000)}"
    want = brute_near(rows)
    for r in near_groups(docs(spark, rows)).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def brute_hits(text, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = cut.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        x = cut.findall((t or "").translate(LOWER))
        n = min(10, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    rnd = random.Random(9)
    items = [(i, prose(rnd, n, 60)) for i, n in enumerate((1, 2, 4, 5, 7, 9, 10, 11, 30, 80))] + [(50, None), (51, "!!"), (8, "W1, w2"), (60, prose(rnd, 12) + " Tail")]
    rows = list(AWKWARD)
    for i in range(60):
        part = rnd.choice(items)[1] or ""
        words = part.split()
        a = rnd.randrange(max(1, len(words)))
        rows.append((300 + i, f"{prose(rnd, rnd.randrange(30), 60)}. {' - '.join(words[a : a + rnd.randrange(1, 40)]).upper()} {prose(rnd, rnd.randrange(12), 60)}"))
    out = decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())
    assert got == sorted((i or -1, *brute_hits(t, items)) for i, t in rows)
