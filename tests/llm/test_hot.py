"""Keys that hold a third of all rows, buckets of unlike texts, repeated ids, and other awkward tables."""

import random

import numpy as np
import pytest
from courtside.llm import common, decontamination, language_id, line_dedup, near_dedup, pieces
from courtside.llm.components import components
from courtside.llm.exact_dedup import exact_dedup
from pyspark.sql import functions as F

from test_dedup import brute_hits, brute_lines, brute_near, docs, prose


def test_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    one = common.settle(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")))
    joined = common.join_one(rows, one, ["k"], F.xxhash64("id"))
    want = {r.k: r.top for r in one.collect()}
    got = joined.collect()
    assert sorted(r.id for r in got) == list(range(3000)) and all(r.top == want[r.k] for r in got)


def test_copies_that_are_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "the same  text" if i % 3 == 0 else f"text {i % 40}") for i in range(600)]
    got = {r.doc_id: r for r in exact_dedup(docs(spark, rows)).collect()}
    for i, t in rows:
        ids = [j for j, u in rows if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))
    near = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(spark, rows)).collect()}
    assert near == {i: min(j for j, u in rows if u.split() == t.split()) for i, t in rows}


def test_lines_that_a_third_of_all_share(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rnd = random.Random(1)
    passage = [prose(rnd, 9) for _ in range(4)]
    rows = [(i, "\n".join([prose(rnd, 6), *(passage if i % 3 == 0 else []), prose(rnd, 7)])) for i in range(90)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows), least=20).collect()}
    assert got == brute_lines(rows, 20)


def unlike_texts(rnd, n):
    """Texts that share most of their words with each other, just below and just above the threshold."""
    base = prose(rnd, 60, 10**6).split()
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(rnd.choice([1, 2, 2, 3])):
            at = rnd.randrange(len(w))
            w[at] = f"own{i}x{at}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("sift", [True, False])
def test_buckets_of_unlike_texts(spark, monkeypatch, sift):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "PER_SALT", 5)
    rows = unlike_texts(random.Random(8), 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(spark, rows), sift=sift).collect()}
    assert got == brute_near(rows) and 1 < len({c for _, c in got.values()}) < 100


def test_repeated_ids_keep_the_links_of_all_their_texts(spark):
    rnd = random.Random(2)
    a, b = prose(rnd, 60, 10**6).split(), prose(rnd, 60, 10**6).split()
    near = lambda w: " ".join([*w[:-2], "other", "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (None, " ".join(a)), (None, None), (5, "else")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_groups(docs(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True)]


def test_sketch_bits_pass_over_no_similar_pair():
    """Of 3000 pairs at the threshold, at most as many are passed over as the stated rate allows: none."""
    rnd = np.random.default_rng(4)
    missed = 0
    for _ in range(3):
        both, own = rnd.integers(0, 1 << 62, (1000, 300)).astype(np.uint64), rnd.integers(0, 1 << 62, (2, 1000, 50)).astype(np.uint64)
        sides = [np.sort(np.concatenate([both, own[k]], 1)) for k in (0, 1)]  # 300 of 400: 0.75
        off = np.arange(1001) * 350
        for t, longs, most in ((160, near_dedup.LONGS, near_dedup.MISMATCHES), (1024, near_dedup.FINE_LONGS, near_dedup.FINE_MISMATCHES)):
            a, b = (near_dedup._two_bits(near_dedup.sketches(s.ravel(), off, t), longs).view(np.uint64) for s in sides)
            x = a ^ b
            missed += int((np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(0) > most).sum())
    assert missed == 0


def test_components_of_chains_and_stars(spark):
    chain, star = [(i, i + 1) for i in range(100, 140)], [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (260, 259)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(200, 261)}}


def test_fingerprints_that_thousands_of_items_share(spark):
    rnd = random.Random(6)
    stem = prose(rnd, 8, 10**6)
    items = [(i, f"{stem} {prose(rnd, 6, 10**6)}") for i in range(300)] + [(900, "short item"), (901, f"{stem} and more than that here")]
    rows = [(i, f"{prose(rnd, 5)} {stem} {prose(rnd, 5)}") for i in range(100)] + [(200, f"x {items[3][1]} y"), (201, "a short item, or two: short item"), (202, None), (202, None), (None, items[-1][1])]
    got = {(r.doc_id, r.n_hit): tuple(r)[1:6] for r in decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = [(i, brute_hits(t, items)) for i, t in rows]
    assert got == {(i, w[1]): w for i, w in want}


def test_language_corner_cases(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * 3, "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, "the cat and the dog " * 20000, None), (101, "the cat", None), (101, "the cat", None), (None, "le chat", "fr")]
    df = spark.createDataFrame([(*r, "old", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.train(df, F.lit(True))
    got = language_id.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 9)))
    assert by[100][0][0] == "en" and by[101][0] == by[101][1] and by[101][0][0] == "en" and by[None][0][0] == "fr"
    tie = language_id.LanguageModel(["aa", "bb"], np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2), 1.0)
    assert tie.predict(["word"])[0] == ["aa"] and tie.predict(["word"])[1][0] == 0.5
    many = spark.createDataFrame([(i, f"word{i} " * 3, f"l{i}") for i in range(1200)], "doc_id long, text string, lang string")
    assert len(language_id.train(many, F.lit(True)).languages) == 1200


def test_training_by_its_definition():
    """The sparse steps against follow-the-regularised-leader over whole vectors."""
    rnd = np.random.default_rng(1)
    samples = [(np.unique(rnd.integers(0, 6, 3)), None, int(rnd.integers(0, 2))) for _ in range(12)]
    samples = [(b, rnd.random(len(b)).astype(np.float32), y) for b, _, y in samples]
    idf = np.ones(language_id.BUCKETS)
    weights, bias = language_id.fit(samples, 2, idf)
    z, n = np.zeros((7, 2)), np.zeros((7, 2))
    solved = lambda: np.array([[0.0 if abs(z[i, k]) <= language_id.L1 else -(z[i, k] - np.sign(z[i, k]) * language_id.L1) / ((language_id.BETA + n[i, k] ** 0.5) / language_id.ALPHA + language_id.L2) for k in (0, 1)] for i in range(7)])
    for _ in range(language_id.EPOCHS):
        for b, share, y in samples:
            x = np.zeros(7)
            x[b], x[6] = share, 1.0
            w = solved()
            p = np.exp(x @ w) / np.exp(x @ w).sum()
            g = np.outer(x, p - np.eye(2)[y])
            for i in [*b, 6]:
                sigma = ((n[i] + g[i] ** 2) ** 0.5 - n[i] ** 0.5) / language_id.ALPHA
                z[i] += g[i] - sigma * w[i]
                n[i] += g[i] ** 2
    w = solved()
    assert np.allclose(weights[:6], w[:6]) and np.allclose(bias, w[6]) and not weights[6:].any()


def test_pieces_of_empty_and_repeated_rows(spark):
    df = docs(spark, [(1, None), (1, None), (2, ""), (None, "a  b")])
    got = pieces.encode_pieces(df, pieces.public_model())
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in got.collect())[1:] == [(1, 1, ""), (1, 1, ""), (2, 1, "")]
    assert pieces.encode_pieces(df.limit(0), pieces.public_model()).count() == 0
