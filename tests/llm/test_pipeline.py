"""The whole pipeline against the brute-force versions of its stages."""

import random

import corpus_pipeline
from courtside.llm import pieces

from test_dedup import brute_hits, brute_lines, brute_near, prose


def test_run(spark, tmp_path):
    import sentencepiece

    rnd = random.Random(4)
    passage, item = prose(rnd, 60, 90), prose(rnd, 25, 90)
    rows = [(i, prose(rnd, rnd.randrange(20, 60), 90) + ("\n" + passage if i % 5 == 0 else "") + (" " + item if i % 7 == 3 else "")) for i in range(40)]
    rows += [(100 + i, t + " tail") for i, t in rows[:6]] + [(200, "12 34"), (201, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]  # one language: only texts without letters go
    docs = sorted(brute_lines(docs, 50).items())
    near = brute_near(docs)
    docs = [(i, t) for i, t in docs if near[i][1] == i]
    docs = [(i, t) for i, t in docs if not brute_hits(t, [(1, item)])[-1]]
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    want = {i: (lib.encode(t, add_eos=True), t) for i, t in docs}
    got = {r.doc_id: (r.ids, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 20 < len(got) < len(rows) - 8


def test_awkward_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, columns whose names the operators use, and an empty table."""
    rnd = random.Random(5)
    texts = [prose(rnd, 30, 90) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, prose(rnd, 30, 90)), (None, None), (50, None), (51, ""), (52, " \n"), (53, "w1 " * 30000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, bucket long, node long, kept boolean, n long"
    df = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", len(t or ""), 0.1, "x", 1, 2, False, 3) for i, t in rows], schema)
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    items = spark.createDataFrame([(1, None), (2, ""), (2, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, f"{tmp_path}/a").columns == df.columns, name
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted([(True, i) for i in [*range(12), 3, 3, 53]] + [(False, 0)])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
