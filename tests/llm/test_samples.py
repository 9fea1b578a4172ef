"""Samples that teach, where ids are missing or all the same."""

import corpus_pipeline
import pytest
from courtside.llm import html_extraction, language_id
from courtside.llm.common import hashed_sample
from pyspark.sql import functions as F

WORDS = {"en": "the house and some other words of this language", "de": "das haus und einige andere wörter dieser sprache", "fr": "la maison et quelques autres mots de cette langue"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, of_id, n=240):
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        w = WORDS[lang].split()
        text = " ".join(w[(i * 7 + k * (1 + i % 5)) % len(w)] for k in range(8 + i % 4)) + f" {i}"
        rows.append((of_id(i), text, lang, "s", len(text)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("of_id", [lambda i: None, lambda i: 3, lambda i: 7, lambda i: i % 2])
def test_language_samples(spark, of_id):
    d = docs(spark, of_id)
    model = language_id.train(d, F.lit(True), sample=20)
    assert abs(model.weights).max() > 0
    got = language_id.identify(d, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)


def test_sample_is_bounded_and_never_empty(spark):
    d = docs(spark, lambda i: None)
    copies = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    rows = copies.unionByName(d.select("doc_id", "text", "lang"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    got = hashed_sample(rows, "lang", ["doc_id", "text"], 10, counts).collect()
    assert {k: sum(r.lang == k for r in got) for k in counts} == dict.fromkeys(counts, 10)
    only = hashed_sample(copies, "lang", ["doc_id", "text"], 10, {"en": 3000}).collect()
    assert len(only) == 1


@pytest.mark.parametrize("of_id", [None, 3])
def test_page_samples(spark, of_id):
    page = "<html><body><nav><a href='/'>home</a></nav><article><p>Words of the article number {i}, which are many enough.</p></article><footer>imprint</footer></body></html>"
    pages = spark.createDataFrame([(of_id, page.format(i=i)) for i in range(60)], "page_id long, html string")
    model = html_extraction.train(pages, sample=5)
    got = html_extraction.extract(pages, model, keep=()).collect()
    assert all(r.text.startswith("Words of the article number") and "imprint" not in r.text for r in got)


@pytest.mark.parametrize("of_id", [lambda i: None, lambda i: 3])
def test_pipeline_keeps_documents_whose_ids_say_nothing(spark, of_id):
    d = docs(spark, of_id)
    assert corpus_pipeline.language(spark, d, "").count() > 0.95 * d.count()
