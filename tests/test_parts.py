"""Order statistics, vocabularies and CSV files with headers of their own, against plain Python."""

import gzip
import random
import statistics

import pytest
from courtside.operators import prep
from courtside.sources import matches as src
from pyspark.sql import functions as F

VALUES = {
    "spread": lambda r: r.gauss(0, 1e6),
    "ties": lambda r: float(r.choice([1, 1, 1, 5, 5, 5, 2, 3])),
    "two": lambda r: float(r.randrange(2)),
    "far": lambda r: r.choice([1, -1]) * 10.0 ** r.randrange(-300, 300),
    "one": lambda r: 7.0,
    "gaps": lambda r: None if r.random() < 0.3 else r.choice([float("nan"), r.random()]),
    "none": lambda r: None,
}


@pytest.mark.parametrize("n", [0, 1, 2, 301, 5000])
def test_medians_are_exact(spark, n):
    rnd = random.Random(n)
    rows = [tuple(f(rnd) for f in VALUES.values()) for _ in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{k}` double" for k in VALUES)).repartition(4)
    got = prep.medians(df, list(VALUES), gathered=20).first()
    for i, k in enumerate(VALUES):
        known = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[k] == (statistics.median(known) if known else None), k


def test_places(spark):
    df = spark.createDataFrame([(float(x),) for x in random.Random(1).choices(range(500), k=4000)], "a double")
    want = sorted(r.a for r in df.collect())
    places = [0, 1, 17, 1999, 2000, 3998, 3999]
    assert prep.at_places(df, [("a", p, 4000) for p in places], gathered=10) == [want[p] for p in places]


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_vocabulary_of_common_beginnings(spark, most):
    rnd = random.Random(2)
    words = ["http://example.com/" + "".join(rnd.choice("ab/é") for _ in range(rnd.randrange(9))) for _ in range(400)] + ["", "h", "http", "http://example.com/", None, "nan", "x", "漢字", "漢", "\U0001f600"]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    got = {r.value: r.code for r in prep.vocabulary(df, "w", most).collect()}
    assert got == {w: i for i, w in enumerate(sorted({w if w is not None else "nan" for w in words}, key=lambda w: w.encode()))}
    leads = prep._leads(df.where("w is not null").select(F.col("w").alias("value")).distinct(), most)
    assert leads.groupBy("lead").count().agg(F.max("count")).first()[0] <= most


def test_files_of_different_headers(spark, tmp_path):
    (tmp_path / "season=2001").mkdir()
    (tmp_path / "season=2002").mkdir()
    (tmp_path / "season=1990").mkdir()
    (tmp_path / "season=2001" / "a.csv").write_text("tourney_date,winner_name,loser_name,winner_rank,match_num\n20010101,Ann,Bob,3,1\n")
    (tmp_path / "season=2001" / "b.csv").write_text('﻿loser_name,"best, of",winner_name,match_num,tourney_date\nCy,5,"Dee, D.",2,20010202\n')
    with gzip.open(tmp_path / "season=2002" / "c.csv.gz", "wt") as f:
        f.write("match_num,tourney_date,surface,loser_name,winner_name\n3,20020303,Clay,Eve,Fay\n")
    (tmp_path / "season=2002" / "empty.csv").write_text("")
    (tmp_path / "season=1990" / "bad.csv").write_text("winner_name,winner_name\nx,y\n")  # isn't opened
    got = src.read_seasons(spark, str(tmp_path))
    rows = {r.match_num: (r.winner_name, r.loser_name, r.winner_rank, r.surface, str(r.tourney_date), r.source_year) for r in got.collect()}
    assert rows == {1: ("Ann", "Bob", 3.0, None, "2001-01-01", 2001), 2: ("Dee, D.", "Cy", None, None, "2001-02-02", 2001), 3: ("Fay", "Eve", None, "Clay", "2002-03-03", 2002)}
    assert {r.match_num: r["best, of"] for r in src.read_seasons(spark, str(tmp_path), others=True).collect()} == {1: None, 2: "5", 3: None}
    with pytest.raises(ValueError, match="repeats"):
        src.read_seasons(spark, str(tmp_path), 1990, 1990)
    assert src.read_seasons(spark, str(tmp_path), 1950, 1960).count() == 0


def test_exchanged_columns_keep_their_winners(spark, tmp_path):
    m = src.derived_matches(spark, "/root/testdata/sf0.001").withColumn("tourney_date", F.date_format("tourney_date", "yyyyMMdd"))
    columns = [{"winner_name": "loser_name", "loser_name": "winner_name"}.get(c, c) for c in m.columns]
    m.select(columns).write.option("header", True).csv(str(tmp_path / "season=2000"))
    want = {r.match_num: (r.winner_name, r.loser_name) for r in m.collect()}
    assert {r.match_num: (r.winner_name, r.loser_name) for r in src.read_seasons(spark, str(tmp_path)).collect()} == want
