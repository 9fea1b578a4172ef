"""Secrets of any length are replaced whole."""

import random
import re

import pytest
from courtside.llm import pii


@pytest.mark.parametrize("n", [32, 256, 257, 320, 5000, 20001, 200000])
@pytest.mark.parametrize("before", ["", "token="])
def test_long_keys(spark, n, before):
    key = "".join(random.Random(n).choices("0123456789abcdef", k=n))
    text = f"see {before}{key} here"
    ((start, stop, kind, entity),) = pii.detected(text)
    assert (text[start:stop], kind, entity) == (key, "secret", key)
    new = pii.Surrogates(b"k").permuted(kind, entity)
    assert new != key and len(new) == n and re.fullmatch("[0-9a-f]+", new)


def test_dots_join_the_parts_of_a_token(spark):
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJ-SMeKK_x"
    text = f"token={token}. The next sentence, password: letmein123."
    assert [text[a:b] for a, b, _, _ in pii.detected(text)] == [token, "letmein123"]
    docs = spark.createDataFrame([(1, text), (2, "key=" + "aB3_" * 300)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_entities(docs, b"k").collect()}
    assert not any(part in got[1] for part in token.split(".")) and re.match(r"token=\w{12}\.\w{12}\.\w{8}-\w{5}_\w\. The next", got[1])
    assert len(got[2]) == 1204 and "aB3_" * 3 not in got[2]


def test_packed_numbers():
    r = random.Random(1)
    radices = [r.choice([2, 10, 21, 26, 256]) for _ in range(3000)]
    values = [r.randrange(x) for x in radices]
    assert pii._unpacked(pii._packed(values, radices)[0], radices) == values
    pieces = [pii.Surrogates(b"k")._mixed("x", [a, b, c], [2, 3, 5]) for a in range(2) for b in range(3) for c in range(5)]
    assert len({tuple(x) for x in pieces}) == 30
