"""Scoring, language, pieces, PII, pages and urls on small awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from courtside.llm import html_extraction as html
from courtside.llm import language_id, lm_scoring, pieces, pii, url_filters
from courtside.llm.hashed import Table
from courtside.llm.common import crc_mod
from courtside.llm.ctw import Levels, grams, log_kt
from pyspark.sql import functions as F

TEXTS = [None, "", " \n", "A", "a a a", "The cat sat.\nThe cat sat on the mat.", "naïve é \x00 \u2581 𝔘 x", "the cat", "the cat", "z" * 30000, "1 2 3"] + [f"the {w} sat on mat {i}" for i, w in enumerate("cat dog cow hen fox".split() * 8)]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, gram long")


def test_kt_and_normalisation():
    def kt(a, b):
        p, z, o = 0.0, 0, 0
        for bit in [0] * a + [1] * b:
            p += math.log(((o if bit else z) + 0.5) / (z + o + 1))
            z, o = z + (not bit), o + bit
        return p

    for a, b in ((0, 0), (1, 0), (3, 5), (40, 2)):
        assert log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(kt(a, b))
    big = log_kt(np.array([5000]), np.array([4000]))[0]
    assert big == pytest.approx(math.lgamma(5000.5) + math.lgamma(4000.5) - math.log(math.pi) - math.lgamma(9001), rel=1e-12)
    key, off = grams(np.frombuffer(b"abracadabraabra", np.uint8), np.array([11, 4]), 3)
    seen, n = np.unique(key[:off[1]], return_counts=True)
    context = int(seen[3]) >> 8 << 8
    ask = np.union1d(seen, np.array([context | b for b in range(256)], np.uint64))
    p, _ = Levels(ask, np.array([dict(zip(seen.tolist(), n.tolist())).get(k, 0) for k in ask.tolist()]), 3, 0).mixed()
    assert p.prod(0)[(ask >> np.uint64(8)) == context >> 8].sum() == pytest.approx(1)


def brute_scores(texts, train, depth):
    """Context-tree weighting by its definition: dictionaries of contexts, one decision at a time."""
    count, below = {}, {}

    def decisions(text):
        padded = b"\xff" * depth + text + b"\xff"
        for at in range(depth, len(padded)):
            bits = f"{padded[at]:08b}"
            for k in range(8):
                yield bits[:k], int(bits[k]), [padded[at - d : at] for d in range(depth + 1)]

    for text, learned in zip(texts, train):
        for node, bit, contexts in decisions(text) if learned else ():
            for c in contexts:
                count.setdefault((node, c), [0, 0])[bit] += 1
    for node, c in count:
        if c:
            below.setdefault((node, c[1:]), []).append((node, c))

    def own(x):
        z, o = count[x]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    weight = {}
    for x in sorted(count, key=lambda x: -len(x[1])):
        inner = sum(weight[y] for y in below.get(x, []))
        weight[x] = own(x) if len(x[1]) == depth else math.log(0.5) + max(own(x), inner) + math.log1p(math.exp(-abs(own(x) - inner)))
    out = []
    for text in texts:
        total = 0.0
        for node, bit, contexts in decisions(text):
            p = None
            for c in reversed(contexts):
                z, o = count.get((node, c), (0, 0))
                here = ((o if bit else z) + 0.5) / (z + o + 1)
                if p is None:
                    p = here
                else:
                    stay = math.exp(own((node, c)) + math.log(0.5) - weight[node, c]) if (node, c) in count else 1.0
                    p = stay * here + (1 - stay) * p
                p = p if z + o else None
            total += math.log10(here if p is None else p)
        out.append(total)
    return out


@pytest.mark.parametrize("partitions", [20_000, 2])
def test_scores(spark, monkeypatch, partitions):
    monkeypatch.setattr(lm_scoring, "UNIT", 10)
    monkeypatch.setattr(lm_scoring, "PARTITIONS", partitions)
    rows = [*enumerate(TEXTS), (3, "A"), (4, "a a a"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, gram long")
    got = [(r.doc_id, tuple(r)[1:]) for r in lm_scoring.score_texts(df, crc_mod("doc_id", 5) == 1, chunk_bytes=200).collect()]
    canon = [(t or "").encode().lower().split() for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(canon, held) if not h for w in [*ws, b""])
    total, kinds = sum(c.values()), len(c)
    joined = [b" ".join(ws) for ws in canon]
    score = brute_scores(joined, [not h for h in held], lm_scoring.DEPTH)
    want = []
    for k, (i, _) in enumerate(rows):
        all_ = [*canon[k], b""]
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in all_)
        want.append((i, (held[k], len(all_), sum(c[w] > 0 for w in all_), total, pytest.approx(base), pytest.approx(score[k]), pytest.approx(-score[k] * math.log2(10) / (len(joined[k]) + 1)))))
    by = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(got, key=by) == sorted(want, key=by)
    assert lm_scoring.score_texts(docs(spark, []), F.lit(False)).count() == 0


def test_unlearned_scores(spark):
    (row,) = lm_scoring.score_texts(docs(spark, ["ab"]), F.lit(True)).collect()
    assert row.score == pytest.approx(3 * 8 * math.log10(0.5)) and row.bits_per_byte == pytest.approx(8) and row.n_known == 0 and row.train_tokens == 0


def test_looked_up_values():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 5000):
        key = np.unique(np.concatenate([rnd.integers(0, 1 << 60, n).astype(np.uint64), np.arange(n // 2, dtype=np.uint64)]))
        value = rnd.random(len(key))
        assert (Table(key, value).of(np.tile(key, 3)) == np.tile(value, 3)).all()


def test_language(spark):
    rnd = random.Random(1)
    words = {"en": "the and of with that was".split(), "fr": "le les des avec que était".split()}
    rows = [(i, " ".join(rnd.choices(words[k := ("en", "fr")[i % 2]], k=12)), k) for i in range(200)] + [(900, None, "en"), (901, "12 !", "fr"), (902, "the was", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, crc_mod("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    held = [r for r in rows[:200] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == k for i, _, k in held]) == 1.0
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.train(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_pieces(spark):
    import sentencepiece

    model = pieces.public_model()
    own, lib = pieces.BpePieces(open(model, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=model)
    rnd = random.Random(2)
    bits = [" ", "  ", "▁", "a", "the", "\n", "é", "𝔘", "中", "<s>", "<0x0A>", "ing", "\x00", " " * 9, "ß", "e\u0301", "1"]
    for _ in range(1500):
        t = "".join(rnd.choices(bits, k=rnd.randrange(10)))
        ids = lib.encode(t, add_eos=True)
        assert own.encode(t) == ids and own.packed(t)[1] == own.decode(ids) == lib.decode(ids)
    for r in pieces.encode_pieces(docs(spark), model).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_eos=True)
        assert r.ids == ids and r.decoded == lib.decode(ids)


def test_surrogates(spark):
    texts = [None, "", "Mail Bob.Lee@x.example.com or bob.lee@X.example.com", "call +1 (743) 555-3824, 743-555-3824", "1.2.3.4 and 999.1.1.1", "card 4111 1111 1111 1111", 'token = "' + "0af3" * 10 + '"', "Mr John Smith and Mrs Smith", "plain text only"]
    got = {r.doc_id: r for r in pii.replace_entities(docs(spark, texts), b"k").collect()}
    assert [got[i].n_entities for i in range(9)] == [0, 0, 2, 2, 1, 1, 1, 2, 0] and got[0].text is None and got[8].text == texts[8]
    a, b = re.findall(r"\S+@\S+", got[2].text)
    assert a.lower() == b.lower() and a != b and "lee" not in got[2].text.lower()
    p = [re.sub(r"\D", "", x)[-10:] for x in re.findall(r"[+\d][\d ()-]{8,}\d", got[3].text)]
    assert p[0] == p[1] != "7435553824" and got[3].text.startswith("call +1 (")
    d = re.sub(r"\D", "", got[5].text)
    assert len(d) == 16 and pii.luhn_digit(d[:-1]) == int(d[-1]) and re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4}", got[5].text)
    assert got[7].text.split()[2] == got[7].text.split()[-1] != "Smith" and got[7].text.split()[1] in pii.MALE
    assert all(got[r].text[e.start : e.stop] for r in got for e in got[r].entities)
    assert pii.replace_entities(docs(spark, []), b"k").count() == 0


def test_surrogates_are_distinct_and_leave_the_corpus(spark):
    s = pii.Surrogates(b"k")
    assert len({s.permuted("card", f"{i:013d}") for i in range(3000)}) == 3000
    # nearly all of a small domain is taken: whoever hits a taken number walks on, and the map stays one-to-one
    domain = [f"{a}.{b}" for a in "ab" for b in range(10)]
    ents = spark.createDataFrame([("secret", x) for x in domain[:14]], "kind string, entity string")
    moved = {r.entity: r.surrogate for r in pii.surrogate_steps(ents, b"k").collect()}
    final = {x: moved.get(x) or s.permuted("secret", x) for x in domain[:14]}
    assert len({v for v in final.values() if v != "[secret]"}) == sum(v != "[secret]" for v in final.values())
    assert not set(final.values()) & set(domain[:14])


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy this now.</div>
<article><h1>One &amp; two</h1><p><b>First  part<br>goes on.<p>Second &lt;part&gt;.<aside>See also</aside><form>Name <input></form></article><footer>&copy; Us</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>"), (5, "u", PAGE * 1)] + [(10 + i, "u", PAGE.replace("First", f"F{i}")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = html.train(df)
    got = {r.page_id: r.text for r in html.extract(df, model).collect()}
    assert got[1] == "One & two\nFirst part goes on.\nSecond <part>." and got[2] == got[3] == got[4] == ""
    nodes = html.parse(PAGE)[:9]  # small enough to sum over all labellings
    own = [sum(model.weights.get(f, 0) for f in x) for x in html.features(nodes)]
    weight = {}
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        weight[bits] = math.exp(sum(u for u, b in zip(own, y) if b) + sum(model.edge[y[n.parent]][y[i]] for i, n in enumerate(nodes) if n.parent >= 0))
    for i, p in enumerate(model.marginals(nodes)):
        assert p == pytest.approx(sum(w for b, w in weight.items() if b >> i & 1) / sum(weight.values()), abs=1e-6)


def test_urls(spark):
    urls = [None, "", "nothing", "http://A.COM", "http://a.com/x?q", "https://example.com/en/1", "https://www.example.com/en/1#t", "x://b.net/es/", "x://b.net/es", "http://net/fr/9", "http://notexample.com/en/", "ftp://h.org/a://b"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://s.org/{'bad' if i % 2 else 'good'}/{i}/page") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("shape", F.lit(1))
    got = {r.page_id: r for r in url_filters.judge_urls(df, url_filters.RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(12)] == [("", "", None)] * 3 + [("a.com", "", None), ("a.com", "/x", "com/"), ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("b.net", "/es/", "net/es/"), ("b.net", "/es", None), ("net", "/fr/9", "net/fr/"), ("notexample.com", "/en/", "com/"), ("h.org", "/a://b", None)]
    assert got[5].verdict == "block" and got[6].verdict == "allow" and got[8].verdict == "allow"
    known = F.when(F.col("page_id") >= 140, None).when(F.col("url").contains("bad"), True).when(F.col("page_id") >= 100, False)
    got = {r.page_id: r for r in url_filters.judge_urls(df, [], label=known).collect()}
    assert all(got[100 + i].verdict == ("block" if i % 2 else "allow") for i in range(60)) and got[101].template == "/bad/{n}/page"
    assert url_filters.judge_urls(df.limit(0), url_filters.RULES).count() == 0
