"""Surrogates of many entities: one-to-one, alike wherever an entity stands, of its gender, script, format and kind."""

import random
import re

import pytest
from courtside.llm import pii

SCRIPTS = {"latin": "abcdefghijklmnopqrstuvwxyz", "greek": pii.GREEK, "cyrillic": pii.CYRILLIC}


def people(rnd, n):
    """Names of each script, in every way that a text may give them."""
    out = set()
    while len(out) < n:
        letters = SCRIPTS[rnd.choice(["latin", "latin", "greek", "cyrillic"])]
        out.add("".join(rnd.choices(letters, k=rnd.randrange(3, 9))).capitalize())
    return sorted(x for x in out if x.lower() not in pii._FIRST)


def test_ten_thousand_entities(spark):
    rnd = random.Random(3)
    last = people(rnd, 4000)
    mails = sorted({f"{rnd.choice(last[:50]).lower()}{i}@{rnd.choice(['mail', 'post'])}.example.org" for i in range(2500)})
    phones = sorted({f"({rnd.randrange(200, 1000)}) {rnd.randrange(200, 1000)}-{rnd.randrange(10000):04d}" for _ in range(2500)})
    keys = sorted({"".join(rnd.choices("0123456789abcdef", k=32)) for _ in range(1500)})
    rows, first = [], [*pii.MALE, *pii.FEMALE]
    for i, name in enumerate(last):
        given = first[i % 50]
        rows.append(("name", f"Dr {name} spoke", name, given))
        rows.append(("name", f"then {given} {name} left", name, given))
        rows.append(("name", f"Mrs {name.upper()} too", name, given))
    rows += [("other", f"write to {m} or {m.upper()}", m, None) for m in mails] + [("other", f"call {p} or +1 {p[1:4]}.{p[6:9]}.{p[10:]}", p, None) for p in phones] + [("other", f"api key {k}", k, None) for k in keys]
    docs = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii.replace_entities(docs, b"key").collect()}
    surname, firsts, others = {}, {}, {}
    for i, (kind, text, entity, given) in enumerate(rows):
        if kind == "name":
            like = re.fullmatch(r"(?:Dr (?P<a>\S+) spoke|then (?P<g>\S+) (?P<b>\S+) left|Mrs (?P<c>\S+) too)", got[i])
            assert like, (text, got[i])
            new = like["a"] or like["b"] or like["c"].capitalize()
            assert surname.setdefault(entity, new) == new, text  # one person, one name
            assert not like["c"] or like["c"].isupper()
            if like["g"]:
                assert firsts.setdefault(given, like["g"]) == like["g"]
                assert set(like["g"].split("-")) <= set(pii.MALE if given in pii.MALE else pii.FEMALE)
        else:
            others.setdefault(entity, got[i])
    assert len(surname) == len(last) and len(set(surname.values())) == len(last) and not set(surname.values()) & set(last)
    assert len(set(firsts.values())) == 50 == len(firsts)
    script = lambda w: next((k for k, a in SCRIPTS.items() if set(w.lower().replace("ς", "σ")) <= set(a)), None)
    assert all(script(a) == script(b) and len(a) <= len(b) and pii.folded(a)[-1] == pii.folded(b)[-1] for a, b in surname.items())
    assert len(others) == len(mails) + len(phones) + len(keys) and len(set(others.values())) == len(others)
    for m in mails:
        a, b = re.fullmatch(r"write to (\S+@\S+\.org) or (\S+@\S+\.ORG)", others[m]).groups()
        assert a.upper() == b and a not in mails
    for p in phones:
        a, b = re.fullmatch(r"call (\(\d{3}\) \d{3}-\d{4}) or \+1 (\d{3}\.\d{3}\.\d{4})", others[p]).groups()
        assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and a not in phones
    assert all(re.fullmatch(r"api key [0-9a-f]{32}", others[k]) and k not in others[k] for k in keys)


def test_short_shapes_are_no_constant_shift():
    one = pii.Surrogates(b"one key")
    for kind, words in (("name", pii.MALE), ("name", pii.FEMALE), ("name", list("bcdfg")), ("email", [f"{c}@x.org" for c in "abcdefgh"])):
        new = [one.permuted(kind, w) for w in words]
        assert len(set(new)) == len(words) and not any(a == b for a, b in zip(words, new))
    places = [pii.MALE.index(one.permuted("name", n)) for n in pii.MALE]
    assert len({(b - a) % 25 for a, b in enumerate(places)}) > 5
    assert [pii.Surrogates(b"another").permuted("name", n) for n in pii.MALE] != [pii.MALE[i] for i in places]
    assert one.permuted("name", "JOHN") == one.permuted("name", "John").upper()


@pytest.mark.parametrize("text,kind,entity", [
    ("Mr Ёлкин came", "name", "Ёлкин"), ("Señora Ana María López came", "name", "Ana María López"), ("use sk-proj-Ab12Cd34Ef56Gh78", "secret", "sk-proj-Ab12Cd34Ef56Gh78"),
    ("ghp_0123456789abcdefABCDEF0123456789abcd", "secret", "ghp_0123456789abcdefABCDEF0123456789abcd"), ("at 2001:db8::ff00:42:8329 now", "ip6", "2001:db8::ff00:42:8329"), ("from fe80::1.", "ip6", "fe80::1"),
    ("to " + "a" * 300 + "@example.org.", "email", "a" * 300 + "@example.org"), ("to x@" + "b" * 100 + "." + "c." * 20 + "example.org!", "email", "x@" + "b" * 100 + "." + "c." * 20 + "example.org"), ("Dr B" + "a" * 90 + " here", "name", "B" + "a" * 90),
])
def test_found_whole(text, kind, entity):
    ((start, stop, found, _),) = pii.detected(text)
    assert (found, text[start:stop]) == (kind, entity)
    s = pii.Surrogates(b"k")
    new = s.permuted(kind, pii.normal(kind, entity))
    assert new != entity and not re.search(r"[A-Za-z0-9]{8}", entity) or entity not in new
    if entity.startswith(("sk-", "ghp_")):
        assert new[:4] == entity[:4] or new[:3] == entity[:3]


def test_what_is_no_entity():
    assert pii.detected("At 12:30:45 a::b or ::: and de:ad:be:ef:00:11 with 10:20, v1.2.3.4.5 x@y 999.1.1.1") == []


def test_corner_cases(spark):
    long = "plain words here " * 20000 + "mail a.b@example.org"
    rows = [(1, None, "x", 3), (1, None, "x", 3), (2, "", "x", 3), (None, "Mr Smith", "x", 3), (None, "Mr Smith", "x", 3), (3, long, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, n_entities long")
    got = pii.replace_entities(df, b"k").collect()
    assert sorted((r.doc_id or 0, r.n_entities, -1 if r.text is None else len(r.text)) for r in got) == [(0, 1, 8), (0, 1, 8), (1, 0, -1), (1, 0, -1), (2, 0, 0), (3, 1, len(long))]
    assert len({r.text for r in got if r.doc_id is None}) == 1
    assert sum(r.text is None for r in got) == 2 and next(r for r in got if r.doc_id == 3).text[:-20] == long[:-20] and len(got) == 6
    assert pii.replace_entities(df.limit(0), b"k").count() == 0
