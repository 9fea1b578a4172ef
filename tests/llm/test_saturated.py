"""Entities whose shape is used up get distinct surrogates of their kind, gender and format."""

import re

from courtside.llm import pii


def test_all_first_names_and_short_surnames(spark, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 3)
    short = [f"{a}{b}e".capitalize() for a in pii.CONSONANTS[:12] for b in pii.VOWELS]
    names = [*pii.MALE, *pii.FEMALE, *short]
    texts = [f"Mr {n}" for n in names] + [f"then Mr {n} left" for n in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(docs, b"k").collect()}
    new = [re.fullmatch(r"Mr ([\w-]+)", got[i].text)[1] for i in range(len(names))]
    assert [re.fullmatch(r"then Mr ([\w-]+) left", got[len(names) + i].text)[1] for i in range(len(names))] == new
    assert len(set(new)) == len(names) and not set(new) & set(names) and not any("[" in r.text for r in got.values())
    assert all(set(x.split("-")) <= set(pii.MALE) for x in new[:25]) and all(set(x.split("-")) <= set(pii.FEMALE) for x in new[25:50])
    assert all(re.fullmatch("[A-Z][a-z]+", x) for x in new[50:])
    assert all(r.text[e.start : e.stop] in new for r in got.values() for e in r.entities)


def test_longer_forms():
    s = pii.Surrogates(b"k")
    for kind, entity, like in (("email", "a@b.co", r"[a-z]{4}@[a-z]\.co"), ("phone", "12345", r"[1-9]\d{7}"), ("secret", "0f" * 20, r"[0-9a-f]{43}"), ("secret", "AB_CD-12", r"[A-Z]{2}_[A-Z]{2}-\d\d[A-Z]{3}"), ("name", "Ζωη", "[Α-Ωα-ω]{6}"), ("name", "Иван", "[а-яА-Я]{7}"), ("name", "John Lee", r"[A-Z][a-z]+ [A-Z][a-z]{4}e")):
        assert re.fullmatch(like, s.longer(kind, entity, 3)), (kind, s.longer(kind, entity, 3))
    assert len({s.longer("phone", f"{i:05d}", 1) for i in range(100000)}) == 100000
    assert s.replaced("phone", "+1 22 33", "8712345") == "+871 23 45"
    assert s.replaced("phone", "+1 (743) 555-3824", "87" + "1234567890") == "+1 (87123) 456-7890"
    assert s.replaced("phone", "+1 (743) 555-3824", "1234567890") == "+1 (123) 456-7890"


def test_letters_without_an_alphabet_do_not_stay(spark, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 2)
    docs = spark.createDataFrame([(1, "Mr Ðð and key=________ and _@-.co")], "doc_id long, text string")
    (row,) = pii.replace_entities(docs, b"k").collect()
    assert re.fullmatch(r"Mr [A-Z][a-z]{23} and key=[a-z]{24} and [a-z]{24}@[a-z]{24}\.co", row.text), row.text
