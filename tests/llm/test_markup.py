"""Text beside and inside elements that aren't raw text, and pages that leave them open."""

import time

import pytest
from courtside.llm import html_extraction as html

TEXT = "The first sentence of the story is here. It goes on for a while, with more to say."
AFTER = "The second paragraph follows. It also has enough words, and a full stop."
WORDS = " ".join(f"pad-{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(20))


def texts(page):
    return [html.block_text(n) for n in html.parse(page) if n.tag == "#text" and html.block_text(n)]


@pytest.mark.parametrize("odd", ["<svg viewBox='0 0 1 1'/>", "<math/>", "<object data='x'>", "<svg><path d='M0'>", "<math>", "<select><option>", "<noscript>", "<svg><title/><style/><path/></svg>", "<svg/><svg><path d=1 /></svg>"])
def test_nothing_after_the_tag_is_lost(odd):
    got = texts(f"<body><article><p>{TEXT}</p>{odd}<p>{AFTER}</p></article><div><svg></svg>end</div></body>")
    assert got == [TEXT, AFTER, "end"]


def test_text_inside_belongs_to_the_text_around():
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><text>drawn</text></svg> so.</p>") == ["Let x=2 be drawn so."]
    assert texts("<p>See</p><object><p>the fallback</p></object><p>here</p>") == ["See", "the fallback", "here"]


def test_what_browsers_do_not_show():
    assert texts("<p>a</p><script>'<p>b'</script ><style>c</style\n><iframe>d</iframe><noscript>e</noscript><textarea>f</textarea><p>g</p>") == ["a", "g"]
    assert texts("<div>a<template><div>b<template>c</template>d</div></div>e</template>f</div>") == ["a", "f"]
    assert texts("<p>a<svg><title>icon</title></svg>b</p>") == ["ab"]


def test_all_names_of_a_node_count():
    node = html.parse(f"<div class='{WORDS} comments'>x</div>")[1]
    assert len(node.names) == 41 and "name=comments" in html.features(html.parse(f"<div class='{WORDS} comments'>x</div>"))[2]


def test_extracted_pages():
    pages = [html.parse(x) for x in html.generated()]
    model = html.fit([(html.features(x), html.labels(x), [n.parent for n in x]) for x in pages])
    for odd in ("<svg/>", "<object>", "<select><option>", "<math>"):
        page = f"<body><nav><ul><li><a href='#'>Home</a></li></ul></nav><article><h1>A title</h1><p>{TEXT}</p>{odd}<p>{AFTER}</p></article><footer>&copy; Us</footer></body>"
        assert model.extract(page) == f"A title\n{TEXT}\n{AFTER}"
    assert "Choice" not in model.extract(f"<body><article><p>{TEXT}</p><form><select><option>Choice</select></form><p>{AFTER}</p></article></body>")


@pytest.mark.parametrize("page", ["<div>" * 60000 + "</p>" * 60000, "<a '" * 250000, '<p x="' * 170000, "<!" * 500000, "<noscript>" + "</noscript " * 80000, "<x " + "a" * 1000000 + ">", "<svg " + "=a" * 300000 + " /", "<center>" * 30000 + "<li></li>" * 30000, "<optgroup>" * 30000 + "<div></div>" * 30000, "<" * 500000, f"<div class='{' n' * 50000}'>" + "<p>t</p>" * 30000])
def test_hostile_pages_take_time_in_proportion(page):
    start = time.process_time()
    html.TreeModel({"bias": 0.1}, ((0.0, 0.0), (0.0, 0.0))).extract(page)
    assert time.process_time() - start < 8


def test_attributes_and_ends_as_browsers_read_them():
    assert texts("<p class=a/>x</p><p title='>'>y</p><p a='1'b=\"2\">z</p><p '>w</p>") == ["x", "y", "z", "w"]
    assert texts("a < b <3 c<!-- > --> d<!--> e <? x ?>f") == ["a < b <3 c d e f"]
    assert texts("<p>a <input value='b'> c <img src=d> e<hr>f</p>") == ["a c e", "f"] and texts("<p>kept <a href='cut") == ["kept"]


def fitted():
    pages = [html.parse(x) for x in html.generated()]
    return html.fit([(html.features(x), html.labels(x), [n.parent for n in x]) for x in pages])


def test_pages_without_an_article():
    """Names, places and texts that no training page has."""
    model = fitted()
    other = "Rivers rose after the storm. Crews worked all night, and roads stayed shut until noon. Nobody was hurt."
    side = "<div class='right-rail widget'><h3>Most read</h3><ul><li><a href='#'>A link</a></li><li><a href='#'>A second link</a></li></ul></div>"
    menu = "<div class='site-menu'><a href='#'>News</a> <a href='#'>Sport</a></div>"
    foot = "<div class='page-footer'>&copy; The paper. <a href='#'>Terms</a></div>"
    body = f"<h1>Rivers rise</h1><p>{TEXT}</p><p>{other}</p>"
    want = f"Rivers rise\n{TEXT}\n{other}"
    for host in ("<div id='story-text'>", "<main>", "<div class='entry-content'>", "<section>"):
        close = f"</{host[1:].split()[0].rstrip('>')}>"
        assert model.extract(f"<body>{menu}{host}{body}{close}{side}{foot}</body>") == want, host
        assert model.extract(f"<body>{menu}{host}{body}{side}<p>{AFTER}</p>{close}{foot}</body>") == f"{want}\n{AFTER}", host
        split = f"<body>{menu}{host}{body}{close}{side}{host}<p>{AFTER}</p>{close}{foot}</body>"
        assert model.extract(split) == f"{want}\n{AFTER}", host


def test_corner_cases(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<article><p>" + (TEXT + " ") * 3000 + "</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = html.train(pages)
    got = sorted((r.page_id or 0, r.url, len(r.text)) for r in html.extract(pages, model, keep=("url", "text")).collect())
    assert got == [(0, "v", 3000 * (len(TEXT) + 1) - 1), (1, "u", 0), (1, "u", 0), (2, None, 0)]
    assert html.extract(pages.limit(0), html.train(pages.limit(0))).columns == ["page_id", "url", "text"]
