"""The template of a host decides what its slots are."""

from __future__ import annotations

import pytest

from tabprep.llm import html


@pytest.mark.parametrize("source, text", [
    ('<article><header><h1>Title</h1></header><p>keep one</p><p class="alert">careful text</p><section class="related-work">'
     'earlier</section><p>see <math><mi>x</mi></math> end</p></article><div class="alert">site</div>',
     "Title keep one careful text earlier see x end"),
    ('<div><h1>T</h1><p>first</p><p class="post-content">second</p><p>third</p></div>', "T first second third"),
    ('<article>a<nav>b</nav><form>c</form><script>d</script><p hidden>e</p><p>f</article>', "a f"),
    ('<div class="ad"><article>teaser</article></div><p>text</p>', "text"),
])
def test_words_of_a_pages_own_elements(source, text):
    assert html.main_text(source) == text


def site(k, inside="", extra=""):
    return (f"<body><div class='top'><b>brand</b></div><article><h1>Head {k}</h1><p>body {k}</p>{inside}"
            f"<div class='share'><i>tell</i> <u>friends</u></div></article>{extra}<div class='end'>bye {k}</div></body>")


def test_the_template_decides(spark):
    own, mark = "<p class='share'>my share {}</p>", "<div class='entry'><p>entry {}</p></div>"
    rows = [(k, "http://site.example/a", site(k, own.format(k) if k == 3 else "")) for k in range(20)]
    rows += [(100 + k, "http://plain.example/a", f"<body><em>first</em><p>by {k}</p>{mark.format(k)}<p>last {k}</p></body>") for k in range(20)]
    rows += [(200 + k, "http://mixed.example/a", f"<body><em>first</em><p>by {k}</p>{mark.format(k) if k == 5 else ''}<p>last {k}</p></body>") for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(frame).collect()}
    # furniture of the template inside the article goes, the same words in a page's own element do not
    assert got[4] == "Head 4 body 4" and got[3] == "Head 3 body 3 my share 3"
    # words make an article of the template's element, not of an element that one page has
    assert got[107] == "entry 7" and got[205] == "first by 5 entry 5 last 5" and got[206] == "first by 6 last 6"
