"""Markup that hides nothing, pages of broken markup, Viterbi against all label sequences, and odd tables."""

import html.parser
import itertools
import random
import time

import numpy as np
import pytest

from pulsegrid.llm import html_text


def texts(page):
    return [b[0] for b in html_text.leaf_blocks(page)]


@pytest.mark.parametrize("piece", [
    '<svg class="icon" viewBox="0 0 1 1"/>', "<svg />", "<svg><path d='M0'>", "<object data='x'>", "<object>", "<iframe src='x'>", "<noscript>", "<template>", "<svg><svg/></svg>", "<svg><svg></svg></svg>",
    "<svg><svg><text>no</text></svg><text>no</text></svg>", "<iframe>no</iframe>", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", "<!doctype x>", "<?x?>", "<img src='a>b'>",
])
def test_nothing_of_the_page_is_lost(piece):
    page = f"<article><p>one</p>{piece}<p>two</p><p>three {piece} more</p></article><p>last</p>"
    joined = " ".join(texts(page)).split()
    assert joined == ["one", "two", "three", "more", "last"]


def test_fallback_and_unclosed_raw():
    assert texts("<p>a</p><object><p>instead</p></object><p>b</p>") == ["a", "instead", "b"]
    assert texts("<p>a</p><script>x<p>y</p>") == ["a"] and texts("<p>a</p><!-- x<p>y</p>") == ["a"] and texts("<p>a</p><textarea") == ["a"]
    assert texts("a < b and b > a, 3<4") == ["a < b and b > a, 3<4"]
    assert texts('<p title="open>one</p><p>two</p>')[-1] == "two"


@pytest.mark.parametrize("unit", ["<a x=1 ", "a<b ", "<", "</", "<!", "<a '", '<a "', "<a \">\" ", "<svg><svg></svg>", "<svg>", "<script", "<!--", "<b>", "<p><b>x", "<div class='a'>", "<a ' > \" ", "<template></template><svg "])
def test_a_megabyte_of_broken_markup(unit):
    page = "<p>start</p>" + unit * (1_000_000 // len(unit))
    began = time.process_time()
    blocks = html_text.leaf_blocks(page)
    assert blocks[0][0].startswith("start") and time.process_time() - began < 12  # seconds; quadratic ones took hours
    half = time.process_time()
    html_text.leaf_blocks(page[: len(page) // 4])
    assert time.process_time() - began < 12 * (time.process_time() - half) + 1


class Plain(html.parser.HTMLParser):
    """All shown words of a page, by another parser."""

    def __init__(self, page):
        super().__init__()
        self.words, self.hidden = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_words_equal_another_parsers():
    rng = random.Random(2)
    for _ in range(60):
        page, _ = html_text.labelled_page(rng)
        page = page.replace("<br>", " <br> ")
        want = Plain(page).words
        assert "".join("".join(texts(page)).split()) == "".join(want)


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(4)
    names = [f"f{k}" for k in range(6)]
    for _ in range(60):
        field = html_text.Field()
        field.weights = dict(zip(names, rng.normal(size=6).tolist(), strict=True))
        field.moves, field.start = rng.normal(size=(2, 2)), float(rng.normal())
        rows = [list(rng.choice(names, rng.integers(1, 4), replace=False)) for _ in range(rng.integers(1, 9))]
        e = field.emissions(rows)

        def value(labels):
            return labels[0] * field.start + sum(x * y for x, y in zip(labels, e, strict=True)) + sum(field.moves[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=value)
        assert field.viterbi(rows) == list(best)
    assert html_text.Field().viterbi([]) == []


def test_odd_tables(spark):
    field = html_text.train(120)
    page = "<nav><a href='/x'>menu</a></nav><article><h1>Title here</h1>" + "".join(f"<p>Sentence number {k} of the long text ends here.</p>" for k in range(2000)) + "</article>"
    rows = [(1, "u", page, "t", 3), (1, "u", page, "t", 3), (None, None, None, None, None), (2, "v", "", "t", 1), (3, "w", "<nav>x</nav>", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = html_text.extract(df, field).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "3", "None"]
    assert {(r.text, r.n_chars) for r in got if r.page_id == 1} == {(t := html_text.main_text(page, field), len(t))} and "number 1999" in t
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (None, 2))
    assert html_text.extract(df.where("1 = 0"), field).count() == 0
