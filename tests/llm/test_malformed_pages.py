"""Pages of a megabyte that are all malformed tags: time linear in the page, and what they hold is kept."""

import time

import pytest

from sonolith.llm.extraction import default_model, main_texts
from sonolith.llm.html_tree import decode, parse

MB = 1_000_000
TEXT = "A sentence of the article that is long enough to be read as running text, with commas, and a full stop. " * 3


@pytest.mark.parametrize(
    "unit",
    ["<a ", '<a "<b ', "<a", "<div>x", "<div>x</b>", "</p>", "<li>z", "<i><p>", "<td>", "<svg>", "</", "<x y=\"", "\"'<q ", "<d a='>", "<!", "&#1"],
)
def test_unit_repeated_to_a_megabyte(unit):
    model = default_model()
    start = time.process_time()
    assert len(main_texts([unit * (MB // len(unit))], model)) == 1
    assert time.process_time() - start < 60  # the quadratic reader needs hours


@pytest.mark.parametrize("tag", ["<p " + "a" * MB + ">", "<p " + "a " * (MB // 2) + ">", "<p " + 'x="' * (MB // 3), "<p " + "'x=\"' " * (MB // 6) + ">"])
def test_one_tag_of_a_megabyte(tag):
    start = time.process_time()
    parse(tag)
    assert time.process_time() - start < 20


def test_a_tag_that_never_ends_is_text_and_the_article_stays():
    page = f"<html><body><article><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></article></body></html>"
    whole = main_texts([page], default_model())[0]
    assert TEXT.strip() in whole
    assert main_texts([page + "<a " * 1000], default_model())[0].startswith(whole)
    assert [n.text for n in parse("<p>x <a y='z</p><b>q</b>") if n.tag == "#text"] == ["x <a y='z", "q"]


def test_long_character_references():
    assert decode("&#" + "1" * MB + ";x") == "�x"
    assert decode("&#" + "0" * 5000 + "65;&#66;&amp;") == "AB&"
    assert decode("&#" + "0" * 5000) == "�"
