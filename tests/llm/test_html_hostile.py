"""Pages that are broken or built to be slow."""

import time

import pytest

from sleuthframe.llm import htmlextract

from .test_filters import PAGE, TEXT


def text(page):
    found = htmlextract.votes(htmlextract.parse(page))
    return htmlextract.text_of(htmlextract.parse(page), max(found, key=found.get, default=None))


@pytest.mark.parametrize("tag", ["button", "select", "svg", "noscript", "object", "video", "nav", "aside", "dialog"])
def test_unclosed_dropped_elements_lose_no_text(tag):
    dropped = "<p>One." if tag in ("nav", "aside", "dialog") else "<p>One.\nxTwo."
    page = f"<article><p>One.</p><{tag}>x<p>Two.</p></article>"
    got = text(page)
    if tag in ("nav", "aside", "dialog"):
        # Boilerplate up to the end of its parent.
        assert got == "One."
    else:
        assert got == "One.\nx\nTwo.", dropped
    # A closed one of that name further on doesn't reach back.
    assert text(f"<article><p>One.</p><{tag}>a</{tag}><p>Two.</p></article>") == "One.\nTwo."
    if tag not in ("nav", "aside", "dialog"):
        assert text(f"<article><p>One.</p><{tag}>x<p>Two.</p><{tag}>b</{tag}><p>Three.</p></article>") == "One.\nx\nTwo.\nThree."


def test_raw_elements_end_at_their_first_closing_tag():
    assert text("<article><p>One.</p><script>a = '<script>'; b = '</p>'</script ><p>Two.</p><style>p{}</style><textarea><p>t</textarea><p>Three.</p></article>") == "One.\nTwo.\nThree."
    assert text("<article><p>One.</p><script>rest <p>x</p>") == "One."


def test_stray_signs_are_text():
    assert text("<article><p>1 < 2 and 3 <b>> 2</b> <- x <3 a<b </article>") in ("1 < 2 and 3 > 2 <- x <3 a", "1 < 2 and 3 > 2 <- x <3 a<b")
    assert text("<article><p>it's <a href='x>y'>so</a> and <em title=\"a's\">so</em>") == "it's so and so"
    assert text("<article><p>One <b title=\"x>two</b> three.</p><p>Four.</p></article>") == "One two three.\nFour."
    assert text("<p>a<![CDATA[b < c & d]]>e<!-- no --><![CDATA[open <b>f</b>") == "ab < c & def"


HOSTILE = {
    "nested": "<div>" * 50_000 + "<p>deep</p>",
    "nested with classes": "".join(f"<div class='c{chr(97 + i % 26) * (i % 50 + 1)}'>" for i in range(50_000)) + "deep",
    "closing": "<div>" * 50_000 + "</section>" * 50_000 + "<p>deep</p>",
    "closing paragraphs": "<p><td>" + "<b2>" * 50_000 + "</p>" * 50_000 + "deep",
    "open tags": "<a " * 350_000,
    "open tags that end": "<a " * 350_000 + "> deep",
    "tag name": "<" + "a" * 1_000_000,
    "quotes": "<a \"" + "\"<a \">" * 150_000 + "deep",
    "navs": "<nav>" * 100_000 + "deep",
    "buttons": "<button>" * 100_000 + "deep",
    "scripts": "<script></script " * 60_000 + "deep",
    "cdata": "<![CDATA[>" * 100_000 + "deep",
    "comments": "<!--" * 250_000,
    "references": "&" * 500_000 + "&amp;" * 100_000,
    "lists": "<ul><li>" * 30_000 + "deep",
    "cells": "<table><tr><td>" * 20_000 + "deep",
    "classes": "<div class='" + "a1 " * 300_000 + "'>deep</div>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(name):
    began = time.perf_counter()
    got = text(HOSTILE[name])
    took = time.perf_counter() - began
    assert took < 6, took
    if HOSTILE[name].endswith(("deep", "deep</p>")) and name not in ("navs", "scripts"):
        assert got.endswith("deep")


def test_depth_changes_no_page_of_usual_depth():
    page = PAGE.format(cls="entry", comment="x")
    deep = page.replace('<div id="wrap">', '<div id="wrap">' + "<div>" * 300).replace("<footer>", "</div>" * 300 + "<footer>")
    assert text(page) == TEXT and text(deep) == TEXT
