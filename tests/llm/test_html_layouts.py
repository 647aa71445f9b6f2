"""Pages by hand: class names that also say something else, leads beside bodies, deep pages."""

import pytest

from sleuthframe.llm import htmlextract as H

ONE = "The harbour was rebuilt after the storm, and most of the boats came back in the second year."
TWO = "Fishermen say that the new wall keeps the water calm even when the wind turns to the north."
LEAD = "A small town gets its harbour back, three years after the great storm."
MENU = '<div class="nav"><a href="/">Home</a> <a href="/a">News</a> <a href="/b">Sport</a></div>'
SIDE = '<div class="sidebar">Other towns along the coast are still waiting for money.</div>'
PARAGRAPHS = f"<p>{ONE}</p><p>{TWO}</p>"
BOTH = f"{ONE}\n{TWO}"


def text(html, path=None):
    return H.text_of(H.parse(html), path)


NAMES = ["article legal", "post search-engines", "entry related-work", "story hidden-gems", "content header-image", "article-social", "news comment-of-the-day", "story social-policy", "article-sidebar-story", "post-about-cookies", "legal-history", "x-search-results-explained", "page promo-winner", "entry notice-period", "newsletter-archive-text", "paywall-free"]


@pytest.mark.parametrize("names", NAMES)
def test_names_that_say_more(names):
    """Alone, with a menu, and with a short part after it."""
    assert text(f'<body><div class="{names}">{PARAGRAPHS}</div></body>') == BOTH
    assert text(f'<body>{MENU}<div class="{names}">{PARAGRAPHS}</div><div class="footer">All rights reserved.</div></body>') == BOTH
    assert BOTH in text(f'<body><div class="{names}">{PARAGRAPHS}</div><div class="tail">The end.</div></body>')


@pytest.mark.parametrize("names", ["sidebar", "sidebar-left", "site-footer", "cookie-banner", "comments", "comment-list", "ad-slot-12", "related-links", "newsletter-signup", "share-buttons", "promoBox", "nav main"])
def test_plain_names_are_dropped(names):
    part = f'<div class="{names}">Read this too, and write to us what you think of it.</div>'
    assert text(f'<body><div class="story">{PARAGRAPHS}</div>{part}</body>') == BOTH
    assert text(f'<body><article>{PARAGRAPHS}{part}</article></body>') == BOTH


def test_a_remark_that_says_more_is_dropped_beside_an_article():
    assert text(f'<body><div class="story">{PARAGRAPHS}</div><div class="sponsored-by-friends">Buy our new boat shoes today.</div></body>') == BOTH


def test_no_empty_text_where_one_named_element_holds_it_all():
    assert text(f'<body>{MENU}<div class="sidebar">{PARAGRAPHS}</div></body>') == BOTH
    assert text(f'<body>{MENU}<div class="cookie-notice">We use cookies.</div></body>') == ""
    assert text(f'<body><nav>{PARAGRAPHS}</nav><footer>{ONE}</footer></body>') == ""


@pytest.mark.parametrize("page", [
    f'<div class="article"><div class="lead">{LEAD}</div><div class="body">{PARAGRAPHS * 3}</div></div>',
    f'<main><section>{LEAD}</section><section class="text">{PARAGRAPHS * 3}</section></main>',
    f'<body><div class="lead">{LEAD}</div><div class="body">{PARAGRAPHS * 3}</div></body>',
    f'<body>{MENU}<div class="story"><div class="intro"><p>{LEAD}</p></div><div class="body">{PARAGRAPHS * 3}</div>{SIDE}</div></body>',
])
def test_leads_beside_the_body(page):
    for path in (None, *H.votes(H.parse(page))):
        assert text(page, path) == "\n".join([LEAD] + [BOTH] * 3)


@pytest.mark.parametrize("depth", [1, 100, 505, 508, 509, 510, 511, 512, 513, 600, 3000])
def test_marks_hold_at_any_depth(depth):
    """A sidebar under many elements is none of the article, nor is what stands deeper in it."""
    page = f"<body><article>{PARAGRAPHS}</article>" + "<div>" * depth + f'<div class="sidebar"><div><p>{TWO}</p></div><p>{ONE}</p></div>' + "</div>" * depth + "</body>"
    assert text(page) == BOTH


def test_what_follows_a_deep_mark_is_kept():
    page = "<body>" + "<div>" * 600 + f'<div class="sidebar"><p>Buy boats.</p></div><div class="text">{PARAGRAPHS}</div>' + "</div>" * 600 + "</body>"
    assert text(page) == BOTH
