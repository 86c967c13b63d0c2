"""Words in class names that mark no part of a page drop nothing."""

import pytest

from weftline.llm.html_extract import main_text

BODY = ["First paragraph, with commas, and long enough to be the main text of the page.", "Second paragraph, as long, and with commas, too."]
ARTICLE = "".join(f"<p>{b}</p>" for b in BODY)


@pytest.mark.parametrize("attrs", ["class='content with-sidebar'", "id='page' class='no-comments'", "class='layout has-menu'", "class='sidebar'", "class='tags-intro'"])
def test_element_around_the_article_stays(attrs):
    assert main_text(f"<body><div {attrs}>{ARTICLE}</div></body>").split("\n") == BODY


@pytest.mark.parametrize("name", ["entry-header", "tags-intro"])
def test_parts_of_the_article_stay(name):
    assert main_text(f"<body><article><div class='{name}'><p>Opening words</p></div>{ARTICLE}</article></body>").split("\n") == ["Opening words", *BODY]


@pytest.mark.parametrize("name", ["sidebar", "ad", "ad-slot", "left-sidebar", "comment-list", "cookie-notice", "x share"])
def test_marked_parts_go(name):
    assert main_text(f"<body><article>{ARTICLE}<div class='{name}'><p>Buy this, now</p></div></article></body>").split("\n") == BODY
