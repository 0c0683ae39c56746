"""Pages whose wrapper bears a listed word keep their article and lose the parts that are meant."""

import pytest

from simlattice.llm import html

BODY = "<h1>A title of the page</h1><p>{0} first paragraph of the article.</p><p>{0} second paragraph, which ends it.</p>"
ARTICLE = BODY.format("The long and quite detailed")
EXPECTED = "A title of the page\nThe long and quite detailed first paragraph of the article.\nThe long and quite detailed second paragraph, which ends it."
REST = '<div class="comments"><p>{}</p></div><div class="sidebar"><p>Other posts of this week</p></div><form><p>Send us your mail address here</p></form>'


@pytest.mark.parametrize("wrapper", [
    '<form id="aspnetForm">{}</form>', '<div class="layout has-sidebar">{}</div>', '<div class="no-ads">{}</div>', '<div class="site menu-closed">{}</div>',
    '<div class="post share-enabled">{}</div>', '<div class="security-alert-story">{}</div>', '<div class="has-sidebar"><form><section class="no-ads">{}</section></form></div>',
])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_wrapper_keeps_the_article(wrapper, inner):
    for rest in ("", REST.format("I liked it."), '<div class="masthead"><h2>The Daily Site</h2></div>'):
        page = f"<html><body><header><h1>The site</h1></header>{wrapper.format(inner.format(ARTICLE) + rest)}<footer>Imprint</footer></body></html>"
        assert html.extract(page, None) == EXPECTED
    outside = f"<html><body>{wrapper.format(inner.format(ARTICLE))}{REST.format('I liked it.')}</body></html>"
    assert html.extract(outside, None) == EXPECTED


def test_long_comments_stay_out():
    comments = "I have read this with great interest and must say that I do not agree. " * 40
    assert html.extract(f"<body><article>{ARTICLE}</article>{REST.format(comments)}</body>", None) == EXPECTED


def test_nothing_but_a_menu():
    assert html.extract('<nav><p>Home</p></nav><div class="ads"><p></p></div>', None) == ""
    assert html.extract("", None) == ""
