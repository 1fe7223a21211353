import time

import pytest

from spendlens.llm import html_extract, url_filter
from spendlens.llm.html_scan import next_tag


def texts(html):
    return [t for t, _ in html_extract.leaf_blocks(html)]


@pytest.mark.parametrize("between", ["<!-->", "<!--->", "<!-- a --!>", "<!----!>", "<!-- <p>no</p> -->", "<!---->", "<!doctype x>", "<?php a ?>"])
def test_text_after_comments_stays(between):
    assert texts(f"<p>one</p>{between}<p>two</p>") == ["one", "two"]
    assert url_filter.alias_targets("http://a.org/", f"{between}<link rel=canonical href=/b>") == ["http://a.org/b"]


@pytest.mark.parametrize("html,blocks", [
    ('<p title="x>one', ["one"]), ("<p>it's <b class=a>so</b> isn't", ["it's so isn't"]), ('<p title="a>b">c', ["c"]), ("<p it's>a<p>b", ["a", "b"]),
    ("a < b <c", ["a < b <c"]), ("<p>1 <2 <3>x", ["1 <2 <3>x"]), ("<p>a<!-- b", ["a"]), ("<p>a<! b", ["a<! b"]), ("", []), ("<", ["<"]),
    ("<p title = 'a>b' >c", ["c"]), ("<h1>a<h1>b</p>c", ["a", "b", "c"])])
def test_broken_markup(html, blocks):
    assert texts(html) == blocks


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<script ", "<div>x", "<p>", "<h1>x", "<b>x", "</b>", "<a \">", "<a '\">x", "<a =\"", "<a =' ", "<!", "<li><p>x",
                                   "<iframe>", "<template ", "<template>", "<", "<td x='><p>", "&amp", "<span title=\"x>", "<p><h2>", "<textarea>", "a<br>"])
def test_a_megabyte_of_anything_takes_seconds(piece):
    page = piece * (1_000_000 // len(piece))
    for end in ("", ">", "-->"):
        start = time.process_time()
        html_extract.leaf_blocks(page + end)
        url_filter.alias_targets("http://a.org/", page + end)
        assert time.process_time() - start < 20


def test_tags_cover_the_page_in_order():
    page = "<!doctype html><html><head><title>a</title><style>p{}</style></head><body class='x>y'>t<br/><SCRIPT>'<p>'</script >u</body>"
    at, names = 0, []
    while tag := next_tag(page, at):
        assert at <= tag.start < tag.end <= len(page)
        at = tag.end
        names.append(("/" if tag.closing else "") + tag.name)
    assert names == ["", "html", "head", "title", "/title", "", "/head", "body", "br", "", "/body"]
