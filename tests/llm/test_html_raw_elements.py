import pytest

from spendlens.llm import html_extract


def texts(html):
    return [t for t, _ in html_extract.leaf_blocks(html)]


@pytest.mark.parametrize("between", [
    "<svg-icon></svg-icon>", "<svg/>", "<svg class='a>b' />", "<math/>", "<template-part></template-part>", "<style-guide></style-guide>",
    "<iframe src=x>", "<noscript>", "<svg viewBox='0 0 1 1'>", "<object>", "<svg><title>no</title></svg>", "<IFRAME src=x>no</iframe >",
    "<template><p>no</p></template>", "<noscript><img src=x></noscript>", "<script>'</p>'</script>", "<style media=all>p{}</style>"])
def test_text_after_raw_elements_stays(between):
    assert texts(f"<article><p>one</p>{between}<p>two</p><p>three</p></article>") == ["one", "two", "three"]


def test_text_of_math_and_object_is_left_to_the_chain():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert texts("<object data=a.swf><p>read this instead</p></object><p>b") == ["read this instead", "b"]


def test_self_closing_svg_before_a_whole_one():
    assert texts("<p>a<svg/>b</p><p>c</p><svg><text>no</text></svg><p>d</p>") == ["ab", "c", "d"]


def test_script_without_an_end_goes_on_to_the_end():
    assert texts("<p>a</p><script>var x = '<p>b</p>'") == ["a"]


def test_many_raw_elements_without_an_end():
    assert len(texts("<iframe src=x><p>a</p>" * 20_000)) == 20_000
