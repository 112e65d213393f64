"""Hidden elements that close themselves."""

import pytest

from tabweave.llm.html_text import page_text


@pytest.mark.parametrize("tag", ["<svg/>", "<svg />", "<SVG a='b'/>", '<svg a="b c" d />', "<svg a=b />"])
def test_an_svg_that_closes_itself(tag):
    assert page_text(f"<title>t</title>x {tag}y <a href=l>z</a>") == ("x y z", "t", ["l"])


def test_an_open_svg_still_hides():
    assert page_text("x <svg a='b/'>no</svg>y <svg a=b/>no</svg>z") == ("x y z", "", [])
