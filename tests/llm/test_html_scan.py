"""Tags and attributes of malformed and very long pages."""
import time

import pytest

from ledgerflow.llm import html_mss


@pytest.mark.parametrize("page, want", [
    ("<p>one <a title=it's>x</a> two</p><p>three</p><p>don't</p>", "one x two\n\nthree\n\ndon't"),
    ('<p><a title=" class=ad x">y</a> z</p>', "y z"),
    ('<p><a href="x>one</a> two</p>', "one two"),
    ("<p><a b = \"c>d\" e='f\">'>g</a></p>", "g"),
    ("<p><a href=a=\"b>c</a></p>", "c"),
    ("<p>kept</p><div class=x id='ad'>gone</div><p>too</p>", "kept\n\ntoo"),
    ("<p>kept</p><a href='unfinished at the end", "kept"),
    ("<p>1 < 2 and 3 <4</p>", "1 < 2 and 3 <4"),
])
def test_attributes(page, want):
    assert html_mss.blocks(list(html_mss.pieces(page))) == want


@pytest.mark.parametrize("part", ["<a x ", "<a x='", "<a x='>", "<a x=\">", "class= ", "=", "<a class=", "ad ", "<nav>", "</div>", "<", "<!", "&"])
@pytest.mark.parametrize("start", ["", "<a ", "<nav>", "<nav>" * 100_000])
def test_long_pages_take_linear_time(part, start):
    page = start + part * (1_000_000 // len(part))
    began = time.process_time()
    html_mss.extract(page, {})
    html_mss.blocks(list(html_mss.pieces(page)))
    assert time.process_time() - began < 20
