"""HTML extraction: table ends, selectors, visibility, list numbers, deep lists, and an independent reader of all test pages."""

import os
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from treeloom.llm import html_text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td>a<td>b</table><p>after", "a  b\n\nafter"),
        ("<table><tr><td>a</table>after", "a\n\nafter"),
        ("<table><tr><td>a<tr><th>b</tr>c</table>d", "c\n\na\nb\n\nd"),
        ("<table><tbody><tr><td>a<p>x</tbody><tbody><tr><td>b</table>z", "a\n\nx\nb\n\nz"),
        ("<table><tr><td><table><tr><td>in</table>out<td>b</table>z", "in   b\n\nout\n\nz"),
        ("<style>div .n{display:none}.a.b{display:none}ul>li#x{display:none}p.k{display:none}</style><div><p><i class=n>no</i>yes</p></div><i class=n>out</i><b class='b a'>no</b><b class=a>a</b><ul><li id=x>no<li>l</ul><p class='k j'>no", "yes\n\nouta\n\n- l"),
        ("<style>.n{display:none} div .n{display:block} #i.n{display:none}</style><div><b class=n>yes</b><b class=n id=i>no</b></div><b class=n>no</b>", "yes"),
        ("<style>.h{visibility:hidden}.v{visibility:visible}</style><p class=h>no <b class=v>yes</b> no <i><u style='visibility:visible'>too</u></i></p>", "yestoo"),
        ("<div style='display:none'><b style='visibility:visible'>no</b></div>x", "x"),
        ("<ol><li value=5>a<li>b<li value=x>c</ol>", "5. a\n6. b\n7. c"),
        ("<ol reversed><li>a<li hidden>h<li>b</ol><ol reversed start=9><li>c<li>d</ol>", "2. a\n1. b\n\n9. c\n8. d"),
        ("<style>a:hover{display:none} [x]{display:none}</style><a x>shown</a>", "shown"),
    ],
)
def test_pages(page, want):
    assert html_text.text_of(page) == want


def test_deep_lists_stay_small():
    page = "".join(f"<ul><li>w{i}" for i in range(3000))
    began = time.time()
    text = html_text.text_of(page)
    assert re.findall(r"w\d+", text) == [f"w{i}" for i in range(3000)]
    assert len(text) < 3000 * 60 and time.time() - began < 30


class Reader(HTMLParser):
    """Words that a page shows, by elements and the hidden attribute only."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.VOID:
            return
        style = dict(attrs).get("style") or ""
        self.hidden.append((tag, tag in html_text.UNSEEN or "hidden" in dict(attrs) or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style))))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.hidden):
            while self.hidden.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(h for _, h in self.hidden):
            self.words += re.findall(r"\w+", data)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="the test tables are not there")
def test_words_of_all_pages_by_another_parser(spark):
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = 0
    for page in pages:
        r = Reader()
        r.feed(page)
        marks = Counter(re.findall(r"(?m)^\s*(\d+)\. ", html_text.text_of(page)))
        got = Counter(re.findall(r"\w+", html_text.text_of(page)))
        want = Counter(r.words)
        assert not got - want - marks and not want - got, page[:300]
        same += 1
    assert same == len(pages) > 200
