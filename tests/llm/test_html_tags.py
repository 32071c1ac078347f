"""Tags of a page against one regular expression that says what they are, and in time on broken pages."""

import random
import re
import time

import pytest

TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[A-Za-z])[^<]*\Z", re.S)


def tags(page):
    from sealbook.llm.html_text import _Tags

    at, found, t = 0, [], _Tags(page)
    while m := t.after(at):
        found.append(m)
        at = m[1]
    return found


@pytest.mark.parametrize("seed", range(40))
def test_the_same_tags(seed):
    r = random.Random(seed)
    pieces = ["<", ">", "<p", "</p>", "<a b='", "'", '"', " ", "x", "/", "<!--", "-->", "<![CDATA[", "]]>", "<?x", "<!d", "=", "<b c=\"d>\">", "\n", "<p'q", "<1"]
    for _ in range(300):
        page = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert tags(page) == [(m.start(), m.end(), m[1] or "", m[2] or "", m[3] or "") for m in TAGS.finditer(page)], page


@pytest.mark.parametrize("piece", ["<p ", "<a b='", "<a b=\"", "<!--", "<p'", "<", "</script ", "<script>", "<a b='>' ", "<p><a b='", "&#", "<div class='x' "])
def test_a_megabyte_of_a_broken_page(piece):
    from sealbook.llm.html_text import blocks

    page, start = "<article>word " + piece * (1_000_000 // len(piece)), time.perf_counter()
    blocks(page + " end")
    blocks(page + ">")
    assert time.perf_counter() - start < 20
