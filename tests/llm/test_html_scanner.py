"""The page scanner against one regular expression, and its time on broken pages."""

import random
import re
import time

import pytest

from cohortkit.llm import html_extraction as hx

# what tokens_of does, but with a search to the page's end at every broken tag
WHOLE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|noembed|noframes)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|</?[A-Za-z][^>]*>|<[!?][^>]*>|[^<]+|<",
    re.DOTALL | re.IGNORECASE)
PARTS = ["<", ">", "</", "'", '"', "a", " ", "<b>", "</b>", "<a '", '<a "', "<!--", "-->", "<!", "<?x", "<script>", "</SCRIPT >", "<Style a='>'>", "</style>",
         "text", "<p class=\"x>y\">", "\n", "<title", "/>", "=", "<article>", "</article>", "<li>", "é", "<scripty>", "<nav>", "</nav>", "<div>", "</div>"]


def test_tokens_equal_the_expression():
    rnd = random.Random(1)
    for _ in range(6000):
        page = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))
        assert list(hx.tokens_of(page)) == [(m.group(), m.group(1)) for m in WHOLE.finditer(page)], page


@pytest.mark.parametrize("piece", ["<a '", "<x ", "<b></i>", "<a \"'", "<a '\">\"", "<!x", "<script ", "<i>word ", "<nav><article>", "<div", "'\"<a>"])
def test_time_is_linear(piece):
    times = []
    for size in (1_000_000, 4_000_000):
        page = piece * (size // len(piece))
        start = time.process_time()
        hx.extract(page, {})
        times.append(time.process_time() - start)
    assert times[1] < 25 and times[1] < 10 * times[0] + 1
