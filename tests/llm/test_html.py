"""Main text against a plain version of the line-block distribution, and without any marks on the given pages."""

import html
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyspark.llm import html_text
from tallyspark.llm.html_text import main_text

LONG = "A sentence of the article that is long enough to surge by itself, whatever stands beside it on the page."


class Plain(HTMLParser):
    """Text lines (text, characters outside links, path of boxes) of a well-formed page of div, p, a, nav and b."""

    def __init__(self):
        super().__init__()
        self.path, self.lines, self.parts, self.out, self.link, self.count = [], [], [], 0, 0, 0

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            box = [n for n, has in [p for p in self.path if isinstance(p, list)] if has]
            if not self.lines or self.lines[-1][2] != box:
                self.lines += [("", 0, None)] * 3
            self.lines.append((text, 0 if self.link >= 0.8 * len(text) else len(text) - self.link, box))
        self.parts, self.link = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("div", "p", "nav"):
            for p in self.path[::-1]:
                if isinstance(p, list):
                    p[1] = True
                    break
            self.end_line()
        self.count += 1
        self.path.append([self.count, False] if tag in ("div", "nav") else tag)

    def handle_endtag(self, tag):
        if tag in ("div", "p"):
            self.end_line()
        if tag == "nav":
            self.parts, self.link = [], 0
            self.lines += [("", 0, None)] * 3
        self.path.pop()

    def handle_data(self, data):
        self.parts.append(data)
        self.link += len(data) if "a" in self.path else 0


def plain_text(page):
    parser = Plain()
    parser.feed(re.sub(r"<nav>.*?</nav>", "<nav></nav>", page))
    parser.end_line()
    lines = parser.lines
    stretches, now, empty = [], [], 0
    for k, (_, weight, _) in enumerate(lines):
        if weight:
            now = [*(now or []), *range(now[-1] + 1 if now else k, k + 1)]
            empty = 0
        else:
            empty += 1
            if empty == 3 and now:
                stretches.append(now)
                now = []
    stretches += [now] if now else []
    most = [max(sum(w for _, w, _ in lines[i : i + 3]) for i in s) for s in stretches]
    surged = [k for k, m in enumerate(most) if m > 86]
    if not surged and stretches:
        total = [sum(lines[i][1] for i in s) for s in stretches]
        surged = [total.index(max(total))]
    homes = [lines[i][2] for k in surged for i in stretches[k] if lines[i][0]]
    keep = set(surged) | {k for k, s in enumerate(stretches) if any(lines[i][0] and lines[i][2] in homes for i in s)}
    for p, q in zip(surged, surged[1:], strict=False):
        a, b = lines[stretches[p][-1]][2], lines[stretches[q][0]][2]
        if set(a) & set(b):
            keep |= set(range(p, q))
    return "\n".join(lines[i][0] for k in sorted(keep) for i in stretches[k] if lines[i][0])


def random_page(rng):
    def block(depth):
        kind = rng.integers(0, 7)
        words = " ".join("word" for _ in range(int(rng.choice([1, 4, 9, 25, 60]))))
        if kind < 2 and depth < 4:
            return "<div>" + "".join(block(depth + 1) for _ in range(int(rng.integers(1, 6)))) + "</div>"
        if kind == 2:
            return f"<p><a>{words}</a></p>" * int(rng.integers(1, 5))
        if kind == 3:
            return "<nav><p>menu</p></nav>"
        if kind == 4:
            return f"<div>{words} <a>{words[:20]}</a></div>"
        return f"<p>{words} <b>bold</b></p>"

    return "".join(block(0) for _ in range(int(rng.integers(1, 9))))


def test_distribution_equals_a_plain_version():
    rng = np.random.default_rng(12)
    texts = set()
    for _ in range(1500):
        page = random_page(rng)
        got = main_text(page, marks=False)
        assert got == plain_text(page), page
        texts.add(got)
    assert len(texts) > 500


def all_lines(page, marks):
    return "\n".join(x.text for x in html_text.lines_of(page, marks)[0] if x.text)


def test_article_is_found_without_marks():
    """With article tags and class names taken away the distribution alone decides, and changes most pages."""
    pages = [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()]
    right = changed = 0
    for page in pages:
        want = main_text(page)
        inside = re.search(r"<article>(.*)</article>", page, re.S)
        assert inside and want == all_lines(inside[1], False)
        bare = re.sub(r"<(/?)article\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))
        got = main_text(bare, marks=False)
        right += got == want
        changed += got != all_lines(bare, False)
    assert right >= 0.95 * len(pages) and changed >= 0.9 * len(pages), (right, changed, len(pages))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>{LONG}</p><nav><a>x</a></nav><p>Short end.</p>", f"{LONG}\nShort end."),
        (f"<body><div><a>Home</a> <a>News</a></div><div><h1>T</h1><p>{LONG}</p><div class='ad'>Buy</div><p>End.</p></div><div>(c) us</div></body>", f"T\n{LONG}\nEnd."),
        (f"<div><div><p>{LONG}</p></div><div><h2>Part</h2><p>x</p></div><div><p>{LONG}</p></div></div>", f"{LONG}\nPart\nx\n{LONG}"),
        (f"<p>{LONG}</p><p><a>A line that is a link alone</a></p><p>{LONG}</p>", f"{LONG}\nA line that is a link alone\n{LONG}"),
        ("<div><p>Short</p></div><div><p>Less short</p></div>", "Less short"),
        (f"<article><p>One</p><aside>{LONG}</aside><p>Two</p></article><p>{LONG}</p>", "One\nTwo"),
        (f"<div>{LONG}</div><section id='comments'><p>{LONG}</p></section>", LONG),
    ],
)
def test_pages(page, want):
    assert main_text(page) == html.unescape(want)


def test_time_is_linear_in_unmatched_tags():
    for page in ("<div>" * 20000 + "</p>" * 20000, "<b>" * 20000 + "<div></div>" * 20000, "<li>" * 20000, "<p><b>" * 20000, "x" * 2_000_000, "<" * 200_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 8


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
