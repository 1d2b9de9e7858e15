"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and how much text a window needs where nothing else marks the article.
WINDOW = 3
SURGE_CHARS = 86
#: A line weighs nothing from this share of it in links.
LINK_SHARE = 0.8

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br del".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object svg canvas select button dialog menu title textarea audio video xmp noembed noframes head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl pre blockquote figure figcaption table caption thead tbody tfoot tr td th address hr option".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_HINT = re.compile(
    r"(?:(?:site|page|main|top|global|left|right|cookie|user|reader|post|article)[-_])?"
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|side-?bar|footer|masthead|cookies?|consent|gdpr|notices?|banner|alert|pop-?up|modal|overlay|newsletter|subscribe|signup|ads?|advert|adverts|advertisement|adsense|sponsor|sponsored|promo|promotion|comments?|disqus|respond|replies|share|sharing|social|related|recommended|pagination|pager|skip-?link|toolbar|login)"
    r"(?:[-_](?:bar|box|list|links?|menu|section|area|container|wrapper|wrap|block|unit|slot|form|thread|item|body|banner|notice|message|text|top|bottom|left|right|inner|[0-9]+))*"
    r"|(?:site|page|main|top|global)[-_]header|header"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[A-Za-z][^\s/>]*+(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def attributes(tag: str) -> dict[str, str]:
    at = re.match(r"<[^\s/>]+", tag)
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(tag, at.end() if at else 1)}


@dataclass(frozen=True)
class Line:
    """Text of a block, how much of it isn't in links, the box that holds it, and whether that lies in a marked article; gaps are empty."""

    text: str
    weight: int
    box: int
    inside: bool


GAP = [Line("", 0, 0, False)] * WINDOW


@dataclass
class Open:
    """An open element; ``box`` is its number if it can hold blocks, else 0."""

    name: str
    dropped: bool
    article: bool
    box: int
    has_blocks: bool = False


def lines_of(page: str, marks: bool = True) -> tuple[list[Line], list[int]]:
    """Lines with markup stripped, and for each box the box around it; box 0 is the page.

    A block element ends a line. Its box is the nearest element around it that holds blocks, so text
    right in an element without blocks counts as a paragraph of the element around. Where the box
    changes, and where dropped elements stood, there is a gap of WINDOW empty lines. Without
    ``marks``, articles and what names and roles say are passed over.
    """
    out: list[Line] = []
    around = [0]
    parts: list[str] = []
    linked = 0
    stack: list[Open] = []
    boxes: list[Open] = []  # those of the stack that have a box; all but the last hold blocks
    open_names: Counter[str] = Counter()
    dropped = articles = links = 0
    last_box = 0

    def flush() -> None:
        nonlocal linked, last_box
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                box = next((o.box for o in reversed(boxes) if o.has_blocks), 0)
                if box != last_box:
                    out.extend(GAP)
                    last_box = box
                out.append(Line(text, 0 if linked >= LINK_SHARE * len(text) else len(text) - linked, box, articles > 0))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, articles, links
        top = stack.pop()
        open_names[top.name] -= 1
        if top.box:
            boxes.pop()
        links -= top.name == "a"
        if top.dropped:
            dropped -= 1
            if not dropped:
                out.extend(GAP)
        if top.article:
            flush()
            articles -= 1
            out.extend(GAP)

    def close(names: tuple[str, ...], until: Callable[[str], bool]) -> None:
        """Close the innermost open element of these names unless another one that ends the search is further in."""
        if any(open_names[n] for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in names:
                    while len(stack) > k:
                        pop()
                    break
                if until(stack[k].name):
                    break

    i, n = 0, len(page)
    tags_end = page.rfind(">")
    while i < n:
        if i > tags_end and page[i : i + 4] != "<!--":  # no tag can end here any more
            token, i = page[i:], n
            if (cut := token.find("<!--")) >= 0:
                token = token[:cut]
            if not dropped:
                parts.append(token)
            continue
        m = _TOKEN.match(page, i)
        token = m[0]
        i = m.end()
        if token[0] != "<" or len(token) == 1 or not (token[1].isalpha() or token[1] in "/!?"):
            if not dropped:
                parts.append(token)
                if links:
                    linked += len(token)
            continue
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        name = re.match(r"[^\s/>]*", token[2:] if closing else token[1:])[0].lower()
        block = name not in INLINE
        if name == "br" and not dropped:
            parts.append(" ")
        if closing:
            if block and not dropped:
                flush()
            close((name,), lambda _: False)
            continue
        if block:
            if boxes and name not in VOID:
                boxes[-1].has_blocks = True
            if not dropped:
                flush()
        if name in ENDS_P:
            close(("p",), lambda x: x not in INLINE)
        if name in ITEMS:
            close(("dt", "dd") if name in ("dt", "dd") else (name,), lambda x: x in ITEMS[name])  # noqa: B023
        if name == "body":
            close(("head",), lambda _: False)
        if name in VOID:
            continue
        a = attributes(token) if marks and (" " in token or "\n" in token or "\t" in token) else {}
        role = a.get("role", "").lower()
        words = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
        own = marks and (name in ("article", "main") or role == "main" or a.get("itemprop", "").lower() == "articlebody")
        hinted = role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or any(_HINT.fullmatch(w) for w in words)
        gone = name in DROPPED and not (name == "header" and articles) or (hinted and name not in ("html", "body", "main") and not (name == "article" and not any("comment" in w for w in words)))
        if token.endswith("/>") and name not in RAW:
            continue
        if name in RAW:  # its content is text up to its own end tag
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, i)
            i = end.end() if end else n
            continue
        if gone:
            if not dropped:
                flush()
            dropped += 1
        own = own and not dropped
        if own:
            flush()
            out.extend(GAP)
            articles += 1
        links += name == "a"
        box = 0
        if block and name not in PARAGRAPHS and name not in ("html", "body"):
            around.append(boxes[-1].box if boxes else 0)
            box = len(around) - 1
        stack.append(Open(name, gone, own, box))
        if box:
            boxes.append(stack[-1])
        open_names[name] += 1
    flush()
    return out, around


def surges(weights: list[int]) -> list[tuple[int, int, int]]:
    """Stretches of the line-block distribution: first line, line after the last, and the largest window.

    The distribution is the sum of weights over each WINDOW lines. A stretch begins at a line with
    weight and dives where a window is empty.
    """
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    out = []
    i = 0
    while i < len(weights):
        if not weights[i]:
            i += 1
            continue
        j = last = i
        while j < len(weights) and sums[j]:
            last = j if weights[j] else last
            j += 1
        out.append((i, last + 1, max(sums[i:j])))
        i = j
    return out


def common_box(a: int, b: int, around: list[int]) -> int:
    """The innermost box around both; a box has a larger number than those around it."""
    while a != b:
        a, b = max(a, b), min(a, b)
        a = around[a]
    return a


def main_text(page: str | None, marks: bool = True) -> str:
    """Text between the surge and dive points of a page's line-block distribution.

    A stretch that holds more text than SURGE_CHARS outside of links in some window stays, with all
    lines between its first and its last one that aren't links alone. What is shorter stays if it
    shares its box with one of those, or lies between two of them in a box of the page: a closing
    line after an advert belongs to its article. Where no window surges, the longest stretch stays.
    If the page marks an article that has text, lines outside it are dropped and links and short lines
    inside count in full.
    """
    lines, around = lines_of(page or "", marks)
    marked = any(x.inside for x in lines)
    weights = [len(x.text) if marked and x.inside else 0 if marked else x.weight for x in lines]
    stretches = surges(weights)
    chosen = [k for k, (_, _, most) in enumerate(stretches) if most > (0 if marked else SURGE_CHARS)]
    if not chosen and stretches:
        chosen = [max(range(len(stretches)), key=lambda k: sum(weights[stretches[k][0] : stretches[k][1]]))]

    def boxes(k: int) -> set[int]:
        a, b, _ = stretches[k]
        return {x.box for x in lines[a:b] if x.text}

    kept = set(chosen)
    homes = set().union(*map(boxes, chosen)) if chosen else set()
    kept.update(k for k in range(len(stretches)) if homes & boxes(k))
    for p, q in zip(chosen, chosen[1:], strict=False):
        if common_box(lines[stretches[p][1] - 1].box, lines[stretches[q][0]].box, around):
            kept.update(range(p, q))
    return "\n".join(x.text for k in sorted(kept) for x in lines[stretches[k][0] : stretches[k][1]] if x.text and (x.inside or not marked))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; a null page is an empty one, ids and urls stay as they are."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
