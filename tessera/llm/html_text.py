"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element is a line, and with it the lines inside navigation, notices, forms and the like. Text lengths are
summed over sliding windows of lines; a window sum that rises over the threshold is a surge point, one that falls back is a dive point,
and the lines between them are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"[>\"']")
#: Contents of these are no markup and no text; they end at their own end tag.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
#: Elements that start and end a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose lines weigh nothing, and words in class, id or role that say the same of any element.
APART = frozenset("nav aside footer form head menu dialog button search".split())
APART_NAMES = re.compile(r"(?<!has)(?<!with)(?<!no)(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebars?|side|aside|footer|banner|ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notices?|gdpr|privacy|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|recommendations|comments?|comment-list|replies|respond|disqus|toolbar|pagination|pager|widget|complementary|contentinfo|alert|masthead|topbar|skip)(?:$|[\s_-])", re.I)
#: The same, of whole names, outside articles; and of articles, which are apart only as comments.
HEADER_NAMES = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global)[_-]?)?header(?:$|\s)", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.I)
#: Weight of a character in an article or main part.
MARKED = 4
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A start tag of the key ends an open element of the value's kind (end tags that HTML lets one leave out).
CLOSES_P = BLOCK - frozenset("body head html td th tr caption tbody thead tfoot option legend".split())


class Tags:
    """The tags of a page one after the other, in time linear in the page however broken it is."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.plain = page, {c: page.rfind(c) for c in ">\"'"}, False

    def end(self, at: int) -> int:
        """Past the first > from ``at`` on that stands in no quotes; a quote that is not closed is a character like others. Once no such > is left,
        tags end at their first >."""
        k = at
        while not self.plain:
            m = STOP.search(self.page, k)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.end()
            else:
                k = m.end() if m.start() >= self.last[m[0]] else self.page.find(m[0], m.end()) + 1
        return self.page.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name or None for what is no element, closing, attributes) of the first tag from ``at`` on."""
        m = OPEN.search(self.page, at)
        if m is None or (not m[1] and m.end() > self.last[">"]):
            return None
        if m[1]:
            stop = self.page.find("-->", m.end())
            return m.start(), stop + 3 if stop >= 0 else len(self.page), None, False, ""
        if m[3] is None:
            return m.start(), self.page.find(">", m.end()) + 1, None, False, ""
        stop = self.end(m.end())
        return m.start(), stop, m[3].lower(), bool(m[2]), self.page[m.end() : stop - 1]


def lines_of(page: str) -> list[tuple[str, bool, bool, bool]]:
    """The page's lines in order: text with references decoded and white space made one space, and whether it stands in a part set apart, in
    an article, and in a main part."""
    out: list[tuple[str, bool, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they or one around them are set apart
    opened: Counter[str] = Counter()  # how many of the open elements have a name
    apart = False

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, apart, opened["article"] > 0, opened["main"] > 0))

    def close(k: int) -> None:
        opened.subtract(x for x, _ in stack[k:])
        del stack[k:]

    tags = Tags(page)
    at, end = 0, len(page)
    while at < end:
        tag = tags.next(at)
        if tag is None:
            text.append(page[at:])
            break
        text.append(page[at : tag[0]])
        _, at, name, closing, attributes = tag
        if name is None:
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            if name == "br":
                text.append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1 if opened[name] > 0 else -1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    close(k)
                    break
        else:
            if name in CLOSES_P or name == "li":
                for k in range(len(stack) - 1, -1, -1):  # a paragraph or list item that is still open ends here
                    if stack[k][0] in ("p", "li") and (stack[k][0] == "p" or name == "li"):
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            inside = stack[-1][1] if stack else False
            names = " ".join(next(filter(None, x), "") for x in NAMES.findall(attributes)) if attributes else ""
            names = HUMP.sub("-", names)
            header = (name == "header" or bool(HEADER_NAMES.search(names))) and not (opened["article"] > 0 or opened["main"] > 0)
            named = COMMENT_NAMES if name in ("article", "main") else APART_NAMES
            now = inside or name in APART or (name not in ("html", "body") and (header or bool(named.search(names))))
            if now != inside:
                flush()
            if not attributes.endswith("/"):
                stack.append((name, now))
                opened[name] += 1
        apart = stack[-1][1] if stack else False
    flush()
    return out


def main_text(page: str | None, window: int = 3, floor: int = 40, share: float = 0.1) -> str:
    """The lines between surge and dive points, joined by newlines.

    Lines set apart are stripped with the markup. A window of ``window`` lines has surged while its text sums to ``floor`` characters, or to
    ``share`` of the page's greatest sum if that is less; a line is kept if a window that holds it has surged. Where the page marks articles
    or a main part that hold most of its text, the windows run within that bound, where a character weighs MARKED times."""
    if not page:
        return ""
    lines, weight = bounded([x for x in lines_of(page) if not x[1]])
    n = [weight * len(line) for line in lines]
    sums = [sum(n[max(0, k) : k + window]) for k in range(1 - window, len(n))]
    need = min(floor, share * max(sums, default=0))
    return "\n".join(line for k, line in enumerate(lines) if max(sums[k : k + window]) >= need)


def bounded(lines: list[tuple[str, bool, bool, bool]]) -> tuple[list[str], int]:
    """The lines and the weight of their characters: those from the first to the last one in an article, or else in a main part, if those marked so hold half of the text at least;
    else all. Comments and articles within parts set apart are not among ``lines``, so they are no bound."""
    total = sum(len(x[0]) for x in lines)
    for kind in (2, 3):
        at = [k for k, x in enumerate(lines) if x[kind]]
        if at and 2 * sum(len(lines[k][0]) for k in at) >= total:
            return [x[0] for x in lines[at[0] : at[-1] + 1]], MARKED
    return [x[0] for x in lines], 1


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; rows are worked one by one, so repeated rows stay and further columns are ignored; an empty
    table gives an empty result. A map over Arrow batches: no shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(work, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
