"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; menus, footers, adverts, forms and the like are marked by their markup and
are gone. The first pass looks at each block's links, length and stop words, and decides what it can: blocks with many
links, or made of the words of notices, are out; long blocks with many stop words are in. That a block stands in an
``article`` or ``main`` is one feature of this: the bars are lower there. In the second pass the others, short ones above all,
inherit the label of their nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nbquarry.llm.common import col

# Share of a block's characters in links beyond which it is out, in an article and elsewhere.
ARTICLE_LINKS, LINKS = 0.5, 0.2
# Blocks below this length are ambiguous; from GOOD_LENGTH on, stop words alone let a block in.
SHORT, GOOD_LENGTH = 70, 200
# Share of stop words: below LOW a block is out, from HIGH on a long one is in. In an article LOW lets a block in, and below it is open.
LOW, HIGH = 0.15, 0.25
# Share of words of notices, and their least number, from which a block that is not long is out.
NOTICE, NOTICE_WORDS = 0.4, 2

# Elements of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
# Elements whose content is no text of the page; one that is not closed is passed over.
HIDDEN = {"noscript", "template", "svg", "math", "object", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Elements, roles and words of a class or id that mark what is not the article.
OUT = {"nav", "footer", "aside", "form", "fieldset", "dialog", "head", "menu"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "copyright", "disqus", "footer", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup",
    "promo", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from had has have he his in is it not of on or she that the their they this to was were which with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nach nicht sich sie sind über um und von war wie "
    "wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qui se son sur un une "
    "al como con del el ella ellos era esta este ha las lo los más no para pero por que se sin su sus también una y".split()
)

# Words of notices, menus and buttons that stand in a page as text.
NOTICE_TEXT = frozenset(
    "advertisement advertisements contact cookie cookies copyright disclaimer facebook follow imprint instagram login logout menu newsletter "
    "pinterest policy print privacy products register search services share shop sitemap subscribe terms tweet twitter whatsapp "
    "abonnieren anmelden datenschutz drucken impressum kontakt teilen abonner contactez imprimer mentions partager compartir contacto imprimir suscribirse".split()
)

_ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARK = re.compile("""["'>]""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TOKEN = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[\s_-]+")


class Block(NamedTuple):
    text: str
    link_chars: int
    out: bool
    article: bool


class _Element(NamedTuple):
    name: str
    out: bool
    article: bool


def _tag_end(page: str, at: int) -> int:
    """The position after the ``>`` that ends a tag; quoted values may contain one."""
    while (mark := _MARK.search(page, at)):
        if mark[0] == ">":
            return mark.end()
        at = mark.end()
        if page[mark.start() - 1] == "=" and (close := page.find(mark[0], at)) >= 0:
            at = close + 1
    return len(page)


def _closed(page: str, tag: str) -> dict[int, int]:
    """Where the elements ``tag`` that are closed begin, and the position after their end."""
    found, open_ = {}, []
    for mark in re.finditer(f"<(/?){tag}(?=[\\s/>])", page, re.I):
        if not mark[1]:
            open_.append(mark.start())
        elif open_:
            found[open_.pop()] = mark.end()
    return found


def _is_out(name: str, attributes: str, article: bool) -> bool:
    if name in OUT or name == "header" and not article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    values = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTES.findall(attributes)}
    if values.get("role") in OUT_ROLES or "hidden" in values or values.get("aria-hidden") == "true":
        return True
    if "display:none" in values.get("style", "").replace(" ", ""):
        return True
    words = set(_SPLIT.split(values.get("class", "") + " " + values.get("id", "")))
    return bool(words & OUT_WORDS) and not words & {"has", "with", "no"}


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with character references decoded and white space collapsed."""
    found: list[Block] = []
    stack: list[_Element] = []
    parts: list[str] = []
    links: list[str] = []
    in_link, at, n = False, 0, len(page)
    closed: dict[str, dict[int, int]] = {}

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(links)).split()))
            out, article = (stack[-1].out, stack[-1].article) if stack else (False, False)
            found.append(Block(text, linked, out, article))
        parts.clear()
        links.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            links.append(text)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if closing or page[start + 1:start + 2] in ("!", "?"):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:  # a plain less-than sign
                add("<")
                at = start + 1
            continue
        at = _tag_end(page, name.end())
        tag = name[0].lower()
        if tag in RAW:
            if not closing and not page.startswith("/>", at - 2):
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = n if end is None else _tag_end(page, end.end())
        elif tag in HIDDEN:
            if tag not in closed:
                closed[tag] = _closed(page, tag)
            if not closing and start in closed[tag]:
                at = _tag_end(page, closed[tag][start])
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            close_block()
            in_link = in_link and not closing
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == tag), None)
                if depth is not None:
                    del stack[depth:]
            elif tag not in VOID:
                while stack and (stack[-1].name == "p" or stack[-1].name == tag and tag in ("li", "dd", "dt", "td", "th", "tr")):
                    stack.pop()
                above = stack[-1] if stack else _Element("", False, False)
                if above.name == "head" and tag == "body":
                    stack.pop()
                    above = _Element("", False, False)
                article = above.article or tag in ("article", "main")
                out = above.out or _is_out(tag, page[name.end():at - 1], above.article)
                stack.append(_Element(tag, out, article))
    close_block()
    return found


def _share(text: str, listed: frozenset[str]) -> tuple[float, int]:
    """Share and number of a text's words that are listed."""
    words = _TOKEN.findall(text.lower())
    n = sum(w in listed for w in words)
    return (n / len(words) if words else 0.0), n


def _first_pass(block: Block) -> bool | None:
    """In, out or (None) ambiguous."""
    size = len(block.text)
    if block.link_chars / size > (ARTICLE_LINKS if block.article else LINKS):
        return False
    notice, n = _share(block.text, NOTICE_TEXT)
    if size < GOOD_LENGTH and notice >= NOTICE and n >= NOTICE_WORDS:
        return False
    if size < SHORT:
        return False if block.link_chars and not block.article else None
    stops, _ = _share(block.text, STOP_WORDS)
    if block.article:
        return True if stops >= LOW else None
    if stops >= HIGH and size >= GOOD_LENGTH:
        return True
    return None if stops >= LOW else False


def main_blocks(page: str | None) -> list[str]:
    """The texts of the blocks that belong to the article."""
    # What the markup itself rules out is gone before neighbours are looked for.
    found = [b for b in blocks(page or "") if not b.out]
    decided = [_first_pass(b) for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if decided[i] is not None else last
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if decided[i] is not None else last
        after[i] = last

    def inherited(i: int) -> bool:
        near = [j for j in (before[i], after[i]) if j is not None]
        if not any(decided[j] for j in near) and found[i].article:
            # No neighbour is in: a block of an article stands for itself.
            near = []
        if not near:
            return found[i].article
        nearest = min(abs(i - j) for j in near)
        # Between two equally near neighbours a block is in if either is.
        return any(decided[j] for j in near if abs(i - j) == nearest)

    return [b.text for i, b in enumerate(found) if (decided[i] if decided[i] is not None else inherited(i))]


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text as ``name`` and its length in code points as ``n_chars``; columns of these names are replaced.

    Blocks are joined by two line breaks. A NULL or empty page, or one without an article, has an empty text. Broken markup
    never fails: what is not closed ends with the page.
    """
    @F.arrow_udf("string")
    def of(values: pa.Array) -> pa.Array:
        return pa.array(["\n\n".join(main_blocks(v.as_py())) for v in values], pa.string())

    return pages.withColumn(name, of(col(html))).withColumn("n_chars", F.length(col(name)).cast("long"))
