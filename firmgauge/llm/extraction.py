"""Main text of HTML pages by two passes over text blocks.

A page is cut into blocks at block-level tags. What lies in places that never hold the main text
(head, scripts, menus, headers, footers, sidebars, forms, adverts, comments of readers) is left out
by its tag, role or class; the rest is classified. First pass, from the block alone: many links or a
notice's words make it bad; long running text with enough stop words makes it good; other long text is near-good; short text is
ambiguous. Second pass: an ambiguous block takes the label of the nearest decided blocks before and
after it, where the borders of the article and a heading above good text count as good.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that start and end a block.
BLOCKS = frozenset((
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul").split())
#: Tags whose content is never shown as the main text.
DROPPED = frozenset("head title script style noscript template svg math canvas iframe object audio video map select "
                    "textarea button nav header footer aside form fieldset dialog menu".split())
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that name a part outside the main text.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar|side|footer|foot|"
    r"header|masthead|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|comment\w*|"
    r"disqus|respond|reply|replies|related|recommend\w*|widget|toolbar|pagination|pager|login|search|complementary|"
    r"contentinfo|navigation|skip)(?:$|[\s_-])", re.I)
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An open paragraph isn't closed through these.
WITHIN = frozenset("table td th li div article section main body blockquote".split())
NOTICE = re.compile(r"^©|all rights reserved|cookies|javascript", re.I)
#: Frequent words of running text in four languages.
STOP = frozenset((
    "the of and a to in is that it for as was with be by on not he his but at are this have from or had an they which "
    "you were all their there been has will more if no when so who what "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass "
    "sie nach bei um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
    "le la les de des et un une est que en du pour dans qui par sur au plus pas ce il ne se avec son sont aux ou "
    "el los las y es por con una para del al lo como más pero sus su o este sí porque esta entre cuando muy sin").split())
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class BlockRules:
    short: int = 70            #: fewer characters: ambiguous
    long: int = 200            #: more characters: good if the words allow it
    stop_low: float = 0.10     #: share of stop words of near-good text
    stop_high: float = 0.20    #: share of stop words of good text
    links: float = 0.5         #: share of characters in links from which a block is bad
    reach: int = 4             #: ambiguous blocks between a heading and the good block it belongs to


@dataclass
class Block:
    text: str
    linked: int                #: characters inside links
    heading: bool
    inside: bool               #: within an article or main element


class Blocks(HTMLParser):
    """Collects the blocks of a page that are not in a dropped part."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.open: list[tuple[str, bool]] = []  # tag, starts a dropped part
        self.dropped = self.inside = self.links = self.headings = 0
        self.parts: list[str] = []
        self.linked: list[str] = []

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            linked = SPACE.sub(" ", "".join(self.linked)).strip()
            self.out.append(Block(text, len(linked), self.headings > 0, self.inside > 0))
        self.parts, self.linked = [], []

    def count(self, tag: str, part: bool, by: int) -> None:
        self.dropped += by * part
        self.inside += by * (tag in MAIN)
        self.links += by * (tag == "a")
        self.headings += by * (tag in HEADINGS)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag == "p":  # an open paragraph ends here
            self.shut("p", WITHIN)
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        part = tag in DROPPED or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        if names and tag not in ("body", "html") and (tag not in MAIN or self.inside):
            part = part or bool(ASIDE.search(names))
        self.open.append((tag, part))
        self.count(tag, part, 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash has no meaning

    def shut(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Closes the innermost open ``tag`` with all that it holds; not beyond a tag in ``within``."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, part in self.open[i:]:
                    self.count(name, part, -1)
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.shut(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked.append(data)

    def read(self, page: str) -> list[Block]:
        self.feed(page)
        self.close()
        self.cut()
        return self.out


def first_pass(block: Block, rules: BlockRules) -> str:
    """good, near (good if its surroundings are), plain (long, without running words), short or bad."""
    n = len(block.text)
    if block.linked > rules.links * n:
        return "bad"
    if not block.inside and n < rules.long and NOTICE.search(block.text):
        return "bad"
    if n < rules.short:
        return "short"
    words = block.text.lower().split()
    share = sum(w.strip(".,;:!?()\"'") in STOP for w in words) / len(words)
    if share >= rules.stop_high:
        return "good" if n > rules.long else "near"
    return "near" if share >= rules.stop_low else "plain"


def classify(blocks: list[Block], rules: BlockRules = BlockRules()) -> list[bool]:
    """Which blocks are main text.

    In a page with an article or main element only its blocks can be, and its borders count as
    decided good blocks. In another page without good blocks the next best kind counts as good.
    """
    marked = any(b.inside for b in blocks)
    labels = ["bad" if marked and not b.inside else first_pass(b, rules) for b in blocks]
    best = "good" if marked else next((k for k in ("good", "near", "plain", "short") if k in labels), "good")
    decided: list[bool | None] = [True if k in ("good", best) else False if k == "bad" else None for k in labels]

    def nearest(order: range) -> list[bool]:
        seen, out = marked, [False] * len(blocks)
        for i in order:
            if not (marked and not blocks[i].inside):  # what lies outside the element isn't a neighbour
                seen = seen if decided[i] is None else decided[i]
            out[i] = seen
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    out = []
    for i, (b, k, d) in enumerate(zip(blocks, labels, decided)):
        if d is None and k in ("near", "plain"):
            d = before[i] or after[i]
        elif d is None:
            d = before[i] and after[i] or b.heading and any(decided[i + 1 : i + 1 + rules.reach]) or marked and (before[i] or after[i])
        out.append(bool(d))
    return out


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The main text: its blocks in page order, one a line."""
    blocks = Blocks().read(page or "")
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks, rules)) if good)


def extract(pages: DataFrame, html: str = "html", output: str = "text", rules: BlockRules = BlockRules()) -> DataFrame:
    """``pages`` with the main text of every page as column ``output``.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order by one line break. A null or empty page, and one without main text, give
    an empty text. A column of ``pages`` with the name of the output is replaced; no row is dropped.
    """

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda page: main_text(page, rules))

    return pages.withColumn(output, text(F.coalesce(F.col(html), F.lit(""))))
