"""Main text of web pages by two passes over their blocks.

Pass one decides each block by stop-word density, length and link density; containers that are boilerplate by their tag,
role or name decide for the blocks inside. Pass two lets blocks that are too short or too mixed to decide inherit the
label of the nearest decided neighbour in the same part of the page (inside or outside the article).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Frequent function words of the languages that are told apart.
STOP_WORDS = frozenset(
    (
        "a about all also an and are as at be been but by can do for from had has have he her his if in into is it its more not of on one or our "
        "she so than that the their them there they this to up was we were what when which who will with would you your "
        "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses "
        "son sont sur un une vous "
        "aber als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist kann mit nach "
        "nicht noch nur oder sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur "
        "al como con cuando del desde donde el ella entre era es esta este esto ha hay lo los más me mi muy no nos o para pero por porque si sin "
        "sobre su sus también tan te tiene todo tu una uno y ya"
    ).split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
DROPPED_TAGS = frozenset("button canvas iframe noscript object script select style svg template textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("aside dialog footer form menu nav".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Names are class and id tokens. A token counts if all its parts between hyphens are such words, or words that only say
# which part or how many ("site-footer", "comments-area"); "content-sidebar-wrap" and "has-sidebar" name a layout.
BEFORE = r"(?:site|global|primary|secondary|top|bottom|post|entry|article)[_-]+"
AFTER = r"[_-]+(?:area|bar|block|box|container|form|inner|items?|links?|lists?|section|wrap|wrapper)"
LAYOUT = r"nav|navbar|navigation|menu[^\W_]*|side-?bar|breadcrumbs?|pagination|pager|foot|footer|share|sharing|social|widget|copyright|disclaimer|toolbar|topbar|skip-?link"
MATTER = (
    r"ads?|adbox|adsense|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|comments?|comment-?list|disqus[^\W_]*|respond|repl(?:y|ies)|cookies?|consent|gdpr|notices?|popup|modal|"
    r"newsletter|subscribe|signup|login|related|recommended"
)


def _name(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?:^|\s)(?:{BEFORE})*(?:{words})(?:[_-]+(?:{LAYOUT}|{MATTER})|{AFTER})*(?=\s|$)")


#: Names of layout, which an article or main element inside may overrule, and of matter that is not the page's own.
LAYOUT_NAME, MATTER_NAME, HEAD_NAME = _name(LAYOUT), _name(rf"(?:(?:{LAYOUT})[_-]+)*(?:{MATTER})"), _name("header|masthead|banner")
#: How bad a container is: not; an article in others' matter, which counts if the page has no other; layout; others' matter; for good.
CLEAN, LAST_RESORT, BAD_LAYOUT, BAD_MATTER, BAD = range(5)

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in DROPPED_TAGS}
WORD = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[a-z\u00df-\u024f]")
DENSE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")  # one character says as much as several letters


@dataclass
class Rules:
    """Thresholds of pass one. Lengths are characters, densities shares of characters (links) or of words (stop words)."""

    max_link_density: float = 0.33
    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.20


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool
    inside: bool
    heading: bool
    plain: bool = True  # has words outside links
    in_menu: bool = False  # of several links alone, in one block or in blocks in a row


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def _badness(tag: str, source: str, inside: bool) -> int:
    if tag == "form":
        return BAD_LAYOUT  # some systems put whole pages into one
    if tag in BAD_TAGS or (tag == "header" and not inside):
        return BAD
    if "=" not in source and "hidden" not in source:
        return CLEAN
    have = _attributes(source.rstrip(">"))
    if "hidden" in have or have.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", have.get("style", "")) is not None or have.get("role", "").lower() in BAD_ROLES:
        return BAD
    if tag in ("article", "main", "body", "html"):
        return CLEAN
    name = f"{have.get('class', '')} {have.get('id', '')}".lower()
    if MATTER_NAME.search(name) is not None:
        return BAD_MATTER
    return BAD_LAYOUT if LAYOUT_NAME.search(name) is not None or (not inside and HEAD_NAME.search(name) is not None) else CLEAN


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, with what the containers around them say."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, how bad it or what is around it is, whether in an article or main, in an article
    levels: list[int] = []
    opened: dict[str, int] = {}  # how often each tag is on the stack
    state = {"link": 0, "heading": False}

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = " ".join(html.unescape("".join(links)).split())
                _, level, inside, _ = stack[-1] if stack else ("", CLEAN, False, False)
                levels.append(level)
                out.append(Block(text, len(linked), False, inside, state["heading"], not linked or sum(map(str.isalnum, text)) > sum(map(str.isalnum, linked))))
            parts.clear()
            links.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if state["link"]:
                links.append(text)

    at = 0
    while (m := TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, rest = m[2].lower(), bool(m[1]), m[3] or ""
        if tag in DROPPED_TAGS:
            if not closing and not rest.endswith("/>"):
                end = CLOSING[tag].search(page, at)
                at = end.end() if end else len(page)
            if tag in ("button", "select", "textarea"):
                add(" ")
            continue
        if tag in BLOCK_TAGS:
            close_block()
            state["heading"] = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            state["link"] = 0 if not closing and tag in ("p", "div", "article", "main", "section", "footer") else state["link"]
            if not closing and stack and stack[-1][0] == "p":
                pop()  # a paragraph ends where the next block begins
            if not closing and tag in ("li", "dt", "dd") and stack and stack[-1][0] == tag:
                pop()
        elif tag in ("br", "td", "th"):
            add(" ")
        if tag == "a":
            state["link"] = 0 if closing else 1
        elif closing:
            if opened.get(tag):
                if stack[-1][1] and tag not in BLOCK_TAGS:
                    close_block()
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID_TAGS:
            _, around, inside, article = stack[-1] if stack else ("", CLEAN, False, False)
            bad = _badness(tag, rest, inside)
            if tag in ("article", "main") and not article:
                around = {BAD_LAYOUT: CLEAN, BAD_MATTER: LAST_RESORT}.get(around, around)
            if bad and tag not in BLOCK_TAGS:
                close_block()
            if bad or tag in ("article", "main", "p", "div", "section", "ul", "ol", "li", "dl", "dt", "dd", "header", "table", "tr", "td"):
                opened[tag] = opened.get(tag, 0) + 1
                stack.append((tag, max(bad, around), inside or tag in ("article", "main"), article or tag == "article"))
    add(page[at:])
    close_block()
    best = CLEAN if any(level == CLEAN and b.inside for level, b in zip(levels, out, strict=True)) else LAST_RESORT
    for level, block in zip(levels, out, strict=True):
        block.bad = level > best
    return out


def _first_pass(block: Block, rules: Rules) -> bool | None:
    """True: text, False: boilerplate, None: undecided."""
    n = len(block.text)
    if block.bad or "©" in block.text and not block.inside and n < rules.long:
        return False
    if block.link_chars > rules.max_link_density * n:
        return None if block.inside and (block.plain or not block.in_menu) else False
    if block.heading or n < rules.short:
        return None
    words = WORD.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= rules.stop_high:
        return True
    if density >= rules.stop_low:
        return True if n >= rules.long or block.inside else None
    return None if block.inside else False


def _by_length(block: Block, rules: Rules, latin: bool) -> bool:
    """Whether a block outside articles is prose by length and links alone; `latin`: in whatever script."""
    if block.bad or block.heading or "©" in block.text and len(block.text) < rules.long or block.link_chars > rules.max_link_density * len(block.text):
        return False
    words = WORD.findall(block.text.lower())
    return len(block.text) + 2 * len(DENSE.findall(block.text)) >= rules.short and len(words) > 1 and (latin or 2 * sum(LATIN.search(w) is not None for w in words) < len(words))


def main_blocks(blocks: list[Block], rules: Rules) -> list[bool]:
    """Both passes: whether each block is main text.

    Boilerplate inside an article says nothing about its neighbours. Where nothing near is decided, an article is text
    and anything else is not; at equal distance the neighbour that is text wins. The stop words are those of some
    languages: on a page without article, blocks in a script that no list has, and all blocks if the lists find no text,
    are decided by length and links alone.
    """
    _mark_menus(blocks)
    first = [_first_pass(b, rules) for b in blocks]
    if not any(b.inside and not b.bad for b in blocks):
        silent = True not in first
        first = [label or _by_length(b, rules, silent) or label for label, b in zip(first, blocks, strict=True)]
    before = _nearest_decided(blocks, first, range(len(blocks)))
    after = _nearest_decided(blocks, first, range(len(blocks) - 1, -1, -1))
    out: list[bool] = []
    for i, block in enumerate(blocks):
        label = first[i]
        if label is None:
            near = [(abs(j - i), not first[j]) for j in (before[i], after[i]) if j is not None]
            label = not min(near)[1] if near else block.inside
        out.append(bool(label))
    return out


def _mark_menus(blocks: list[Block], least: int = 3) -> None:
    at = 0
    for links, run in groupby(blocks, lambda b: not b.plain):
        n = len(list(run))
        for block in blocks[at : at + n]:
            block.in_menu = links and (n >= least or block.link_chars < len(block.text))
        at += n


def _nearest_decided(blocks: list[Block], first: list[bool | None], order: range) -> list[int | None]:
    """For each block the last decided one that was passed in the same part of the page; one scan."""
    out: list[int | None] = [None] * len(blocks)
    seen: int | None = None
    inside = None
    for i in order:
        if blocks[i].inside != inside:
            seen, inside = None, blocks[i].inside
        out[i] = seen
        if first[i] or (first[i] is False and not blocks[i].inside):
            seen = i
    return out


def extract(page: str | None, rules: Rules | None = None) -> str:
    """Main text of a page, one line per block; empty for a null or empty page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, good in zip(blocks, main_blocks(blocks, rules or Rules()), strict=True) if good)


def main_text(page: Column, rules: Rules | None = None) -> Column:
    """Main text of the HTML in a column. Whole pages are read; nothing is cut; repeated rows give equal texts."""

    @F.arrow_udf(StringType())
    def text(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.array([extract(x.as_py(), rules) for x in batch], pa.string())

    return text(page)
