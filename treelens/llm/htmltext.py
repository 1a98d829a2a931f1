"""Main-text extraction from HTML in two passes over blocks.

Pass 1 looks at each block alone: where it stands (navigation, header, footer,
reader comments and so on never hold main text; forms and what is named advert
and so on only if long blocks full of stop words say otherwise), its link density, its length
and its stop-word density make it good, bad, short or near-good.  Standing in
an ``article`` or ``main`` lifts a block by one step: near-good to good, few
stop words to short, none at all to weak, a paragraph that is only a link to weak.  Pass 2 decides the ambiguous ones by their
nearest decided neighbours.

Stop words are those of four languages.  Where most of a page's longer text has
hardly any of them, it is in another language, and a block without them counts
by its length and its ends of sentences instead.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from .common import id_number, id_text

# Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its of on or she that the their they this to was were which will with you not "
    "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tu un une vos votre vous "
    "aber als am auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir zu zum zur "
    "al como con del donde el ella ellos entre era eso esta este fue ha hay las lo los más mi muy no nos para pero por porque sin sobre su sus también todo yo y".split()
)
# Elements whose text is never main text.
OUTSIDE = frozenset("nav header footer aside button select dialog menu noscript".split())
# Elements whose content is not text at all.
RAW = frozenset("script style template textarea iframe object svg title noframes".split())
# Elements that may hold more than boilerplate, whatever their class or id is.
PAGE = frozenset("html body main article".split())
# Names in class, id and role attributes that mark boilerplate, alone or joined with each other.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo promotion promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
# Names of what readers wrote, alone or with the others beside them: no text inside ever overrules these.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
COMMENT_PARTS = frozenset("all area author block body box container content count feed form group head header holder inner item items list main meta new node post reader readers section template text thread threads title top user users view wrap wrapper".split())
# Elements of running text: one that is only a link may still belong to the text around it.
TEXT = frozenset("p blockquote figcaption dd pre".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mfenced".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Thresholds of pass 1 (characters, and shares of words or characters).
SHORT, LONG = 70, 200
MAX_LINKS, MAX_LINKS_INSIDE = 0.2, 0.66
STOP_LOW, STOP_HIGH = 0.15, 0.3
#: Characters of a block that one end of a sentence may stand for, where no stop words are known.
SENTENCE = 250
#: Blocks between a heading and the good block it may belong to.
HEADING_REACH = 2

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
# one attribute after the other, values with them: what stands inside a value is no attribute
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_PART = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?…](?=\s|$)|[。！？।؟۔]")
# Scripts whose characters stand for syllables or words: each counts as three.
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


class Block:
    __slots__ = ("parts", "linked", "tag", "inside", "outside", "doubt", "heading", "text", "label")

    def __init__(self, tag: str, inside: int, outside: bool, doubt: int, heading: bool):
        self.parts: list[str] = []
        self.linked, self.tag, self.inside, self.outside, self.doubt, self.heading = 0, tag, inside, outside, doubt, heading


def _hidden(attributes: str) -> bool:
    return any(n.lower() == "hidden" or (n.lower() == "aria-hidden" and v.strip("\"'").lower() == "true") for n, v in _ATTRIBUTE.findall(attributes))


def _boilerplate(attributes: str) -> bool:
    """Whether a whole name (``sidebar``, ``cookie-notice``; not ``no-sidebar``) marks boilerplate."""
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for own in value.strip("\"'").lower().split():
                if (parts := _PART.findall(own)) and BOILERPLATE.issuperset(parts):
                    return True
    return False


def _comments(attributes: str) -> bool:
    """Whether a whole name (``comments``, ``comment-list``; not ``comments-open``) marks what readers wrote."""
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for own in value.strip("\"'").lower().split():
                parts = _PART.findall(own)
                if not COMMENTS.isdisjoint(parts) and all(p in COMMENTS or p in COMMENT_PARTS or p.isdigit() for p in parts):
                    return True
    return False


_raw_ends = {tag: re.compile(rf"</{tag}[\s>/]") for tag in sorted(RAW)}


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks with their surroundings; tolerates any broken markup."""
    blocks: list[Block] = []
    # open elements: (name, number of the outermost article/main or 0, outside main text, number of the innermost
    # doubtful element (negative: a form) or 0, heading)
    stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]
    opened: Counter[str] = Counter()  # how many elements of each name are open
    unclosed: set[str] = set()  # raw elements whose end tag doesn't come any more
    articles = doubts = 0
    block, links, at, size = None, 0, 0, len(page)
    lower = page.lower() if len(page.lower()) == size else "".join(c.lower() if len(c.lower()) == 1 else c for c in page)

    def add(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if not text.strip():
                return
            block = Block(*stack[-1])
            blocks.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(text)

    def close(depth: int) -> None:
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    while at < size:
        opening = page.find("<", at)
        if opening < 0:
            add(entities.unescape(page[at:]))
            break
        following = page[opening + 1 : opening + 2]
        if not (following.isalpha() or following in ("/", "!", "?")):
            add(entities.unescape(page[at : opening + 1]))
            at = opening + 1
            continue
        add(entities.unescape(page[at:opening]))
        if page.startswith("<!--", opening):
            end = page.find("-->", opening + 4)
            at = size if end < 0 else end + 3
            continue
        if following in "!?":
            end = page.find(">", opening)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, opening + 1)
        if not name:
            end = page.find(">", opening)
            at = size if end < 0 else end + 1
            continue
        end = _TAG_END.match(page, name.end())
        if end:
            at = end.end()
        else:  # an unclosed quote: the tag ends at the next ">"
            stop = page.find(">", name.end())
            at = size if stop < 0 else stop + 1
        tag = name.group(1).lower()
        if following == "/":
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE or any(x[0] == tag for x in stack[-3:]):
                if tag not in INLINE:
                    block = None
                if opened[tag] > 0:  # else no look through the stack, however deep
                    close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth][0] == tag))
                    block = None
            if tag not in INLINE:
                links = 0
            continue
        if tag in RAW:
            found = None if tag in unclosed else _raw_ends[tag].search(lower, at)
            if found:
                end = page.find(">", found.start())
                at = size if end < 0 else end + 1
            elif tag in ("title", "object", "svg"):
                unclosed.add(tag)
            else:
                at = size
            continue
        attributes = page[name.end() : at]
        named = len(attributes) > 2 and tag not in PAGE and _boilerplate(attributes)
        bad = tag in OUTSIDE or (len(attributes) > 2 and (_hidden(attributes) or (tag not in PAGE and _comments(attributes))))
        if tag == "br":
            add(" " if block is not None else "")
            continue
        if tag in INLINE and not (bad or named):
            if tag == "a":
                links += 1
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            # the end tag of these may be missing: a new one closes an open one
            for depth in range(len(stack) - 1, max(0, len(stack) - 3), -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        block, links = None, 0
        _, inside, outside, doubt, heading = stack[-1]
        if tag == "header" and inside and not outside and not named and not (len(attributes) > 2 and _hidden(attributes)):
            bad = False  # an article's own header holds its title
        if tag in ("article", "main") and not inside:
            articles += 1
            inside = articles
        if named or tag == "form":
            doubts += 1
            doubt = doubts if named else -doubts
        elif tag == "main" or (tag == "article" and doubt < 0):
            doubt = 0  # a form around an article says nothing of it
        opened[tag] += 1
        stack.append((tag, inside, outside or bad, doubt, heading or tag in HEADINGS))
    return blocks


def classify(blocks: list[Block]) -> None:
    """Sets ``label`` to good or bad (two passes) on blocks that have their ``text``."""
    raw = []
    known = unknown = 0  # characters of longer text with stop words, and without
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        links = b.linked / max(1, sum(map(len, b.parts)))
        length = len(b.text) + 2 * len(_WIDE.findall(b.text))
        raw.append((density, links, length))
        if length >= SHORT and links <= MAX_LINKS and not b.outside:
            known, unknown = (known + length, unknown) if density >= STOP_LOW else (known, unknown + length)
    measured = []
    dense: dict[int, int] = {}  # characters of each doubtful element: in long blocks full of stop words for, others against
    for b, (density, links, length) in zip(blocks, raw, strict=True):
        if unknown > known and density < STOP_LOW and length >= SHORT:
            ends = len(_SENTENCE_END.findall(b.text))
            density = STOP_HIGH if length > LONG and ends * SENTENCE >= length else STOP_LOW if ends else density
        else:
            length = len(b.text)
        sure = length > LONG and density >= STOP_HIGH and links <= MAX_LINKS
        measured.append((density, links, sure, length))
        if b.doubt and not b.outside:
            dense[b.doubt] = dense.get(b.doubt, 0) + (len(b.text) if sure else -len(b.text))
    for b, (density, links, sure, length) in zip(blocks, measured, strict=True):
        doubtful = dense.get(b.doubt, 0) < 0
        if b.outside or links > (MAX_LINKS_INSIDE if b.inside else MAX_LINKS):
            # a paragraph of an article that is a link goes with the paragraphs around it
            b.label = "weak" if b.inside and b.tag in TEXT and not (b.outside or doubtful) else "bad"
        elif doubtful:
            b.label = "good" if sure else "bad"
        elif length < SHORT:
            b.label = "short" if links == 0 else "weak" if b.inside else "bad"
        elif density >= STOP_HIGH:
            b.label = "good" if length > LONG or b.inside else "near"
        elif density >= STOP_LOW:
            b.label = "good" if b.inside else "near"
        else:
            b.label = "bad" if not b.inside else "short" if density > 0 else "weak"
    # what never holds main text says nothing of the article around it
    decided = [b.label if b.label in ("good", "bad") and not (b.inside and (b.outside or b.doubt)) else "" for b in blocks]
    # an article without a good block of its own is too short, or in no known language: only its markup speaks
    proven = {b.inside for b in blocks if b.label == "good"}
    left, right, last = [""] * len(blocks), [""] * len(blocks), "bad"
    for i, label in enumerate(decided):
        left[i] = last
        last = label or last
    last = "bad"
    for i in range(len(blocks) - 1, -1, -1):
        right[i] = last
        last = decided[i] or last
    first_pass = [b.label for b in blocks]
    for i, b in enumerate(blocks):
        if first_pass[i] == "near":
            b.label = "bad" if left[i] == right[i] == "bad" and len(blocks) > 1 and "good" in decided else "good"
        elif first_pass[i] in ("short", "weak") and b.inside and b.inside not in proven:
            b.label = "good"
        elif first_pass[i] == "weak":
            b.label = "good" if left[i] == right[i] == "good" else "bad"
        elif first_pass[i] == "short":
            if left[i] == right[i]:
                b.label = left[i]
            elif b.inside:  # between a good and a bad one: the article decides
                b.label = "good"
            else:  # or a near-good neighbour on the bad side decides
                side = i - 1 if left[i] == "bad" else i + 1
                b.label = "good" if 0 <= side < len(blocks) and first_pass[side] == "near" else "bad"
            if b.label == "bad" and b.heading and any(x in ("good", "near") for x in first_pass[i + 1 : i + 1 + HEADING_REACH]):
                b.label = "good"


def main_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in blocks if b.text]
    classify(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page's whole html.

    Null, empty and textless html gives an empty text; pages in other languages
    than those of STOP_WORDS are judged by lengths and sentences; a page without any
    decided block keeps its near-good ones; repeated rows each get a row; null
    page_id and url stay null; extra columns are ignored; an empty table gives
    an empty table.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    return id_number(pages.select(id_text("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long"), "page_id")
