"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides a block
from its stop-word density, its length and its link density, and from the
element it stands in (menus, headers, footers, forms, adverts, notices,
comments are never text).  What is too short to decide is ambiguous; the
second pass gives it the label of its nearest decided neighbour.  Inside an
article or main element only neighbours of the same element count, what is
left out is no neighbour, and a block without any is text; links decide only
for the items of a list that hold nothing else, and an element is an advert,
notice or the like only if its whole class name says so ("related-posts", not
"social-history").

Stop words are known for four languages.  On a page whose text holds next to
none of them, sentence marks take the place of stop words.

A block under 200 characters is a copyright notice, and no text, if it starts
with the sign or the word and a year ("Copyright (c) 2020 ..."); outside an
article or main element also if it starts with the sign, holds the sign or the
word with a year or "copyright by", or reserves all rights.  Text that merely
speaks of copyright is judged like any other.

Defined results: null or empty html gives an empty text; unclosed and stray
tags are tolerated, also a head or a menu without its end tag; repeated rows
and null page_ids are extracted row by row; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could for from had has have he her his if in into is it its
more my no not of on or other our she so some that the their them then there these they this to was we were what when which
who will with would you
aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist
kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que
qui sa se ses son sont sur un une vous y
al como con cuando de del el ella en entre era es esta este ha hay la las le lo los más me muy no nos o para pero por que
se si sin sobre son su sus también un una y ya
""".split())

# Elements and the words of class, id and role that mark what is no article text.
RAW = frozenset("script style textarea template svg iframe noscript object canvas".split())
BAD_TAGS = frozenset("head nav header footer aside form menu dialog select button fieldset".split())
MAIN_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("""
ad ads adv advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter
subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header
masthead share sharing social related recommended comment comments disqus reply replies respond login search widget toolbar
pagination pager copyright contentinfo complementary dialog skip
""".split())
# Words that beside one of the above still name such an element.
FILL_WORDS = frozenset("""
post posts article articles news story stories link links list lists item items box block container wrapper wrap inner outer
section area content widget widgets button buttons bar icon icons media form field panel top bottom left right inline slot unit
main page site global floating sticky fixed more this js
""".split())
HEAD_TAGS = frozenset("title base link meta basefont bgsound command".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
HEADER_WORDS = frozenset("header masthead banner".split())
CONTAINERS = BAD_TAGS | MAIN_TAGS | frozenset("div section table ul ol dl blockquote figure details center body".split())
LISTS = frozenset("ul ol dl".split())
INLINE = frozenset("""
a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup
time tt u var wbr img
""".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_WORDS = re.compile(r"[^\W\d_]+")
# Copyright notices: a block that starts with the word or the sign and a year; outside articles also one
# that starts with the sign, names the sign with a year or an owner, or reserves all rights.
_SIGN = r"(?:©|\(c\)|copyright\b)"
_NOTICE = re.compile(rf"\W*{_SIGN}(?:\W|{_SIGN})*(?:by\W+)?(?:19|20)\d\d\b", re.I)
_OWNER = re.compile(rf"^[^\w©]*©|{_SIGN}\W*(?:19|20)\d\d\b|copyright\W*(?:©|\(c\)|by\b)|all rights reserved", re.I)

LONG, SHORT = 200, 70  # characters
DENSE, THIN, LINKED, MENU = 0.30, 0.12, 0.35, 0.9  # stop words per word; share of characters inside links
UNKNOWN = 0.06  # stop words per word of a whole page, below which its language is not known
SENTENCE = 150  # characters a sentence mark stands for, where no language is known
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$|[\"'”’»)])|[。！？．؟۔।]")

GOOD, BAD, OPEN = 1, 0, -1


def _words_of(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in _MARKS.finditer(attributes):
        found.update(p.lower() for p in _PARTS.findall(m[2] or m[3] or m[4] or ""))
    return found


def _names_no_text(attributes: str) -> bool:
    """Whether a whole class, id or role names an element that is no article text."""
    for m in _MARKS.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = {p.lower() for p in _PARTS.findall(name) if not p.isdigit()}
            if parts and parts <= (BAD_WORDS | FILL_WORDS) and (parts & BAD_WORDS) - HEADER_WORDS:
                return True
    return False


def _is_bad(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in MAIN_TAGS or tag == "body":
        return "=" in attributes and bool(_words_of(attributes) & COMMENT_WORDS)
    if _HIDDEN.search(attributes):
        return True
    if in_main:  # an article's own header holds its title
        return (tag in BAD_TAGS and tag != "header") or ("=" in attributes and _names_no_text(attributes))
    return tag in BAD_TAGS or ("=" in attributes and bool(_words_of(attributes) & BAD_WORDS))


class _Blocks:
    """Cuts a page into (text, link characters, bad, main element, in a list) blocks."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False
        self.stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, bad, number of its main element
        self.mains = 0
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                _, bad, main = self.stack[-1]
                # what is left out inside an article is no neighbour of its blocks
                self.blocks.append((text, self.linked, bad, 0 if bad else main, any(t in LISTS for t, _, _ in self.stack)))
            self.parts = []
        self.linked = 0

    def _text(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            less = page.find("<", at)
            if less < 0:
                self._text(page[at:])
                return
            self._text(page[at:less])
            m = _TAG.match(page, less) or _LOOSE.match(page, less)
            if not m:
                self._text("<")
                at = less + 1
                continue
            at = m.end()
            if m.lastindex is None or m[2] is None:
                continue
            tag = m[2].lower()
            if not m[1] and self.stack[-1][0] == "head" and tag not in HEAD_TAGS and tag not in RAW:
                self._flush()  # a head without an end tag ends with the first element that it cannot hold
                self.stack.pop()
            if tag in RAW and not m[1]:
                if not m[3].endswith("/"):
                    end = _END[tag].search(page, at)
                    at = end.end() if end else size
            elif tag == "a":
                self.in_link = not m[1]
            elif tag not in INLINE:
                self._flush()
                if tag in CONTAINERS:
                    self._close(tag) if m[1] else self._open(tag, m[3])

    def _open(self, tag: str, attributes: str) -> None:
        if attributes.endswith("/"):
            return
        self.in_link = False
        if tag in MAIN_TAGS:  # a menu or header that was never closed ends here
            while self.stack[-1][0] in BAD_TAGS and self.stack[-1][0] != "form":
                self.stack.pop()
        _, bad, main = self.stack[-1]
        bad = bad or _is_bad(tag, attributes, bool(main))
        if tag in MAIN_TAGS and not main:
            self.mains += 1
            main = self.mains
        self.stack.append((tag, bad, main))

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(text: str, linked: int, bad: bool, main: int, listed: bool, known: bool = True) -> int:
    """GOOD, BAD or OPEN (ambiguous); ``known``: the page is in a language with stop words."""
    if bad or linked > (MENU if main and listed else 1 if main else LINKED) * len(text):
        return BAD
    if len(text) < LONG and (_NOTICE.match(text) or (not main and _OWNER.search(text))):
        return BAD
    if not known:
        marks = len(_SENTENCE.findall(text))
        return GOOD if marks and marks * SENTENCE >= len(text) and len(text) >= SHORT else OPEN if main or marks or len(text) < SHORT else BAD
    if len(text) < SHORT:
        return OPEN
    found, words = stop_words(text)
    density = found / max(words, 1)
    if density >= DENSE:
        return GOOD
    if main:
        return GOOD if density >= THIN and len(text) >= LONG else OPEN
    return OPEN if density >= THIN or len(text) < LONG else BAD


def second_pass(labels: list[int], mains: list[int]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided neighbour (of
    their own main element, if they are in one); at equal distance text wins
    only if both neighbours are text."""
    n = len(labels)

    def nearest(order: range) -> list[tuple[int, int]]:
        seen: dict[int, tuple[int, int]] = {}
        out = [(n + 1, OPEN)] * n
        for i in order:
            if labels[i] != OPEN:
                seen[mains[i]] = seen[0] = (i, labels[i])
            elif (mains[i] or 0) in seen:
                j, label = seen[mains[i]]
                out[i] = (abs(i - j), label)
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    final = []
    for i in range(n):
        if labels[i] != OPEN:
            final.append(labels[i] == GOOD)
            continue
        (d1, l1), (d2, l2) = before[i], after[i]
        if l1 == OPEN and l2 == OPEN:
            final.append(bool(mains[i]))
        elif d1 == d2:
            final.append(l1 == l2 == GOOD)
        else:
            final.append((l1 if d1 < d2 else l2) == GOOD)
    return final


def main_text(page: str) -> str:
    blocks = _Blocks(page).blocks
    counts = [stop_words(b[0]) for b in blocks if not b[2]]
    known = not counts or sum(c for c, _ in counts) >= UNKNOWN * sum(n for _, n in counts)
    labels = [first_pass(*b, known) for b in blocks]
    mains = [0 if label == BAD else b[3] for label, b in zip(labels, blocks, strict=True)]
    kept = second_pass(labels, mains)
    return " ".join(b[0] for b, keep in zip(blocks, kept, strict=True) if keep)


def _extract_batches() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(page or "") for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """Per input row: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    texts = rows.mapInArrow(_extract_batches(), "page_id long, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
