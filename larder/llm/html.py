"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, each block alone:

* bad: inside a menu, header, footer, sidebar, notice, advert, form or comment section (by element, role, class or id; a
  name says nothing of a main element, of an article that is named like one, or of a container that holds the page),
  hidden, or mostly link text. A name counts as a whole: ``ad-slot`` names an advert, ``ad-free`` and ``related-work`` name
  nothing. Ids of headings, paragraphs and other single blocks say nothing, for they are mostly made from the text, their
  classes only what a single block can be;
* good: long with many stop words;
* otherwise bad if it is long with few stop words, else ambiguous: ``near`` or ``few`` (fairly long, with or without a share
  of stop words) or ``short``.

A page of few stop words throughout is in a language or script that the list lacks; there length and links decide alone.

Second pass: ambiguous blocks inherit the label of their nearest decided neighbours. Where these differ, ``near`` blocks are
good if the good neighbour is of their own section, and ``short`` ones follow the neighbour of their own section, else the
closer (a heading the following, a tie is bad).
``few`` blocks come first: they are good only if their neighbours in their own section are. If no block is good, the ``near``
ones are, and if there are none of these, all with a word that are not bad: a short page.

Article, main and so named elements are a feature of the rules. The surest kind of them with at least as much text as is
good by itself outside them is taken to hold the article (others are teasers or cards); of several the small ones without a
good block are cards too. What is outside is bad. Inside, the first pass runs with other thresholds: few stop words make no
block bad, and links only in a menu, a run of short blocks of nothing else (two in a bulleted list, three elsewhere; a
numbered list is no menu). Ambiguous blocks inherit from the decided blocks inside or the holder's own edge, which is good;
where these differ they are good.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one \\n. Scripts,
styles, comments, titles and other markup never are text. Nothing is cut or capped, and every page takes linear time.

Nulls: a null or empty html gives an empty text. Broken and truncated markup is read as far as it goes: an
unclosed or self-closed tag hides nothing but itself, except unclosed script, style and comment, which are code to the
end. Rows are independent, so ties and repeated rows give equal results; very long pages are one row, read whole. No rows
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML by their role here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body blockquote details dialog div dl fieldset figure footer form header main menu nav ol section select table td th tr ul".split())
BAD_ELEMENTS = frozenset("aside dialog footer form menu nav select button".split())
CODE = frozenset(("script", "style"))
RAW = frozenset("noscript template title textarea iframe svg math object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that gather what belongs together; lists, tables and their parts do not.
SECTIONS = frozenset("article aside body details dialog div footer form header main nav section".split())
# Words of class, id and role that name what is not the article.
BAD_WORDS = frozenset("ad ads adslot adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disclaimer disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notification outbrain paywall popup promo promoted promotion recommended related respond responses reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toc toolbar widget widgets".split())
# Words that stand beside those in names of the same things.
PART_WORDS = frozenset("area article articles bar block bottom box button buttons container content footer global header icons inner item items left link links list main outer page panel post posts primary reader readers right row secondary section site slot story stories thread top unit user users wrap wrapper".split())
# Those that a single block, not a section, can have as its class.
BLOCK_WORDS = frozenset("ad ads advert advertisement breadcrumb breadcrumbs cookie disclaimer newsletter notice promo share sharing sponsored subscribe".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
MAIN_WORDS = frozenset("article articlebody content entry post story".split())
# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could do for from had has have he her his how if in into is it its more my no not of on one or our out she so some than that the their them then there they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou où par pas pour qu que qui sa se ses son sur ta te tu un une vos vous "
    "al algo ante como con cual del desde donde el ella ellos entre era esa ese esta este hasta hay la las lo los me mi muy nada ni no nos o para pero por porque que quien se sin sobre su sus también te tiene todo un una y ya yo "
    "che di e gli i non per una da em não os uma het een niet van voor".split()
)
TAG_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
CODE_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in CODE}
NAME_WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
#: What can hold the article, the surest first: the element, a main element, a name. A container has the sum of those it is in.
ARTICLE, MAIN, NAMED, NONE = 4, 2, 1, 0

SHORT, LONG, LINKS, FEW_STOPS, MANY_STOPS = 70, 200, 0.4, 0.1, 10
#: A menu inside an article has so many blocks of link text or more, each shorter than an item; a card has at most this share
#: of the largest text.
MENU, ITEM, CARD = 3, 40, 0.2


class Container:
    """An open element; what it says about its blocks includes what those around it say."""

    __slots__ = ("name", "bad", "main", "outer", "doubt", "section", "holders", "number")

    def __init__(self, name: str, number: int, outer: Container | None, bad: bool, main: int, doubted: bool) -> None:
        self.name, self.number, self.outer = name, number, outer
        self.bad = bad or bool(outer and outer.bad)
        self.main = NONE if self.bad else main | (outer.main if outer else NONE)
        self.doubt = self if doubted else outer.doubt if outer else None  # the innermost whose name alone is bad
        self.section = number if name in SECTIONS or not outer else outer.section
        # The outermost element of each kind around.
        self.holders = dict(outer.holders) if outer and main and not self.bad else outer.holders if outer else {}
        if main and not self.bad:
            if self.holders is (outer.holders if outer else None):
                self.holders = dict(self.holders)
            self.holders.setdefault(main, number)


class Block:
    __slots__ = ("text", "link", "bad", "inside", "heading", "stops", "words", "label")

    def __init__(self, text: str, link: float, bad: bool, inside: Container, heading: bool) -> None:
        self.text, self.link, self.bad, self.inside, self.heading, self.label = text, link, bad, inside, heading, ""
        self.stops = self.words = 0


class Tag:
    __slots__ = ("start", "end", "name", "closes", "attrs")

    def __init__(self, start: int, end: int, name: str, closes: bool, attrs: str) -> None:
        self.start, self.end, self.name, self.closes, self.attrs = start, end, name, closes, attrs


def tags_of(page: str) -> Iterator[Tag]:
    """All tags in order, with comments and code as nameless tags. What looks like a tag but never ends is text."""
    at, last, quotes = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield Tag(start, at, "", False, "")
            continue
        if start > last:
            return
        m = TAG_NAME.match(page, start + 1)
        if not m:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/"):
                at = page.find(">", at) + 1
                yield Tag(start, at, "", False, "")
            continue
        end = m.end()
        while quotes and (q := QUOTE_OR_END.search(page, end)) and q[0] != ">":
            end = page.find(q[0], q.end()) + 1
            if not end:
                q = None
                break
        if not quotes or not q:
            # A quote that nothing closes: from here on quotes are like other characters, so no page is scanned twice.
            quotes, end = False, page.find(">", m.end())
        else:
            end = q.start()
        closes, name = m[0][0] == "/", m[0].lstrip("/").lower()
        attrs, at = page[m.end() : end], end + 1
        if name in CODE and not closes:
            if not self_closed(attrs):
                found = CODE_END[name].search(page, at)
                at = found.end() if found else len(page)
            yield Tag(start, at, "", False, "")
        else:
            yield Tag(start, at, name, closes, attrs)


def self_closed(attrs: str) -> bool:
    """Whether a tag ends by a slash that is not part of an unquoted value."""
    return attrs.endswith("/") and (len(attrs) == 1 or attrs[-2] in " \t\r\n\f\"'")


def raw_ends(tags: list[Tag]) -> dict[int, int]:
    """Where each raw element that is closed starts and ends; an unclosed or self-closed tag is one tag and no more."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for t in tags:
        if t.name in RAW:
            if not t.closes:
                if not t.attrs.endswith("/"):
                    open_.setdefault(t.name, []).append(t.start)
            elif open_.get(t.name):
                ends[open_[t.name].pop()] = t.end
    return ends


def told(attrs: str) -> tuple[list[str], list[str], bool]:
    """The names in an element's class, role and itemprop, those in its id, and whether it is hidden."""
    names: list[str] = []
    ids: list[str] = []
    hidden = False
    for name, value in ATTRIBUTE.findall(attrs) if attrs else ():
        name = name.lower()
        if name in ("class", "role", "itemprop"):
            names += value.strip("\"'").split()
        elif name == "id":
            ids.append(value.strip("\"'"))
        elif name == "hidden" or name == "style" and UNSEEN_STYLE.search(value) or name == "aria-hidden" and value.strip("\"'").lower() == "true":
            hidden = True
    return names, ids, hidden


def words_of(name: str) -> list[str]:
    return NAME_WORD.findall(CAMEL.sub(r"\1 \2", name).lower())


def names_one_of(names: list[str], wanted: frozenset[str]) -> bool:
    """Whether a name as a whole says one of ``wanted``: it has one, and beside them only words that go with them."""
    return any(wanted.intersection(words) and all(w in wanted or w in PART_WORDS for w in words) for words in map(words_of, names))


def blocks_of(page: str) -> list[Block]:
    found: list[Block] = []
    parts: list[str] = []
    linked = [0, 0]  # link characters, all characters
    top = Container("", 0, None, False, NONE, False)
    stack, opened, containers = [top], Counter(), [top]
    in_link = heading = alone_bad = False
    tags = list(tags_of(page))
    ends, at = raw_ends(tags), 0

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                found.append(Block(text, linked[0] / max(1, linked[1]), alone_bad or stack[-1].bad, stack[-1], heading))
            parts.clear()
            linked[:] = 0, 0

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            n = len(text) - text.count(" ")
            linked[1] += n
            if in_link:
                linked[0] += n

    for t in tags:
        if t.start < at:  # inside a raw element
            continue
        say(page[at : t.start])
        at, name = ends.get(t.start, t.end), t.name
        if name == "a":
            in_link = not t.closes
        elif name in ("br", "wbr", "img", "input"):
            parts.append(" ")
        if name in BLOCKS or name == "button":
            flush()
            in_link, heading, alone_bad = False, not t.closes and name in HEADINGS, False
            if name not in CONTAINERS and not t.closes and t.attrs:
                names, _, hidden = told(t.attrs)
                alone_bad = hidden or not heading and any(n.lower() in BLOCK_WORDS for n in names)
        if name in CONTAINERS or name == "button":
            if t.closes:
                if opened[name]:
                    while (shut := stack.pop()).name != name:
                        opened[shut.name] -= 1
                    opened[name] -= 1
            elif not t.attrs.endswith("/"):
                names, ids, hidden = told(t.attrs)
                words = {w for n in names + ids for w in words_of(n)}
                outer = stack[-1]
                body, inside = name == "body", outer.main
                bad = name in BAD_ELEMENTS or hidden and not body or not inside and name == "header"
                main = ARTICLE if name == "article" else MAIN if name == "main" else NAMED if words & MAIN_WORDS and not body else NONE
                by_name = not body and names_one_of(names + ids, BAD_WORDS) or not inside and names_one_of(names + ids, HEADER_WORDS)
                doubted = not bad and by_name and name != "main" and not (name == "article" and words & MAIN_WORDS)
                stack.append(Container(name, len(containers), outer, bad, main, doubted))
                containers.append(stack[-1])
                opened[name] += 1
    say(page[at:])
    flush()
    acquit(found, containers)
    return found


def acquit(blocks: list[Block], containers: list[Container]) -> None:
    """Sets ``bad`` where a container's name says so, unless the container is what holds the page.

    That is one with more than half of the text, and outside it an article, main or so named element has headings at most.
    """
    held = [0] * len(containers)
    for b in blocks:
        if not b.bad and b.inside.doubt:
            held[b.inside.doubt.number] += len(b.text)
    around = lambda c: c.outer.doubt if c.outer else None
    for c in reversed(containers):
        if c.doubt is c and around(c):
            held[around(c).number] += held[c.number]
    total = sum(len(b.text) for b in blocks if not b.bad)
    free = any(not b.bad and b.inside.main and not b.inside.doubt and not b.heading for b in blocks)
    condemned = [False] * len(containers)
    for c in containers:
        if c.doubt is c:
            condemned[c.number] = free or held[c.number] <= total / 2 or bool(around(c)) and condemned[around(c).number]
    for b in blocks:
        b.bad = b.bad or bool(b.inside.doubt) and condemned[b.inside.doubt.number]


def count_stop_words(blocks: list[Block]) -> bool:
    """Sets the stop words and words of each block; whether the page is in a language of the list."""
    for b in blocks:
        words = LETTERS.findall(b.text.lower())
        b.words, b.stops = len(words), sum(w in STOP_WORDS for w in words)
    long_ = [b for b in blocks if not b.bad and len(b.text) >= SHORT]
    return sum(b.stops for b in long_) >= FEW_STOPS * sum(b.words for b in long_)


def by_density(b: Block, known: bool, inside: bool = False, menu: bool = False) -> str:
    """The label of a block by its links, length and stop words alone; ``inside`` what holds the article, by other thresholds."""
    if menu or b.link > LINKS and not inside:
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if b.link > 0 and not inside else "short"
    long_ = len(b.text) >= LONG
    if inside and b.link > LINKS:
        return "near"
    if not known:
        return "good" if long_ else "near"
    if b.stops < FEW_STOPS * b.words or not b.words:
        return "near" if inside else "bad" if long_ else "few"
    return "good" if long_ and b.stops >= MANY_STOPS else "near"


def inside_holder(blocks: list[Block], labels: list[str]) -> set[int] | None:
    """Places of the blocks in what holds the article, or None where nothing does."""
    for kind in (ARTICLE, MAIN, NAMED):
        parts: dict[int, list[int]] = {}
        for i, b in enumerate(blocks):
            if not b.bad and b.inside.main & kind:
                parts.setdefault(b.inside.holders[kind], []).append(i)
        size = {c: sum(len(blocks[i].text) for i in at) for c, at in parts.items()}
        inside = {i for at in parts.values() for i in at}
        outside = sum(len(b.text) for i, (b, label) in enumerate(zip(blocks, labels, strict=True)) if i not in inside and not b.bad and label == "good")
        if not inside or kind != NAMED and outside > sum(size.values()):
            continue
        most = max(size, key=size.__getitem__)
        if any(labels[i] == "good" for i in parts[most]):
            inside = {i for c, at in parts.items() if size[c] > CARD * size[most] or any(labels[i] == "good" for i in at) for i in at}
        return inside
    return None


def menus(blocks: list[Block], among: list[int]) -> set[int]:
    """Places of runs of blocks of one list or parent that are nothing but short links."""
    found: set[int] = set()
    run: list[int] = []
    parent = None
    for i in [*among, -1]:
        link = i >= 0 and blocks[i].link > 0.9 and len(blocks[i].text) < ITEM
        c = blocks[i].inside
        here = c.outer or c if c.name in SECTIONS else c
        if run and not (link and here is parent):
            if parent.name != "ol" and len(run) >= (2 if parent.name in ("ul", "menu") else MENU):
                found.update(run)
            run = []
        if link:
            run.append(i)
            parent = here
    return found


def classify(blocks: list[Block]) -> None:
    """Sets ``label`` of each block to good or bad."""
    known = count_stop_words(blocks)
    labels = ["bad" if b.bad else by_density(b, known) for b in blocks]
    inside = inside_holder(blocks, labels)
    if inside is None:
        inherit(blocks, labels, list(range(len(blocks))), "bad")
        return
    among = sorted(inside)
    menu = menus(blocks, among)
    for i, b in enumerate(blocks):
        labels[i] = b.label = by_density(b, known, True, i in menu) if i in inside else "bad"
    for i in among:
        labels[i] = "good" if labels[i] == "near" else labels[i]
    inherit(blocks, labels, among, "good")


def inherit(blocks: list[Block], labels: list[str], among: list[int], edge: str) -> None:
    """Sets the labels of the blocks ``among``: the decided ones keep theirs, the others take their neighbours'.

    ``edge`` is the label of what is before the first and behind the last of them.
    """
    if not any(labels[i] == "good" for i in among):
        for i in among:
            labels[i] = "good" if labels[i] == "near" else labels[i]
    if edge == "bad" and not any(labels[i] == "good" for i in among):
        for i in among:
            if labels[i] != "bad" and any(len(w) > 1 for w in LETTERS.findall(blocks[i].text)):
                labels[i] = "good"
    for kinds in (("few",), ("near", "short")):
        settle(blocks, labels, among, edge, kinds)
    for i in among:
        blocks[i].label = labels[i]


def settle(blocks: list[Block], labels: list[str], among: list[int], edge: str, kinds: tuple[str, ...]) -> None:
    """Gives the blocks of some ambiguous kinds the labels of their neighbours that were decided before."""
    decided, k = [i for i in among if labels[i] in ("good", "bad")], 0
    was = {i: labels[i] for i in decided}
    for place, i in enumerate(among):
        if i in was:
            k += 1
        if labels[i] not in kinds:
            continue
        b, before, after = blocks[i], decided[k - 1] if k else -1, decided[k] if k < len(decided) else -1
        first, second = was.get(before, edge), was.get(after, edge)
        own = [x >= 0 and blocks[x].inside.section == b.inside.section for x in (before, after)]
        left, right = i - before if before >= 0 else place + 1, after - i if after >= 0 else len(among) - place
        if labels[i] == "few":
            here = [label for label, mine in zip((first, second), own, strict=True) if mine]
            labels[i] = "good" if here and "bad" not in here else "bad"
        elif first == second:
            labels[i] = first
        elif edge == "good" or labels[i] == "near" and own[first == "bad"]:
            labels[i] = "good"
        elif labels[i] == "near":
            labels[i] = "bad"  # alone in its section, between good and bad
        elif b.heading or own[0] == own[1] and right < left or own[1] and not own[0]:
            labels[i] = second
        elif own[0] and not own[1] or left < right:
            labels[i] = first
        else:
            labels[i] = "bad"


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


@F.pandas_udf(T.StringType())
def main_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of ``pages``."""
    return pages.select("page_id", "url", main_text_udf(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
