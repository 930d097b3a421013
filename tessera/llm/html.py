"""Main text of web pages by two passes of block rules.

Method: markup is cut into blocks at block-level tags. First pass, each block alone: link density, length and stop-word
density call it good, near-good, short or bad, headings headings; on a page of a language whose stop words are not known,
the signs of sentences stand in for density. Place is one sign among them. Menus, asides, comments
and the like (MARKS) are bad. Forms and places whose names only hint (SOFT_MARKS) are bad too, but not when they hold
more than half of what reads like prose on the page: then they are the page's frame. A part that is marked as the article
lifts its blocks: none in it is bad by low density alone. Where such parts hold at least half as much as the prose that
stands outside them, or that is less than STORY letters, they are believed, and blocks outside them fall a step: good to near-good, near-good to short, short to bad.

Second pass: near-good and short blocks and headings inherit the label of their nearest decided neighbours of the same
part (the article they stand in, or all that stands in none); where none is decided there, what the part's mark says,
and on pages without a believed mark, good. Bad blocks inside an article, and those bad by their place, are insertions
and decide nothing. The good blocks, in page order, are the text.

An element that can hold no text (RAW) is passed over up to its end tag; without one only those that hold no markup
either swallow the rest. Spans of adverts are passed over, with the spans in them, up to their end or their block's.

Defined results: null, empty and text-free pages give an empty text; malformed markup is read as far as its tags can
be told; pages of any length are read whole; repeated rows each give their row; an empty table gives an empty table;
other columns are carried along, and columns named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.common import arrow_map, chunks

# Element names of HTML, words of class names, stop words.
#: What these hold is not text; the first few hold no markup either, so without an end tag they reach to the page's end.
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select option datalist audio video head".split())
SWALLOWS = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that another start tag of the kind, or of any block, closes.
ONE = {"p": BLOCK, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])} | {h: HEADING for h in HEADING}
ASIDE = frozenset("nav aside footer menu button label legend".split())
SOFT_ASIDE = frozenset("form dialog fieldset".split())
HEADER = frozenset(["header", "hgroup"])
#: A class or id whose first or last word is one of these marks what is not the article; of the second, what may be.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising advertorial adsbygoogle sponsor sponsored sponsors cookie cookies consent gdpr comment comments commentlist disqus reply replies respond menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc hidden".split()
)
SOFT_MARKS = frozenset(
    "sidebar sidebars aside rail related recommended recommendations trending share sharing social follow footer foot copyright legal disclaimer masthead topbar toolbar promo promos promotion banner banners notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall widget widgets popular more discussion feedback reviews tags search form skip".split()
)
ARTICLE_MARKS = frozenset("comment comments reply replies teaser related sponsored advert promo promoted".split())
HEADER_MARKS = frozenset(["header", "head"])
MARK_ROLES = frozenset("navigation banner contentinfo complementary menu menubar toolbar status".split())
SOFT_ROLES = frozenset("search alert alertdialog dialog form".split())
LAYOUT = frozenset("has with no without".split())
STOP_WORDS = frozenset(
    # English
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its just like me more my no not of on one only or other our out over she so some than that the their them then there they this to up us was we were what when which who will with would you your "
    # French
    "au aux avec ce ces cette comme dans de des du elle elles en est et être il ils je la le les leur leurs lui mais même ne nous on ou où par pas pour plus qu que qui sa sans se ses son sont sur un une vous y été "
    # German
    "aber als am auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat haben ich ihr ihre im in ist ja kann mit nach nicht noch nur oder sein seine sich sie sind so über um und von vor war was wenn werden wie wir wird zu zum zur "
    # Spanish
    "al como con cuando del el ella ellos entre era es esta este esto fue ha hasta la las lo los más me mi muy no nos o para pero por porque que se sin sobre su sus también te todo tu un una unos y ya".split()
)
SHORT, LONG, STORY = 70, 200, 600
LINKS_MAX = 0.33
STOP_LOW, STOP_HIGH = 0.10, 0.18

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?>[^<>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)""", re.I)
#: A line of rights: the sign first, or before a year.
_RIGHTS = re.compile(r"^\W*(?:©|copyright\b)|©\s*\d{4}", re.I)
#: Signs that end a sentence or part it, in any script; letters that stand for more than one of an alphabet.
_ENDS = re.compile(r"[.!?…](?=\s|\Z|[\"'»”’)])|[。！？；，、؟،؛।॥።။។]")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_EDGE = re.compile(r"^\W+|\W+$")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSERS: dict[str, re.Pattern] = {}


class Place:
    """What an open element says of the blocks in it; ``soft`` are the numbers of the places around it that may be frames."""

    __slots__ = ("article", "bad", "head", "name", "soft")

    def __init__(self, name: str, bad: bool, head: bool, article: int, soft: tuple[int, ...]):
        self.name, self.bad, self.head, self.article, self.soft = name, bad, head, article, soft


class Block:
    __slots__ = ("article", "bad", "breaks", "linked", "parts", "prose", "soft", "tag", "text")

    def __init__(self, tag: str, article: int, bad: bool, soft: tuple[int, ...]):
        self.tag, self.article, self.bad, self.soft, self.parts, self.linked, self.breaks = tag, article, bad, soft, [], 0, 0


def _marked(attrs: str) -> str:
    """``bad``, ``soft``, ``header`` or nothing, from what the attributes say."""
    found = ""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "bad"
        if name == "role" and value.lower() in MARK_ROLES:
            return "bad"
        if name == "role" and value.lower() in SOFT_ROLES:
            found = "soft"
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                if words and not LAYOUT.intersection(words):
                    ends = (words[0], words[-1])
                    if MARKS.intersection(ends):
                        return "bad"
                    if SOFT_MARKS.intersection(ends):
                        found = "soft"
                    elif HEADER_MARKS.intersection(ends):
                        found = found or "header"
    return found


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [Place("", False, False, 0, ())]
    at, links, articles, soft, now = 0, 0, 0, 0, Block("", 0, False, ())
    quiet, endless = 0, set()  # open spans of adverts; elements of which no end tag is left

    def close_block():
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        top = stack[-1]
        tag = next((s.name for s in reversed(stack) if s.name in HEADING or s.name in ("p", "li", "td", "div")), "")
        now = Block(tag, top.article, top.bad or top.head and not (top.article and tag in HEADING), top.soft)

    def take(text: str):
        if text and not quiet:
            text = html.unescape(text)
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())
            if not text.isspace():
                now.breaks = 0

    while m := _TAG.search(page, at):
        take(page[at : m.start()])
        at, name = m.end(), m["name"]
        if name is None:
            continue
        name, end = name.lower(), bool(m["end"])
        if quiet and name in BLOCK:
            quiet = 0  # a span ends with its block
        if name in RAW:
            if name not in endless and not end and not m["attrs"].endswith("/"):
                if name == "head":  # what belongs into a head ends with it or where the body begins
                    closer = _CLOSERS.setdefault(name, re.compile(r"</head\s*>|<body\b|<(?=(?:article|main|div|nav|p|h[1-6])\b)", re.I))
                    if c := closer.search(page, at):
                        at = c.end() if c[0].startswith("</") else c.start()
                    else:
                        endless.add(name)
                else:
                    closer = _CLOSERS.setdefault(name, re.compile(rf"</{name}\s*>", re.I))
                    c = closer.search(page, at)
                    if c:
                        at = c.end()
                    elif name in SWALLOWS:
                        at = len(page)
                    else:
                        endless.add(name)
        elif name == "a":
            links = 0 if end else 1
        elif name == "br":
            now.parts.append(" ")
            now.breaks += 1
            if now.breaks == 2:
                close_block()
        elif name in BLOCK or name in ASIDE or name in SOFT_ASIDE:
            if end:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
                if k:
                    del stack[k:]
            else:
                while len(stack) > 1 and name in ONE.get(stack[-1].name, ()):
                    stack.pop()
                top = stack[-1]
                one = Place(name, top.bad, top.head, top.article, top.soft)
                if name == "article" or name == "main":
                    articles += 1
                    one.article = articles if name == "article" else top.article or -articles
                    one.bad = top.bad or name == "article" and bool(ARTICLE_MARKS.intersection(re.findall(r"[a-z]+", m["attrs"].lower())))
                elif name not in ("html", "body"):
                    said = _marked(m["attrs"]) if m["attrs"] else ""
                    one.bad = top.bad or name in ASIDE or said == "bad"
                    one.head = top.head or name in HEADER or said == "header" and name not in HEADING
                    if name in SOFT_ASIDE or said == "soft":
                        soft += 1
                        one.soft = (*top.soft, soft)
                stack.append(one)
            if name in BLOCK:
                links = 0
            close_block()
        elif name == "span" and (quiet or not end and "class" in m["attrs"] and _marked(m["attrs"]) == "bad"):
            quiet += -1 if end else 1
    take(page[at:])
    close_block()
    return out


def _stop_words(b: Block) -> tuple[int, int]:
    """How many of a block's words are stop words, and how many words it has."""
    words = [_EDGE.sub("", w) for w in b.text.lower().split()]
    return sum(w in STOP_WORDS for w in words), len(words)


def _size(text: str) -> int:
    """Letters, those that stand for a syllable or word counted three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def _densities(found: list[Block]) -> list[float]:
    """Stop-word density of each block. Where the blocks of some length have hardly a stop word between them, the page's
    language is not among the known ones, and a block with the signs of sentences counts as dense."""
    counts = [_stop_words(b) for b in found]
    some = [c for b, c in zip(found, counts, strict=True) if not b.bad and b.linked <= LINKS_MAX * len(b.text) and _size(b.text) >= SHORT]
    if some and sum(k for k, _ in some) < STOP_LOW * sum(n for _, n in some):
        return [STOP_HIGH if _ENDS.search(b.text) else k / n for b, (k, n) in zip(found, counts, strict=True)]
    return [k / n for k, n in counts]


def _first_pass(found: list[Block]) -> tuple[list[str], set[int]]:
    """A label for each block, and the articles that are believed."""
    labels = []
    for b, density in zip(found, _densities(found), strict=True):
        n = _size(b.text)
        b.prose = 0
        if b.bad or b.linked > LINKS_MAX * len(b.text):
            labels.append("bad")
        elif b.tag in HEADING:
            labels.append("heading")
        elif n < SHORT:
            labels.append("bad" if b.linked and not b.article else "short")
        else:
            b.prose = n if density >= STOP_LOW else 0
            labels.append(("good" if n >= LONG else "near") if density >= STOP_HIGH else "near" if density >= STOP_LOW or b.article else "bad")
        if labels[-1] != "bad" and n < LONG and not b.article and _RIGHTS.search(b.text):
            labels[-1] = "bad"
    every = sum(b.prose for b in found)
    inside: dict[int, int] = {}
    for b in found:
        for s in b.soft:
            inside[s] = inside.get(s, 0) + b.prose
    for i, b in enumerate(found):
        if any(2 * inside[s] <= every for s in b.soft):  # no frame of the page: a form or notice
            labels[i], b.bad, b.prose = "bad", True, 0
    # Words of each part (0: what stands in no article), and whether the marked ones are believed.
    size: dict[int, int] = {}
    for b, x in zip(found, labels, strict=True):
        if x != "bad":
            size[b.article] = size.get(b.article, 0) + (b.prose if b.prose or not b.article else len(b.text))
    marked = {a for a in size if a > 0} or {a for a in size if a}
    believed = marked if marked and (2 * sum(size[a] for a in marked) >= size.get(0, 0) or size[0] < STORY) else set()
    if believed:
        lower = {"good": "near", "near": "short", "heading": "heading"}
        labels = [x if b.article in believed else lower.get(x, "bad") for b, x in zip(found, labels, strict=True)]
    return labels, believed


def _second_pass(found: list[Block], labels: list[str], believed: set[int]) -> list[bool]:
    """Which blocks are kept: undecided ones follow their nearest decided neighbours in the same part."""
    n = len(found)
    part = [b.article if b.article in believed else 0 for b in found]
    before, after = [""] * n, [""] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, str] = {}
        for i in order:
            side[i] = last.get(part[i], "")
            if labels[i] == "good" or labels[i] == "bad" and not part[i] and not found[i].bad:
                last[part[i]] = labels[i]
    keep = []
    for i, x in enumerate(labels):
        sides = before[i], after[i]
        if x in ("good", "bad"):
            keep.append(x == "good")
        elif sides == ("", ""):  # nothing is decided in this part
            keep.append(bool(part[i]) or not believed)
        elif x == "near":
            keep.append("good" in sides)
        elif x == "short":
            keep.append("good" in sides and "bad" not in sides)
        else:
            keep.append(after[i] == "good" or part[i] != 0)
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    labels, believed = _first_pass(found)
    return "\n".join(b.text for b, k in zip(found, _second_pass(found, labels, believed), strict=True) if k)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) and drops ``source``."""
    kept = [f for f in pages.schema.fields if f.name not in (source, "text", "n_chars")]
    names = [f.name for f in kept]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for b in chunks(batches, source, 8 << 20):
            texts = [main_text(x) for x in b.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    return arrow_map(pages.select(*names, source), run, schema)
