"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page is a series of tokens: tags with their path, and text blocks with the path they stand at. Tokens with the same
occurrence vector over the distinct pages of a host form an equivalence class. A class is nested by its paths: tokens
of one parent stand in the slots of that parent. It is valid where its tokens follow each other in one order on every
page; tags, moreover, only where their parents are valid up to the root. Valid classes are the host's template; what
lies between their tokens are slots, and the main text is what the slots hold, without those that are furniture.

Names do not decide alone. An article or main element outweighs other slots by a factor, tags and class names that
speak of furniture count only for elements that do not hold nearly all of a page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, unplaced

#: Names of HTML elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("noscript template script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never text of an article, and elements that mostly hold furniture.
NO_TEXT = frozenset("button canvas datalist head iframe input map noembed noframes noscript object optgroup option script select style svg template textarea title audio video".split())
FURNITURE_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
#: Words of class, id and role that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-links comment comments commentlist consent cookie cookies disqus dialog "
    "discussion feedback footer footnav gdpr header infobar login masthead menu menubar modal nav navbar navigation navigator newsletter notice notices notification overlay "
    "pager pagination paywall popup popover promo promotion recommendations recommended related reply replies respond responses search searchbox share sharing shoutbox sidebar signup "
    "skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser toc toolbar tooltip topbar widget widgets complementary contentinfo alert".split()
)
MAIN_WORDS = frozenset("main article articlebody content-body post-body entry-content article-body post-content".split())
#: Beginnings and ends of class names that tell of a state or a page, not of what the element holds.
STATE_FIRST = frozenset("has no with without is not js".split())
STATE_LAST = frozenset("fixed sticky open closed enabled disabled visible hidden active page wrapper layout".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag ends at the first > outside quotes, and quotes count after an equals sign only.
_VALUES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!\s*["'])))*+>""")
_OPEN = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?/])")
_ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that stand inside a paragraph without ending its text.
_SILENT = frozenset("script style template noscript".split())
_PART = re.compile(r"[a-z]+")
_OPENS = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_P_STAYS = INLINE | VOID | RAW | {"noscript", "template", "svg", "canvas", "button", "object", "audio", "video", "select"}
_PLAIN, _FURNITURE, _NO_TEXT = 0, 1, 2


@dataclass(slots=True)
class Block:
    """A run of text inside one block element: its text, the element, and how much of it are links."""

    text: str
    element: int
    link_chars: int


@dataclass
class Page:
    """Elements in page order, the first being the page itself, so that a parent comes before its children; blocks."""

    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [_PLAIN])
    #: 3 inside a main element, 2 inside an article, 1 inside what a class names so.
    rank: list[int] = field(default_factory=lambda: [0])
    blocks: list[Block] = field(default_factory=list)
    #: Tags and blocks in page order as (element of the parent, token).
    tokens: list[tuple[int, int]] = field(default_factory=list)


def _token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def text_token(path: int, text: str) -> int:
    return _token("text", str(path), text)


def names_furniture(value: str) -> bool:
    """Whether a class, id or role attribute names furniture: as a whole name, or as the first or last part of one."""
    for name in value.split():
        if name in FURNITURE_WORDS:
            return True
        parts = _PART.findall(name)
        if len(parts) > 1 and parts[0] not in STATE_FIRST and parts[-1] not in STATE_LAST and (parts[0] in FURNITURE_WORDS or parts[-1] in FURNITURE_WORDS):
            return True
    return False


def _next_tag(html: str, at: int) -> tuple[int, int, str, str, str] | None:
    """(start, end, mark, name, attributes) of the next tag, comment or declaration from `at` on; None if none ends.

    mark is '!' for what is no element, '/' for an end tag.
    """
    while (m := _OPEN.search(html, at)) is not None:
        start = m.start()
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            return start, len(html) if end < 0 else end + 3, "!", "", ""
        name = _NAME.match(html, start)
        if name is None:
            end = html.find(">", start)
            return None if end < 0 else (start, end + 1, "!", "", "")
        rest = _VALUES.match(html, name.end())
        # A quote that nothing closes is no quote; that happens once for each kind of quote, as none comes after it.
        end = rest.end() if rest else html.find(">", name.end()) + 1
        if not end:
            return None
        return start, end, name[1], name[2].lower(), html[name.end() : end - 1]
    return None


def parse(html: str | None) -> Page:
    """Elements, blocks and tokens of a page. Reads markup as browsers do where that matters: raw elements, void
    elements, paragraphs that end by themselves, stray end tags. One pass; memory follows the page."""
    page = Page()
    if not html:
        return page
    stack: list[tuple[str, int]] = []  # name, element
    here = 0
    open_names: dict[str, int] = {}
    text: list[str] = []
    links = [0, 0]  # open links, characters in them

    def flush() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                page.blocks.append(Block(words, here, min(links[1], len(words))))
                page.tokens.append((here, text_token(page.path[here], words)))
        links[1] = 0

    def pop() -> None:
        nonlocal here
        name = stack.pop()[0]
        open_names[name] -= 1
        if name == "a":
            links[0] -= 1
        here = stack[-1][1] if stack else 0

    def close(names) -> None:
        while stack and any(open_names.get(n) for n in names):
            top = stack[-1][0]
            if top not in INLINE and top not in _SILENT:
                flush()
            pop()
            if top in names:
                return

    def said(part: str) -> None:
        if part:
            text.append(part)
            if links[0]:
                links[1] += len(part)

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        tag = _next_tag(html, at) if at <= last or html.find("<!--", at) >= 0 else None
        if tag is None:
            # What opens here and never ends is no text.
            cut_off = _OPEN.search(html, at)
            said(html[at : cut_off.start() if cut_off else n])
            break
        start, end, mark, name, attributes = tag
        said(html[at:start])
        at = end
        if mark == "!":
            continue
        if mark:
            if name == "p" and not open_names.get("p"):
                flush()
            elif open_names.get(name):
                close((name,))
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name not in INLINE and name not in _SILENT:
            flush()
            if name not in _P_STAYS and open_names.get("p"):
                close(("p",))
        if name in _OPENS and name != "p":
            close(_OPENS[name])
        label, hidden, furniture, main = "", False, False, name in ("article", "main")
        if attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "").lower()
                if key.lower() in ("hidden", "aria-hidden"):
                    hidden |= key.lower() == "hidden" or value == "true"
                    continue
                label += f"{key.lower()}={value} "
                main |= not MAIN_WORDS.isdisjoint(value.split())
                furniture |= names_furniture(value)
        above = page.rank[here]
        path = _token(str(page.path[here]), name, label)
        page.tokens.append((here, path))
        if name in VOID:
            continue
        if name in RAW:
            close_tag = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if close_tag is None:
                at = n
            else:
                closed = html.find(">", close_tag.end())
                at = n if closed < 0 else closed + 1
            continue
        furniture = furniture and name not in ("body", "html", "article", "main") or name in FURNITURE_TAGS or name == "header" and not above
        page.parent.append(here)
        page.path.append(path)
        page.kind.append(_NO_TEXT if hidden or name in NO_TEXT else _FURNITURE if furniture else _PLAIN)
        page.rank.append(max(above, 3 if name == "main" else 2 if name == "article" else 1) if main else above)
        here = len(page.path) - 1
        stack.append((name, here))
        open_names[name] = open_names.get(name, 0) + 1
        if name == "a":
            links[0] += 1
    flush()
    return page


def template_elements(page: Page, template: frozenset[int]) -> list[bool]:
    """Of each element whether it and all above it are of the template."""
    out = [True]
    for k in range(1, len(page.path)):
        out.append(page.path[k] in template and out[page.parent[k]])
    return out


def slots(page: Page, inside: list[bool]) -> list[int]:
    """Of each element the path of the lowest template element that it is or stands in."""
    out = [0]
    for k in range(1, len(page.path)):
        out.append(page.path[k] if inside[k] else out[page.parent[k]])
    return out


def sibling_orders(page: Page, classes: dict[int, int]) -> dict[int, int]:
    """For the tokens of `classes` (token: class) on a page a hash of the order in which their class follows itself
    below their parent; 0 if it has no one order. A class that stands k times must repeat one order k times."""
    rows: dict[tuple[int, int], list[int]] = {}
    for parent, token in page.tokens:
        c = classes.get(token)
        if c is not None:
            rows.setdefault((page.path[parent], c), []).append(token)
    out: dict[int, int] = {}
    for row in rows.values():
        once = list(dict.fromkeys(row))
        m = len(once)
        fine = len(row) % m == 0 and all(row[k : k + m] == once for k in range(m, len(row), m))
        sign = _token(*map(str, once)) | 1 if fine else 0
        out.update(dict.fromkeys(once, sign))
    return out


def _weight(b: Block) -> int:
    return max(0, len(b.text) - 2 * b.link_chars)


def main_blocks(page: Page, template: frozenset[int], dense: frozenset[int] = frozenset(), marked_factor: int = 4, holds: float = 0.9) -> list[str]:
    """The blocks of the article's slots, in page order.

    1. Elements without text and furniture go with all that they hold; yet an element that only its tag or class calls
       furniture stays if it holds the share `holds` of the page's text outside links, text in a marked article
       (article or main element, or a class of that name) counting `marked_factor` times.
    2. Text of the template goes; inside marked articles it stays where it is more than half of them, as pages may be
       copies of one article.
    3. Marked articles are the main text if they, times `marked_factor`, weigh as much as all other slots. A main
       element keeps what stands in it beside an article; an article outside of it competes with it by weight.
    4. Else all slots that are left are, but for slots of links: those in `dense`, or on this page alone over half links.

    Each step that would leave no text at all is left out, but for the first.
    """
    inside = template_elements(page, template)
    n = len(page.path)
    # Text by element, summed up over what it holds; a parent comes before its children.
    held = [0] * n
    no_text = [False] * n
    for k in range(1, n):
        no_text[k] = no_text[page.parent[k]] or page.kind[k] == _NO_TEXT
    for b in page.blocks:
        if not no_text[b.element]:
            held[b.element] += _weight(b) * (marked_factor if page.rank[b.element] else 1)
    for k in range(n - 1, 0, -1):
        held[page.parent[k]] += held[k]
    gone = no_text
    for k in range(1, n):
        gone[k] = gone[k] or gone[page.parent[k]] or page.kind[k] == _FURNITURE and held[k] < holds * held[0] or page.kind[k] == _FURNITURE and not held[k]
    blocks = [b for b in page.blocks if not gone[b.element]]
    if not blocks:
        return []
    known = {id(b) for b in blocks if text_token(page.path[b.element], b.text) in template}

    def of(rank: int) -> list[Block]:
        return [b for b in blocks if page.rank[b.element] == rank]

    def total(some: list[Block]) -> int:
        return sum(_weight(b) for b in some)

    best = max(page.rank[b.element] for b in blocks)
    if best:
        if best == 3 and (articles := of(2)) and total(articles) > total(of(3)):
            best = 2
        marked = of(best)
        own = [b for b in marked if id(b) not in known]
        repeated = sum(len(b.text) for b in marked) - sum(len(b.text) for b in own)
        if 2 * repeated > sum(len(b.text) for b in marked):
            own = marked
        others = [b for b in blocks if page.rank[b.element] != best and id(b) not in known]
        if marked_factor * total(own) >= total(others):
            return [b.text for b in own]
        blocks = [b for b in blocks if id(b) not in known]
    else:
        blocks = [b for b in blocks if id(b) not in known] or blocks
    slot = slots(page, inside) if template else page.path
    chars: dict[int, list[int]] = {}
    for b in blocks:
        c = chars.setdefault(slot[b.element], [0, 0])
        c[0] += len(b.text)
        c[1] += b.link_chars
    linked = {s for s, (size, links) in chars.items() if s in dense or 2 * links > size}
    out = [b.text for b in blocks if slot[b.element] not in linked]
    return out or [b.text for b in blocks]


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def occurrences(pages: DataFrame) -> DataFrame:
    """Rows (host, page, token, n): how often a token stands on a page; tags and whole text blocks are tokens. Pages
    of a host with equal html are one page."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts, rows, tokens, counts = [], [], [], []
            for host, row, html in batch.itertuples(index=False, name=None):
                found: dict[int, int] = {}
                for _, t in parse(html).tokens:
                    found[t] = found.get(t, 0) + 1
                hosts += [host] * len(found)
                rows += [row] * len(found)
                tokens += found.keys()
                counts += found.values()
            yield pd.DataFrame({"host": hosts, "page": rows, "token": tokens, "n": counts})

    base = pages.select(F.xxhash64(host_of()).alias("host"), F.xxhash64("html").alias("page"), "html")
    found = base.mapInPandas(count, "host long, page long, token long, n long")
    return found.groupBy("host", "page", "token").agg(F.max("n").alias("n"))


def equal_vectors(pages: DataFrame, min_pages: int = 5, coverage: float = 0.6, min_size: int = 2) -> DataFrame:
    """Rows (host, tokens, classes): the tokens of a host that are in a class, and the number of each one's class.

    A token's occurrence vector over the host's distinct pages is held as its number of pages and an exclusive-or and a
    sum of hashes over (page, count), so it is gathered by partial aggregates and a host of any size needs no task of
    its own. Tokens with equal vectors are a class; it counts with `min_size` tokens or more that stand in `min_pages`
    pages or more and in `coverage` of the host's pages. So a host has at most 1 / coverage times the tokens of a mean
    page.
    """
    seen = occurrences(pages).withColumn("h", F.xxhash64("page", "n"))
    vectors = seen.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor("h").alias("x"), F.sum(F.shiftrightunsigned("h", 33)).alias("s"))
    vectors = vectors.where(F.col("pages") >= min_pages)
    total = pages.select(F.xxhash64(host_of()).alias("host"), F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("all_pages")).where(F.col("all_pages") >= min_pages)
    frequent = unplaced(vectors, "host").join(unplaced(total, "host"), "host").where(F.col("pages") >= coverage * F.col("all_pages"))
    classes = frequent.groupBy("host", "pages", "x", "s").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= min_size)
    named = classes.select("host", F.explode("tokens").alias("token"), F.xxhash64("pages", "x", "s").alias("class"))
    one = named.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("t"))
    return one.select("host", F.col("t.token").alias("tokens"), F.col("t.class").alias("classes"))


def _beside(pages: DataFrame, by_host: DataFrame, names: list[str], broadcast_tokens: int) -> DataFrame:
    """`pages` (page_id, url, html, host) with the row of their host; hosts without one have nulls. `by_host` is
    broadcast where its first array has at most `broadcast_tokens` members in all, counted first (some MB); else both
    sides are exchanged, so that a large host can be split."""
    held = by_host.agg(F.sum(F.size(names[0]))).first()[0] or 0
    known = F.broadcast(by_host) if held <= broadcast_tokens else unplaced(by_host, "host")
    base = pages.select("page_id", "url", "html", F.xxhash64(host_of()).alias("host"))
    return base.join(known, "host", "left").select("page_id", "url", "html", "host", *names)


class _ByHost(dict):
    """What was made of a host's arrays, kept while there are not too many."""

    def of(self, host: int, make):
        if host not in self:
            if len(self) > 4096:
                self.clear()
            self[host] = make()
        return self[host]


def templates(pages: DataFrame, broadcast_tokens: int = 200_000, **options) -> DataFrame:
    """Rows (host, template, dense): the tokens of the host's valid classes, and the slots that mostly hold links.

    A second look at the pages tells in what order the tokens of a class follow each other below their parent: tokens
    of a class that has another order on another page go. Nesting is checked where a template is used: only tags count
    whose parents count (`template_elements`); a text that each page repeats may stand in any element.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _ByHost()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for host, html, tokens, numbers in zip(batch["host"], batch["html"], batch["tokens"], batch["classes"], strict=True):
                if tokens is None:
                    continue
                classes = known.of(host, lambda t=tokens, c=numbers: dict(zip(t.tolist(), c.tolist(), strict=True)))
                page = parse(html)
                rows += [(host, t, s, 0, 0) for t, s in sibling_orders(page, classes).items()]
                slot = slots(page, template_elements(page, classes))
                chars: dict[int, list[int]] = {}
                for b in page.blocks:
                    c = chars.setdefault(slot[b.element], [0, 0])
                    c[0] += len(b.text)
                    c[1] += b.link_chars
                rows += [(host, s, None, size, links) for s, (size, links) in chars.items()]
            out = pd.DataFrame(rows, columns=["host", "token", "sign", "chars", "links"])
            yield out.astype({"sign": "Int64"})

    found = cut(equal_vectors(pages, **options))
    seen = _beside(pages, found, ["tokens", "classes"], broadcast_tokens).mapInPandas(look, "host long, token long, sign long, chars long, links long")
    one = seen.groupBy("host", "token").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    valid = F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != 0), F.col("token"))
    dense = F.when(2 * F.col("links") > F.col("chars"), F.col("token"))
    return one.groupBy("host").agg(F.collect_list(valid).alias("template"), F.collect_list(dense).alias("dense"))


def extract(pages: DataFrame, broadcast_tokens: int = 200_000, **options) -> DataFrame:
    """Rows (page_id, url, text), one for each row of `pages` (page_id, url, html; other columns are not looked at).

    text holds the article's blocks joined by blank lines: character references decoded, white space inside a block
    one space, nothing cut. Null and empty html and pages without an article give ''. Hosts of few pages have no
    template and go by slots of the page alone. Repeated rows, and pages of a host with equal html, count once for the
    template; each gets its row.
    """

    def text_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _ByHost()
        for batch in batches:
            texts = []
            for host, html, template, dense in zip(batch["host"], batch["html"], batch["template"], batch["dense"], strict=True):
                own = known.of(host, lambda t=template, d=dense: tuple(frozenset() if x is None else frozenset(np.asarray(x).tolist()) for x in (t, d)))
                texts.append("\n\n".join(main_blocks(parse(html), *own)))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})

    found = cut(templates(pages, broadcast_tokens, **options))
    return _beside(pages, found, ["template", "dense"], broadcast_tokens).mapInPandas(text_of, "page_id long, url string, text string")
