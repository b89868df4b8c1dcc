"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page. Each line has a length, which counts the
characters of running text: text inside links counts nothing, and lines of parts that never belong
to an article are empty. The lengths are summed over a window of lines sliding down the page. The
text surges where a window's sum first passes a threshold taken from the page's own largest sum,
and dives where the windows run empty; the lines between a surge and its dive are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import per_batch, texts

WINDOW = 3
#: A surge begins at this share of the largest window sum, and at so many characters in any case.
SURGE, SURGE_CHARACTERS = 0.05, 80

# Element names by what they do to the text.
_DROPPED = frozenset(
    "nav footer aside form button select menu dialog script style noscript template svg iframe object canvas "
    "head title textarea option audio video annotation annotation-xml".split()
)
_RAW = frozenset("script style textarea title noscript template iframe".split())
_BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr "
    "html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article body div figure header html main section table".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role attributes of parts around an article.
_HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager "
    "pagination paywall popup promo promoted promotion related replies respond rss search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
# Those of them that mean text which an article may hold but that is no part of it, however long it is.
_FIRM_HINTS = frozenset(
    "ad ads advert advertisement adverts advertising comment comments commentlist consent cookie cookies disqus gdpr "
    "newsletter notice notices notification outbrain paywall promo promoted promotion replies respond sidebar signup "
    "sponsor sponsored subscribe subscription taboola".split()
)
# Words that may stand beside a hint word in a name without changing what it says.
_BESIDE_HINTS = frozenset(
    "area article articles bar block blog bottom box btn button buttons container content entry fixed global group icon "
    "icons inline inner item items js label left link links list main more outer page panel post posts primary right "
    "secondary section side site slot sticky story stories text title top unit wrap wrapper".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An element of these that the page never closes is not taken for all the rest of the page.
_OFTEN_UNCLOSED = frozenset("div section p span li ul".split())
_KEPT_WHATEVER_CLASS = frozenset("html body article main".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ARTICLE = re.compile(r"<(?:article|main)\b", re.IGNORECASE)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


def _is_around(name: str, attributes: str, in_article: int) -> bool:
    if name in _DROPPED:
        return True
    if name == "header" and not in_article:
        return True
    return bool(attributes) and name not in _KEPT_WHATEVER_CLASS and bool(_HIDDEN.search(attributes))


def _hint(name: str, attributes: str, in_article: int, strict: bool) -> str | None:
    """``firm`` or ``soft`` if a class, id or role suggests that the element is around the article.

    Any hint word in a name is firm evidence outside the article. If ``strict``, where text of the
    article may be, the whole name must say it (``comments-list``, not ``comments-on-method``), for
    a paragraph its class, and words that may also be a topic are soft. Headings are never hinted.
    """
    if not attributes or name in _KEPT_WHATEVER_CLASS or name in _HEADINGS:
        return None
    found = None
    for attribute in _NAMES.finditer(attributes):
        if strict and name == "p" and not attribute[0].lower().startswith("class"):
            continue
        for whole in (attribute[1] or attribute[2] or attribute[3] or "").split():
            words = {w.lower() for w in _NAME_WORDS.findall(whole)}
            if in_article and "header" in words or not words & _HINTS:
                continue
            if not strict or words & _FIRM_HINTS and words <= _HINTS | _BESIDE_HINTS:
                return "firm"
            if words <= _HINTS | _BESIDE_HINTS:
                found = "soft"
    return found


@dataclass
class _Hinted:
    """An open element with a hint word: how many of its name were open before, where it begins, and what it is in."""

    name: str
    before: int
    line: int
    in_article: int
    in_link: int
    soft: bool
    has_article: bool = False


def lines(page: str) -> list[tuple[str, int]]:
    """(text, length) of each line; an empty line where a container or a dropped part begins or ends.

    A hint word only suggests that an element is around the article: one that contains an article or
    main element stays, and so does one with the page's largest block sum if no article or main element
    has a block sum that counts beside it. The elements inside it are judged alone. A soft hint drops only
    what has no block of ``SURGE_CHARACTERS``, such as lists of links. What follows the last article goes if the
    page's largest remaining block sum is in an article.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    linked = 0  # characters of the line that are inside links
    in_link = in_article = 0
    opened: Counter[str] = Counter()  # elements of each name now open
    hinted: list[_Hinted] = []  # those now open, outermost first
    levels: dict[tuple[str, int], int] = {}  # place in ``hinted`` by name and by how many of it were open before
    around: list[tuple[int, int, bool]] = []  # closed hinted elements without an article: first line, end, soft or not
    articles: list[list[int]] = []  # first line and, once closed, line after the last
    has_articles = bool(_ARTICLE.search(page))

    def end_line(gap: bool = False) -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        if line:
            out.append((line, max(0, len(line) - linked)))
        text.clear()
        linked = 0
        if gap and out and out[-1][0]:
            out.append(("", 0))

    def close_hinted(level: int, whole: bool = True) -> None:
        """End the hinted elements from ``level`` on; one that the page never closes counts if it is ``whole``."""
        nonlocal in_link
        end_line(gap=True)
        for one in reversed(hinted[level:]):
            del levels[one.name, one.before]
            if not one.has_article and (whole or one.name not in _OFTEN_UNCLOSED):
                around.append((one.line, len(out), one.soft))
            in_link = one.in_link
        del hinted[level:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            decoded = html.unescape(raw) if "&" in raw else raw
            text.append(decoded)
            if in_link:
                linked += len(" ".join(decoded.split())) + 1

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            rest = page[at:]
            cut = rest.rfind("<")  # a tag that the page's end cuts off
            add(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest)
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1], tag[3]
        if not closing and _is_around(name, attributes, in_article):
            end_line(gap=True)
            if name not in _VOID and not attributes.rstrip().endswith("/"):
                at = _after(page, name, at)
            continue
        alone = name in _VOID or attributes.rstrip().endswith("/")
        hint = None if closing else _hint(name, attributes, in_article, bool(in_article) or not has_articles)
        if hint:
            end_line(gap=True)
            if alone:
                continue
            if name in _RAW:
                at = _after(page, name, at)
                continue
            levels[name, opened[name]] = len(hinted)
            hinted.append(_Hinted(name, opened[name], len(out), in_article, in_link, hint == "soft"))
        if closing and opened[name]:
            opened[name] -= 1
            if (name, opened[name]) in levels:
                close_hinted(levels[name, opened[name]])
        elif not closing and not alone:
            opened[name] += 1
        if name in ("article", "main", "body"):
            if closing:  # what opened inside and was not closed ends here
                inside = [i for i, one in enumerate(hinted) if one.in_article >= in_article > 0 or name == "body"]
                if inside:
                    close_hinted(inside[0])
            else:
                for one in reversed(hinted):
                    if one.has_article:
                        break
                    one.has_article = True
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            text.append(" ")
        elif name in _BLOCKS:
            end_line(gap=name in _CONTAINERS)
            in_link = 0
            if name in ("article", "main"):
                if not closing and not in_article:
                    articles.append([len(out)])
                elif closing and in_article == 1:
                    articles[-1].append(len(out))
                in_article = max(0, in_article + (-1 if closing else 1))
    end_line()
    if hinted:
        close_hinted(0, whole=False)
    return _without(out, around, [(a[0], a[-1] if len(a) > 1 else len(out)) for a in articles])


def _heart(lengths: list[int], sums: list[int]) -> int:
    """The longest line of the largest block; -1 if there are no lines."""
    most = max(range(len(sums)), key=sums.__getitem__, default=0)
    return max(range(most, min(most + WINDOW, len(lengths))), key=lengths.__getitem__, default=-1)


def _sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    return [sum(lengths[i : i + window]) for i in range(len(lengths))]


def _blank(found: list[tuple[str, int]], ranges: list[tuple[int, int]]) -> list[tuple[str, int]]:
    """All lines, those of the ranges empty."""
    change = [0] * (len(found) + 1)
    for first, end in ranges:
        change[first] += 1
        change[end] -= 1
    return [("", 0) if depth else line for line, depth in zip(found, accumulate(change))]


def _without(
    found: list[tuple[str, int]], around: list[tuple[int, int, bool]], articles: list[tuple[int, int]]
) -> list[tuple[str, int]]:
    """The lines outside of ``around``, and not after the last of ``articles`` if they hold the largest block.

    If no block sum of ``articles`` passes the threshold that the page's largest sets, or there are none and
    no other block has ``SURGE_CHARACTERS``, ranges with the longest line of that largest block stay. So do soft ranges with a block sum of ``SURGE_CHARACTERS``.
    """
    if not around and not articles:
        return found
    lengths = [n for _, n in found]
    sums = _sums(lengths)
    least = min(SURGE * max(sums, default=0), SURGE_CHARACTERS)
    heart = _heart(lengths, sums)
    inside = lambda first, end: max((sum(lengths[i : min(i + WINDOW, end)]) for i in range(first, end)), default=0)
    around = [(first, end) for first, end, soft in around if not (soft and inside(first, end) >= SURGE_CHARACTERS)]
    own = max((inside(first, end) for first, end in articles), default=0)
    beside = 0 if articles else max(_sums([n for _, n in _blank(found, around)]), default=0)
    if own and own >= least or beside >= SURGE_CHARACTERS:
        heart = -1
    left = _blank(found, [(first, end) for first, end in around if not (first <= heart < end and lengths[heart])])
    lengths = [n for _, n in left]
    heart = _heart(lengths, _sums(lengths))
    if heart >= 0 and lengths[heart] and any(first <= heart < end for first, end in articles):
        left = left[: max(end for _, end in articles)]
    kept: list[tuple[str, int]] = []
    for line in left:
        if line[0] or (kept and kept[-1][0]):
            kept.append(line)
    return kept


def _after(page: str, name: str, at: int) -> int:
    """Where the element ``name`` that opens before ``at`` ends.

    One that is never closed ends where the next article or main part, or its enclosing one, does.
    """
    if name in _RAW:
        close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
        return close.end() if close else len(page)
    depth, start = 1, at
    while tag := _TAG.search(page, at):
        at = tag.end()
        inner = (tag[2] or "").lower()
        if inner in _RAW and not tag[1] and inner != name:
            at = _after(page, inner, at)
        elif inner in ("article", "main", "body") and name not in ("article", "main"):
            return tag.start()
        elif inner == name and not tag[3].rstrip().endswith("/"):
            depth += -1 if tag[1] else 1
            if not depth:
                return at
    return len(page) if name not in _OFTEN_UNCLOSED else start


def main_lines(found: list[tuple[str, int]], window: int = WINDOW, surge: float = SURGE) -> list[str]:
    """The lines between surges and dives of the block distribution."""
    lengths = [n for _, n in found]
    sums = _sums(lengths, window)
    most = max(sums, default=0)
    if not most:
        return []
    least = min(surge * most, SURGE_CHARACTERS)
    kept, at = [], 0
    while at < len(found):
        if lengths[at] and sums[at] >= least:
            before = at
            while before and at - before < window and lengths[before - 1]:  # short lines that lead up to the surge
                before -= 1
            kept += [line for line, _ in found[before:at]]
            while at < len(found) and sums[at]:  # a dive: this line and the window after it are empty
                if found[at][0]:
                    kept.append(found[at][0])
                at += 1
        else:
            at += 1
    return kept


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space; empty for a null, empty or textless page."""
    return " ".join(main_lines(lines(page or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null ids and urls pass through, repeated rows are each extracted, an empty table gives no rows.
    Only the three named columns are read, so that others may have any name. A very long page is
    held whole by one task, with its lines; nothing of it is cut.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def of(columns):
        found = [main_text(page) for page in columns["text"]]
        return {"page_id": columns["page_id"], "url": columns["url"], "text": found, "n_chars": [len(t) for t in found]}

    ids = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")]
    source = texts(pages, *ids, text=html_col)
    return source.mapInArrow(per_batch(of, schema), "page_id long, url string, text string, n_chars long")
