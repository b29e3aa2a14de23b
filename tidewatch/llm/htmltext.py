"""Main text of HTML pages by tag-path ratios.

A page is read once as a sequence of blocks, each with its path of block elements from the root. Per path, text length and
punctuation are summed over its blocks and divided by their number; the two ratios are smoothed along the page and fused, and paths
beneath the threshold fall away, as do paths of links. Elements that are never the article (scripts, forms, navigation, and elements whose
class, id or role names them as advert, notice, sidebar or comments) do not take part. The element that holds most of the selected
text is the article; blocks inside it that are short by nature, such as headings, belong to it with whatever their path scores.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMMENTS = r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
TOKEN = re.compile(rf"{_COMMENTS}|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
#: Where quotes do not close, a tag ends at the first `>`.
TAG_START = re.compile(r"</?[a-zA-Z]")
PLAIN_TOKEN = re.compile(rf"{_COMMENTS}|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PUNCTUATION = re.compile(r"[.,;:!?…。、，؟]")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is text up to their own end tag, whatever it looks like.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form dialog menu search select button fieldset object audio video canvas datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id names, between hyphens, underscores, spaces or changes of case.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promos promotion banner banners cookie "
    "cookies consent gdpr notice notices alert alerts nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer "
    "masthead topbar toolbar comment comments commentlist respond replies reply disqus share sharing social related recommended newsletter "
    "subscribe subscription popup modal overlay login signup search widget widgets pager pagination paging skip copyright legal paywall".split()
)
#: Words of such names that say nothing about the content.
PLAIN_WORDS = frozenset(
    "article block body bottom box card center col column container content group holder inline inner item items left link links list main "
    "middle page panel post posts row section site slot story text top under unit view wrap wrapper".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Hold a piece of text each; none of them is the article as a whole.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote caption figcaption address summary".split())
SCOPE = frozenset("ul ol dl table div section article body".split())


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if "=" not in attributes:
        return bool(re.search(r"(?i)\bhidden\b", attributes)) if attributes else False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if tag not in ("body", "html", "article", "main") and _is_telling(value, in_article):
                return True
        elif (name == "role" and value.lower() in ROLES) or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return bool(re.search(r"(?i)(?:^|\s)hidden(?:\s|/|$)", attributes))


def _is_telling(value: str, in_article: bool) -> bool:
    """Whether a class or id names boilerplate. Inside an article a name must say nothing else: `ad-box` does, `share-price` is about the text."""
    for name in value.split():
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if not HINTS.isdisjoint(words) and (not in_article or words <= HINTS | PLAIN_WORDS):
            return True
    return False


def _label(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    names = [a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() == "class"]
    return f"{tag}.{'.'.join(names[0].split())}" if names else tag


class _Block:
    """A block of text: its path (a number), the innermost element around it that may be the article (0: none), characters in links."""

    __slots__ = ("path", "node", "text", "linked")

    def __init__(self, path: int, node: int, text: str, linked: int):
        self.path, self.node, self.text, self.linked = path, node, text, linked


def _tokens(page: str) -> Iterator[tuple[int, re.Match]]:
    """(where the text before it begins, tag or comment), in time linear in the page: only one unclosed quote is ever looked for to the end."""
    at, look, pattern, last = 0, 0, TOKEN, page.rfind(">")
    while True:
        look = page.find("<", look)
        if look < 0 or (look > last and not page.startswith("<!--", look)):
            return
        token = pattern.match(page, look)
        if token is None and pattern is TOKEN and TAG_START.match(page, look):
            pattern = PLAIN_TOKEN
            token = pattern.match(page, look)
        if token is None:  # a `<` of the text
            look += 1
            continue
        skip = yield at, token
        at = look = token.end() if skip is None else skip


def blocks(page: str) -> tuple[list[_Block], list[int]]:
    """Blocks of a page outside boilerplate elements, and the parent of each numbered element; numbers grow in page order."""
    found: list[_Block] = []
    parents, paths = [0], {}
    stack: list[tuple[str, int, int, bool]] = []  # tag, path, number of the innermost element that may be the article, boilerplate
    opened: dict[str, int] = {}
    pieces: list[tuple[str, bool]] = []
    links, lost = 0, 0

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if text:
                linked = sum(len(" ".join(html.unescape(t).split())) for t, a in pieces if a)
                path, node = stack[-1][1:3] if stack else (0, 0)
                found.append(_Block(path, node, text, linked))
            pieces = []

    def close() -> str:
        nonlocal lost
        tag, _, _, bad = stack.pop()
        opened[tag] -= 1
        lost -= bad
        return tag

    tokens = _tokens(page)
    step, rest = next(tokens, None), 0
    while step is not None:
        begin, token = step
        rest, skip = token.end(), None
        if not lost and begin < token.start():
            pieces.append((page[begin : token.start()], links > 0))
        tag = (token[2] or "").lower()
        closing = token[1] == "/"
        if not tag:
            pass
        elif tag in RAW and not closing:
            if not token[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*+>", re.I).search(page, rest)
                rest = skip = end.end() if end else len(page)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            if pieces:
                pieces.append((" ", False))
        elif tag in VOID or (tag not in BLOCKS and tag not in NEVER):
            if tag == "hr":
                flush()
        elif closing:
            if opened.get(tag):
                flush()
                while close() != tag:
                    pass
                if not lost:
                    links = 0
            elif tag == "p":
                flush()
        else:
            flush()
            links = 0
            if tag == "body" and opened.get("head"):
                while stack and stack[-1][0] != "html":
                    close()
            if stack and stack[-1][0] == "p":
                close()
            if ends := CLOSES.get(tag):
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] not in SCOPE and stack[depth][0] not in ends:
                    depth -= 1
                if depth >= 0 and stack[depth][0] in ends:
                    while len(stack) > depth:
                        close()
            bad = _is_boilerplate(tag, token[3], bool(opened.get("article")))
            path, node = stack[-1][1:3] if stack else (0, 0)
            path = paths.setdefault((path, _label(tag, token[3])), len(paths) + 1)
            if tag not in LEAVES:
                parents.append(node)
                node = len(parents) - 1
            stack.append((tag, path, node, bad))
            opened[tag] = opened.get(tag, 0) + 1
            lost += bad
        try:
            step = tokens.send(skip)
        except StopIteration:
            step = None
    if not lost and rest < len(page):
        pieces.append((page[rest:], links > 0))
    flush()
    return found, parents


def _smoothed(values: list[float]) -> list[float]:
    """Along the page, neighbours counting half."""
    n = len(values)
    return [
        (2 * v + (values[i - 1] if i else v) + (values[i + 1] if i + 1 < n else v)) / 4 for i, v in enumerate(values)
    ]


def main_text(page: str | None, threshold: float = 0.2) -> str:
    """The main text of a page, one line per block; empty for NULL and for pages without text."""
    found, parents = blocks(page) if page else ([], [0])
    if not found:
        return ""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += b.linked
        s[3] += 1
    length = _smoothed([sums[b.path][0] / sums[b.path][3] for b in found])
    marks = _smoothed([sums[b.path][1] / sums[b.path][3] for b in found])
    fused: dict[int, list[float]] = {}
    for b, x, y in zip(found, length, marks):
        fused.setdefault(b.path, []).append(x * (1 + y))
    score = {p: sum(v) / len(v) * max(0.0, 1 - sums[p][2] / sums[p][0]) for p, v in fused.items()}
    total = sum(s[0] for s in sums.values())
    mean = sum(score[p] * sums[p][0] for p in score) / total
    chosen = {p for p in score if score[p] >= threshold * mean and 2 * sums[p][2] <= sums[p][0]}
    # The deepest element that holds nearly all selected text; what else it holds belongs to the article, but for blocks of links.
    weight, last = [0] * len(parents), list(range(len(parents)))
    for b in found:
        if b.path in chosen:
            weight[b.node] += len(b.text)
    weight[0] = 0
    for node in range(len(parents) - 1, 0, -1):
        if parents[node]:
            weight[parents[node]] += weight[node]
        last[parents[node]] = max(last[parents[node]], last[node])
    most = max(weight)
    if not most:
        return "\n".join(b.text for b in found if 2 * b.linked <= len(b.text))
    heavy = [0] * len(parents)
    for node in range(1, len(parents)):
        heavy[node] = heavy[parents[node]] + (weight[node] >= 0.9 * most)
    holder = max((b.node for b in found if b.path in chosen and b.node), key=heavy.__getitem__)
    while weight[holder] < 0.9 * most:
        holder = parents[holder]
    kept = [b for b in found if holder <= b.node <= last[holder] and (b.path in chosen or 2 * b.linked <= len(b.text))]
    return "\n".join(b.text for b in kept)


def extracted(page: Column) -> Column:
    def each(parts):
        for pages in parts:
            yield pd.Series([main_text(p) for p in pages], dtype="str")

    each.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "string")(page)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`, repeated rows included.

    NULL and empty html give an empty text of 0 characters. Broken markup is read as far as it goes: stray end tags are ignored,
    unclosed elements end with their parent. NULL ids and urls stay. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", extracted(pages["html"]).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
