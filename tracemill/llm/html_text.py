"""Main text of web pages by tag-path ratios.

A page is scanned once into elements and blocks of text; scripts, styles and other elements whose
text isn't shown are no text. For each tag path from the root the text length and the punctuation
of its blocks are added up; both ratios are smoothed over neighbouring blocks and fused by
multiplying, each block by the weight of the elements that it lies in. Paths above a multiple of
the standard deviation are content. The article is the smallest element that holds nearly all
content text (or the `<article>` around it); every remaining block inside it is returned, so short
headings and list items stay, and blocks that are mostly links go.

Weights. Elements that are menus, footers, forms, adverts, comments … by tag, role or class weigh
nothing, those with a vaguer class (`social`, `legal`, `search`) half. A name only counts if it says
what the element is: `article-footer` and `ad-box` do, `with-sidebar` and `legal-news` don't. An
element that holds most of the page's text is the page, whatever it is called, and weighs all.

Pages are independent, so this runs where the table is read and shuffles nothing; the scan is
linear in the page, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by how they treat text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q rp rt ruby s samp semantics small span strike strong sub sup time tt u "
    "var wbr br img input".split()
)
#: Elements whose text isn't shown, or is no text of the page; they stand inside of a block without ending it.
UNSEEN = frozenset("head template svg canvas object audio video select option optgroup button datalist annotation annotation-xml".split())
#: Elements that never are an article unless they hold most of the page.
ASIDE = frozenset("nav footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
HOLDERS = frozenset("html body main".split())
#: Elements that are a block of an article, never a whole one.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption summary address".split())
#: Start tags that end an open element of these kinds.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "body": ("head",),
}
#: A new one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("html body table td th article aside section main div ul ol dl button object template blockquote".split())
_LISTS = frozenset("ul ol dl table select html".split())
#: Words of class names and ids for what is no article; readers' comments; vaguer ones; and words that add nothing to those.
NOISE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr popup modal notice notices alert "
    "newsletter subscribe signup login pagination pager skip skiplink skipnav toolbar widget share sharing related recommended recommendations copyright disclaimer paywall".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies responses thread threads discussion discussions guestbook".split())
VAGUE = frozenset("social legal search aside foot overlay subscription promotion".split())
PLAIN = frozenset("box bar block list wrap wrapper container section area inner outer content item items link links text title form unit slot top bottom left right main page site global header body group panel row col column".split())
#: First words of names that say what else is on the page.
WITH = frozenset("with has no without hide is".split())
HEADERS = frozenset("header siteheader pageheader globalheader topheader mainheader".split())
_NAME = re.compile(r"[A-Z]{2,}(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: A path is content above so many standard deviations of the fused ratios; the article holds this share of content.
THRESHOLD = 0.4
SHARE = 0.95
#: A block with more of its text in links than this is not content, unless its path is.
LINKS = 0.5
#: What marks an element as, and how much a block in it weighs.
NOTHING, HEADER, SOME, NOISY, OTHERS = range(5)
WEIGHT = (1.0, 0.0, 0.5, 0.0, 0.0)


def named(names: str) -> int:
    """What class names or an id say of an element: NOTHING, HEADER, SOME (vague), NOISY, or OTHERS (comments of readers)."""
    found = NOTHING
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name) if len(w) > 1]
        if not words or words[0] in WITH:
            continue
        known = [OTHERS if w in COMMENTS else NOISY if w in NOISE else SOME if w in VAGUE else NOTHING for w in words]
        if "".join(words) in NOISE:
            found = max(found, NOISY)
        elif "".join(words) in HEADERS:
            found = max(found, HEADER)
        else:  # a name ends in what the thing is, but for words that any thing may have
            telling = [k for w, k in zip(words, known, strict=True) if k or w not in PLAIN]
            found = max(found, max(telling, default=NOTHING) if all(telling) else telling[-1])
    return found


def _kind(tag: str, attrs: dict[str, str]) -> int:
    if tag in ASIDE:
        return NOISY
    if tag == "header":
        return HEADER
    if tag in HOLDERS:
        return NOTHING
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return NOISY
    return max(named(attrs.get("class", "")), named(attrs.get("id", "")))


class Page:
    """Elements (number 0 is the page itself; an element has a larger number than those around it) and blocks of text, in page order."""

    def __init__(self) -> None:
        self.parent, self.tag, self.kind, self.path_of = [0], [""], [NOTHING], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.text: list[str] = []
        self.node: list[int] = []
        self.links: list[int] = []

    def add(self, parent: int, tag: str, attrs: dict[str, str]) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kind.append(_kind(tag, attrs))
        first = attrs.get("class", "").lower().split()[:1]
        key = (self.path_of[parent], ".".join([tag, *first]))
        self.path_of.append(self.paths.setdefault(key, len(self.paths) + 1))
        return len(self.parent) - 1


class _Scan:
    """The open elements while a page is read: each as (tag, number of its block element, whether its text is unseen)."""

    def __init__(self) -> None:
        self.page = Page()
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.at: dict[str, list[int]] = {}  # places of open elements by tag
        self.scopes: list[int] = [0]
        self.lists: list[int] = [0]
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.page.text.append(text)
                self.page.node.append(self.open[-1][1])
                self.page.links.append(self.linked)
            self.parts.clear()
        self.linked = 0

    def write(self, raw: str) -> None:
        if raw and not self.open[-1][2]:
            plain = html.unescape(raw)
            self.parts.append(plain)
            if self.at.get("a"):
                self.linked += len(plain.strip())

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        _, block, unseen = self.open[-1]
        k = len(self.open)
        if tag not in INLINE and tag not in UNSEEN and not unseen:
            block = self.page.add(block, tag, attrs)
        self.open.append((tag, block, unseen or tag in UNSEEN))
        self.at.setdefault(tag, []).append(k)
        if tag in _SCOPE:
            self.scopes.append(k)
        if tag in _LISTS:
            self.lists.append(k)

    def pop_to(self, k: int) -> None:
        """Close the element at place k and all inside of it."""
        while len(self.open) > k:
            tag, last = self.open.pop()[0], len(self.open)
            for places in (self.at.get(tag, ()), self.scopes, self.lists):
                if places and places[-1] == last:
                    places.pop()

    def close(self, kinds: tuple[str, ...], within: list[int]) -> None:
        """Close the innermost open element of these kinds, if nothing in `within` stands between (an element of both counts as itself)."""
        k = max((self.at[t][-1] for t in kinds if self.at.get(t)), default=0)
        if k and k >= within[-1]:
            self.flush()
            self.pop_to(k)


def scan(page: str) -> Page:
    """The elements and text blocks of a page."""
    s = _Scan()
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            s.write(page[at:])
            break
        if open_ > at:
            s.write(page[at:open_])
        follow = page[open_ + 1 : open_ + 2]
        if follow in ("!", "?"):
            comment = page.startswith("<!--", open_)
            end = page.find("-->" if comment else ">", open_ + 4 * comment)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        if follow == "/":
            end = page.find(">", open_)
            end = n if end < 0 else end
            words = page[open_ + 2 : end].split(None, 1)
            tag = words[0].lower() if words else ""
            at = end + 1
            places = s.at.get(tag)
            if tag in UNSEEN:
                if places:
                    s.pop_to(places[-1])
            elif tag in INLINE:
                # the block elements inside of an inline one end where they end
                if places and s.open[places[-1]][1] == s.open[-1][1]:
                    k = places.pop()
                    if k == len(s.open) - 1:
                        s.open.pop()
                    else:
                        s.open[k] = ("#closed", *s.open[k][1:])
            elif places:
                if not s.open[places[-1]][2]:
                    s.flush()
                s.pop_to(places[-1])
            continue
        letter = follow.isalpha() and follow.isascii()
        found = _TAG.match(page, open_) if letter and open_ < last else None
        if not found:
            if letter and (end := page.find(">", open_)) >= 0:
                at = end + 1  # a broken tag
            else:
                s.write("<")
                at = open_ + 1
            continue
        tag, at = found[1].lower(), found.end()
        if tag == "br":
            s.write(" ")
            continue
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(found[2])} if found[2].strip(" /") else {}
        if tag in RAW:
            end = _CLOSE[tag].search(page, at)
            at = n if not end else page.find(">", end.start()) + 1 or n
            continue
        if tag in VOID:
            if tag not in INLINE:
                s.flush()
            continue
        if s.at.get("head") and tag not in UNSEEN:
            s.pop_to(s.at["head"][-1])  # what isn't of the head ends it
        if tag not in INLINE and tag not in UNSEEN and not s.open[-1][2]:
            s.flush()
            if tag in ENDS_P:
                s.close(("p",), s.scopes)
            if tag in ENDS:
                s.close(ENDS[tag], s.lists)
            if tag in ("html", "body") and s.at.get(tag):
                continue
        if found[2].endswith("/") and (tag == "svg" or "-" in tag or tag in UNSEEN):
            continue  # such elements may close themselves
        s.push(tag, attrs)
    s.flush()
    return s.page


def _weights(page: Page, size: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Of each element, how much its blocks weigh."""
    n = len(page.parent)
    held = np.bincount(node, weights=size, minlength=n)
    prose = np.bincount(node, weights=np.where(size >= 80, size, 0), minlength=n)
    for k in range(n - 1, 0, -1):
        held[page.parent[k]] += held[k]
        prose[page.parent[k]] += prose[k]
    articles = np.bincount([page.parent[k] for k in range(1, n) if page.tag[k] == "article"], minlength=n)
    within = np.zeros(n, dtype=bool)
    weight = np.ones(n)
    headings = np.zeros(n, dtype=bool)  # inside of these, a header is that of an article
    for k in range(1, n):
        kind, up = page.kind[k], page.parent[k]
        within[k] = within[up] or page.tag[k] == "article"
        if page.tag[k] == "article" and kind != OTHERS and not within[up] and articles[up] == 1:
            kind = NOTHING  # a page's only article is one, whatever it is called
        if kind == HEADER and (headings[up] or page.tag[up] not in ("", "html", "body")):
            kind = NOTHING
        # readers may write more than the author: their comments are the page only if there is nothing else
        most = held[k] > 0.5 * held[0] if kind != OTHERS else prose[0] - prose[k] < 80
        weight[k] = weight[up] * (1.0 if most else WEIGHT[kind])
        headings[k] = headings[up] or page.tag[k] in ("article", "main")
    return weight


def content_of(page: Page) -> list[str]:
    """The blocks of the article."""
    if not page.text:
        return []
    node = np.array(page.node)
    size = np.array([len(t) for t in page.text], dtype=float)
    links = np.array(page.links, dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in page.text], dtype=float)
    of = np.unique(np.array(page.path_of)[node], return_inverse=True)[1]
    weight = _weights(page, size, node)[node]
    n = np.bincount(of)
    length, points = (np.bincount(of, weights=x) / n for x in (size, marks))
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), [0.25, 0.5, 0.25], mode="valid")
    fused = smooth(length[of]) * (1 + smooth(points[of])) * weight
    per_path = np.bincount(of, weights=fused) / n
    is_content = (per_path[of] >= THRESHOLD * fused.std()) & (fused > 0)
    held = np.bincount(node, weights=np.where(is_content, size, 0), minlength=len(page.parent))
    if not held.any():
        return [t for t, w in zip(page.text, weight, strict=True) if w == 1]
    for k in range(len(held) - 1, 0, -1):
        held[page.parent[k]] += held[k]
    whole = np.flatnonzero(held >= SHARE * held[0])
    article = next((int(k) for k in whole[::-1] if page.tag[k] not in PARTS), 0)  # the innermost has the largest number
    around = article
    while around and page.tag[around] != "article":
        around = page.parent[around]
    article = around or article
    inside = np.zeros(len(held), dtype=bool)
    inside[article] = True
    for k in range(article + 1, len(held)):
        inside[k] = inside[page.parent[k]]
    kept = inside[node] & (weight > 0) & (is_content | ((weight == 1) & (links <= LINKS * size)))
    # the title may stand before the article, or in a header outside of it: it does where the article has none
    first, level = np.array([page.tag[k] == "h1" for k in page.node]), np.array([page.tag[k] in ("h1", "h2") for k in page.node])
    before = np.arange(len(kept)) < np.argmax(kept)
    if not (kept & first).any() and (first & before & (weight == 1)).any():
        kept[np.flatnonzero(first & before & (weight == 1))[-1]] = True
    elif not (kept & level).any():
        kept[np.flatnonzero([page.tag[k] == "h1" and _in_header(page, k) for k in page.node])[:1]] = True
    return [page.text[i] for i in np.flatnonzero(kept)]


def _in_header(page: Page, k: int) -> bool:
    """Whether a heading stands in a header, next to no menu or other part that weighs nothing."""
    while k and page.kind[k] != HEADER:
        if page.kind[k]:
            return False
        k = page.parent[k]
    return bool(k)


def main_text(page: str | None) -> str:
    """The article of a page, a block a line; empty if it has none."""
    return "\n".join(content_of(scan(page or "")))


def _run(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [b.schema.names[0], "text"])


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, text): `row` holds df's columns but the html, text the article of each page.

    Null or empty html: empty text. Every row gives one row, repeats too. Empty table: empty result. Pages of any length
    and depth are read whole, in time that grows with their length.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != html_col))
    keyed = df.select(row.alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return keyed.mapInArrow(_run, keyed.select("row").schema.add("text", "string"))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
