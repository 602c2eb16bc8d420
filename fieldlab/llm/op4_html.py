"""Main text of web pages.

The standard library's parser streams events; they become lines, one for each block of text. Each line has
a text-to-tag ratio: its characters by the tags since the line before. The ratios are smoothed by a Gaussian
along the page, and clustered by a threshold, their standard deviation: lines above it are content. The
content lines choose the regions: the articles (or main elements) that hold any, else the innermost container
that holds most of their text, with the h1 that stands in an element around it. All lines of a chosen region
belong to the text, short ones too, but for those inside elements that are no article text: by tag, role or a
class or id that names nothing else (menus, footers, sidebars, adverts, forms, scripts, styles, reader
comments), or by a name that may be an article's own (header, notice, share ...) where the line's ratio isn't
above the threshold either. A name is a whole class or id: boilerplate words with no others than
structural ones, so `share-price` or `article-header` name nothing. Headings are never told by name. A form, or an
element of such a name, that wraps the page hides nothing (see Lines.visible). Cost is linear in the page, however
deep its elements are nested.

A line break inside a block is white space. Null, empty or text-free html gives an empty text. A comment or tag
that is cut off at the end is dropped. Repeated pages are treated alike; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import add_columns, table

#: Width of the Gaussian, in lines.
SIGMA = 1.5
#: Characters that the parser gets at once.
CHUNK = 1 << 16
#: Share of the content lines' text that a container must hold to be the region of a page without article or main.
HOLDS = 0.6

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
REGIONS = frozenset("article body div main section table tbody td tr".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Elements, roles and class words that hold no article text.
NO_TEXT = frozenset("aside button canvas dialog footer head iframe menu nav noscript object script select style svg template textarea".split())
NO_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NO_TEXT_NAMES = frozenset("ad adbox ads adsbygoogle adsense adslot adunit advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment commentform commentlist comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter outbrain pager pagination popup sidebar signup sponsor sponsored subscribe subscription taboola toolbar".split())
PERHAPS_NO_TEXT = frozenset("alert banner disclaimer header notice notification promo promoted promotion related replies reply share sharing social".split())
STRUCTURE = frozenset("area bar block body bottom box button buttons col column container content form global group icon icons inner item items left link links list main message outer overlay page panel primary reader right row secondary section site slot text thread title toggle top unit user widget wrap wrapper".split())
#: Words that say where a surely named element stands.
CONTEXT = frozenset("article articles blog desktop entry mobile post posts px size story wp x".split())
ARTICLE_NAMES = frozenset("ad ads advert advertisement comment comments promo reply sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


def named(known: dict) -> set[str]:
    """Boilerplate words of an element's classes and id, of those names that hold nothing else."""
    out: set[str] = set()
    for name in f"{known.get('class') or ''} {known.get('id') or ''}".split():
        found = {w.lower() for w in WORD.findall(name)}
        words = found & (NO_TEXT_NAMES | PERHAPS_NO_TEXT)
        about = STRUCTURE | CONTEXT if words & NO_TEXT_NAMES or "related" in words else STRUCTURE
        if words and found <= words | about:
            out |= words
    return out


class Line(NamedTuple):
    text: str
    tags: int  # since the line before
    region: int  # innermost open region, 0 if there's none
    veil: int  # innermost open element that hides its text unless it's the page's wrapper
    doubtful: bool  # inside an element that is perhaps no text
    heading: bool  # of the first level


class Open(NamedTuple):
    tag: str
    hides: bool
    perhaps: bool
    region: int  # its number, or 0
    veil: int


class Lines(HTMLParser):
    """Parser events as lines. Regions and veils are numbered from 1, with the number of the one around each; what a
    line or an element costs doesn't grow with the depth it stands at."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.opened: Counter[str] = Counter()
        self.hidden = self.doubtful = self.tags = 0
        self.regions, self.veils = [("", 0)], [("", 0, False)]  # tag and parent; kind, parent, and whether an article is inside
        self.inner_region, self.inner_veil = [0], [0]
        self.parts: list[str] = []
        self.lines: list[Line] = []

    def flush(self) -> None:
        if self.parts:
            if text := SPACE.sub(" ", "".join(self.parts)).strip():
                self.lines.append(Line(text, self.tags, self.inner_region[-1], self.inner_veil[-1], self.doubtful > 0, self.opened["h1"] > 0))
                self.tags = 0
            self.parts.clear()

    def pop_to(self, at: int) -> None:
        for x in self.open[at:]:
            self.hidden -= x.hides
            self.doubtful -= x.perhaps
            self.opened[x.tag] -= 1
            if x.region:
                self.inner_region.pop()
            if x.veil:
                self.inner_veil.pop()
        del self.open[at:]

    def close_first(self, tags: set[str], barriers) -> None:
        if not any(self.opened[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                return self.pop_to(i)
            if self.open[i].tag in barriers:
                return None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self.close_first({"p"}, BLOCKS - {"p"})
            if tag in CLOSED_BY_SIBLING:
                self.close_first(CLOSED_BY_SIBLING[tag], BARRIERS[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            hides, veils, perhaps = self.judged(tag, attrs)
            region = veil = 0
            if tag in REGIONS:
                region = len(self.regions)
                self.regions.append((tag, self.inner_region[-1]))
                self.inner_region.append(region)
            if tag in ("article", "main") and not veils:
                kind, around, _ = self.veils[self.inner_veil[-1]]
                self.veils[self.inner_veil[-1]] = (kind, around, True)
            if veils:
                veil = len(self.veils)
                self.veils.append(("form" if tag == "form" else "name", self.inner_veil[-1], False))
                self.inner_veil.append(veil)
            self.open.append(Open(tag, hides, perhaps, region, veil))
            self.opened[tag] += 1
            self.hidden += hides
            self.doubtful += perhaps

    def judged(self, tag: str, attrs) -> tuple[bool, bool, bool]:
        """Whether an element hides its text, whether it does unless it wraps the page, and whether it perhaps does."""
        if tag in NO_TEXT or tag == "header" and not self.opened["article"]:
            return True, False, False
        if tag in ("html", "body", "main"):
            return False, False, False
        known = dict(attrs)
        if "hidden" in known or known.get("role") in NO_TEXT_ROLES or known.get("aria-hidden") == "true" or "display:none" in (known.get("style") or "").replace(" ", ""):
            return True, False, False
        if tag == "form":
            return False, True, False
        if tag in HEADINGS or not ("class" in known or "id" in known):
            return False, False, False
        words = named(known)
        if tag == "article":
            return False, not words.isdisjoint(ARTICLE_NAMES), False
        if words.isdisjoint(NO_TEXT_NAMES):
            return False, False, bool(words)
        return tag not in BLOCKS, tag in BLOCKS, False  # what is within a line wraps no page

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if self.opened[tag]:
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag)
            self.pop_to(at)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def visible(self) -> list[Line]:
        """Lines that no veil hides; the tags of hidden ones count for the next.

        A veil that holds HOLDS of the page's text wraps the page, if it's a form, or has a heading of the first level; so
        does a form around an article.
        """
        size, headed = [0] * len(self.veils), [False] * len(self.veils)
        for x in self.lines:
            size[x.veil] += len(x.text)
            headed[x.veil] |= x.heading
        total, article = sum(size), [v[2] for v in self.veils]
        for i in range(len(self.veils) - 1, 0, -1):  # what is inside has larger numbers
            around = self.veils[i][1]
            size[around] += size[i]
            headed[around] |= headed[i]
            article[around] |= article[i] and self.veils[i][0] == "form"
        shown = [True] * len(self.veils)
        for i, (kind, around, _) in enumerate(self.veils[1:], 1):
            wraps = size[i] >= HOLDS * total and (kind == "form" or headed[i]) or kind == "form" and article[i]
            shown[i] = shown[around] and wraps
        out, tags = [], 0
        for x in self.lines:
            if shown[x.veil]:
                out.append(x._replace(tags=x.tags + tags))
                tags = 0
            else:
                tags += x.tags
        return out


def uncut(html: str) -> str:
    """Without a comment or tag that is cut off at the end."""
    comment = html.rfind("<!--")
    if comment >= 0 and html.find("-->", comment + 4) < 0:
        html = html[:comment]
    tag = html.rfind("<")
    if tag > html.rfind(">") and re.match(r"[A-Za-z/!?]", html[tag + 1 :]):
        html = html[:tag]
    return html


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def content(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines the threshold puts into the content cluster, and which are above it by themselves."""
    ratios = np.array([len(x.text) / max(1, x.tags) for x in lines])
    smooth = smoothed(ratios)
    threshold = min(smooth.std(), smooth.max())
    return smooth >= threshold, ratios >= threshold


def regions(lines: list[Line], is_content: np.ndarray, tree: list[tuple[str, int]]) -> set[int]:
    """Numbers of the elements whose lines are the main text."""
    weight, every, depth = [0] * len(tree), [0] * len(tree), [0] * len(tree)
    for line, yes in zip(lines, is_content, strict=True):
        weight[line.region] += len(line.text) if yes else 0
        every[line.region] += len(line.text)
    for n in range(len(tree) - 1, 0, -1):  # what is inside has larger numbers
        weight[tree[n][1]] += weight[n]
        every[tree[n][1]] += every[n]
    for n in range(1, len(tree)):
        depth[n] = depth[tree[n][1]] + 1
    for kind in ("article", "main"):
        own = [n for n in range(1, len(tree)) if tree[n][0] == kind]
        if content_own := {n for n in own if weight[n]}:
            return content_own
        if best := [n for n in own if every[n]]:
            return {max(best, key=lambda n: every[n])}
    holding = [n for n in range(1, len(tree)) if weight[n] and weight[n] >= HOLDS * weight[0]]
    return {max(holding, key=lambda n: depth[n])} if holding else set()


def main_text(html: str) -> str:
    """The article of a page, blocks joined by line feeds."""
    parser = Lines()
    html = uncut(html)
    for i in range(0, len(html), CHUNK):
        parser.feed(html[i : i + CHUNK])
    parser.close()
    parser.flush()
    lines, tree = parser.visible(), parser.regions
    if not lines:
        return ""
    is_content, above = content(lines)
    chosen = regions(lines, is_content, tree)
    inside, framed = [not chosen] * len(tree), [False] * len(tree)
    for n in range(1, len(tree)):
        inside[n] = not chosen or n in chosen or inside[tree[n][1]]
        framed[n] = tree[n][0] in ("article", "main") or framed[tree[n][1]]
    around: set[int] = set()  # what stands around a region that is no article
    for n in chosen:
        while n and not framed[n]:
            n = tree[n][1]
            around.add(n)
    return "\n".join(x.text for x, high in zip(lines, above, strict=True) if (inside[x.region] or x.heading and x.region in around) and (high or not x.doubtful))


def extract_text(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of each."""
    return add_columns(pages, html, f"{to} string", lambda: lambda raws: [[main_text(x.decode()) for x in raws]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
