"""Main text of web pages by tag-path ratios.

Every text node has a path of tags (with their classes) from the root. Text length and punctuation
are summed by path and divided by the path's nodes; both ratios are smoothed over neighbouring
paths in page order, fused, and the paths whose fused ratio reaches a share of the page's own
(its mean, weighted by text) are content. Blocks with a node of a content path are the main text,
with the headings, short paragraphs, lists and tables that stand among them and aren't links.
The ratios of the whole page come first. Reader comments and other parts that classes, ids and roles
name go if enough content is left without them; then main and article elements bound the text if
they hold most of the content, and the ratios are those inside them. Small articles beside a larger
one, or beside text of its own, are teasers.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import whole_text
from inkweave.session import read_table

#: A path is content from this share of the page's mean fused ratio on; smoothing weights of a path and its two neighbours; the
#: share of links from which a block is a menu.
THRESHOLD, SMOOTHING, LINKED = 0.25, (0.15, 0.7, 0.15), 0.5
#: Elements by kind.
RAW = "script style textarea title xmp iframe noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style noscript template svg math iframe object embed canvas audio video nav footer aside form button select option textarea input label fieldset menu dialog noembed noframes xmp".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks that belong to the text around them though their own paths are short.
AMONG = HEADINGS | INLINE | frozenset("p pre blockquote ul ol dl li dt dd table caption figure figcaption address details summary hr center".split())
#: A start tag ends an open element of these, if no element of the others stands between.
ENDS = {
    "p": ({"p"}, {"table", "td", "th", "caption", "button", "object"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Shares: of the content that must be left for parts named by a word that stands for them alone, and by others, to go; of the
#: largest article's content (or of that outside articles) that an article of its own holds.
WITHOUT_SURE, WITHOUT_OTHERS, ARTICLE_OF_ITS_OWN = 0.05, 0.34, 0.1
#: A start tag of these ends the element it points to: those of ENDS, and a p for any other block (which no block may part from it).
RULES = [("", {"p"}, ENDS["p"][1] | BLOCKS - {"p"}), *[(tag, *ENDS[tag]) for tag in ("p", "li", "dt", "tr", "td", "option")]]
RULE_OF = {tag: next(k for k, (_, closes, stops) in enumerate(RULES) if k and (closes, stops) == rule) for tag, rule in ENDS.items()}
RULED = BLOCKS.union(*[closes | stops for _, closes, stops in RULES])
#: Words in an element's class, id or role that name it as no part of an article, and words before them that take this back. A name
#: of several words names such a part if the others are furniture, or if it ends in a word that stands for a part alone.
OTHER_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header "
    "masthead teaser teasers comment comments disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended pagination pager toolbar widget complementary contentinfo dialog form".split()
)
ALONE = frozenset("comment comments disqus replies respond ad ads advert adverts nav navbar breadcrumb breadcrumbs sidebar footer cookie cookies newsletter pagination teaser teasers".split())
FURNITURE = frozenset(
    "area article bar block blog body bottom box btn button buttons card cards close col column container content count desktop entry fixed group id info inner item items js label large left line link "
    "links list main message meta mobile module outer page pane panel policy post posts primary prompt reader right row secondary section site slot small sticky story stories text thread tile title toggle top "
    "tools unit user view wide wrap wrapper".split()
)
TAKEN_BACK = frozenset("has with without no not is".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
PUNCTUATION = re.compile(r"[,.;:!?，。；：！？、…]")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>")
#: The same where a quote is never closed.
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLANK = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """key is a number that elements with the same path share; other says whether a name in it or above sets it aside (as
    part_of has it), linked and titled whether a link or heading is it or above, tops holds the outermost article and main,
    ends for each of RULES the element that such a start tag would end here, or None."""

    __slots__ = ("tag", "label", "parent", "key", "dropped", "other", "tops", "linked", "titled", "ends")

    def __init__(self, tag: str, label: str, parent: Element | None, key: int, dropped: bool, other: int):
        self.tag, self.label, self.parent, self.key, self.dropped, self.other = tag, label, parent, key, dropped, other
        self.ends = parent.ends if parent else (None,) * len(RULES)
        if tag in RULED:
            self.ends = tuple(self if tag in closes else None if tag in stops else old for (_, closes, stops), old in zip(RULES, self.ends, strict=True))
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.titled = tag in HEADINGS or (parent is not None and parent.titled)
        self.tops = parent.tops if parent else {}
        if tag in ("article", "main") and tag not in self.tops:
            self.tops = self.tops | {tag: self}

    @property
    def path(self) -> str:
        labels, up = [], self
        while up is not None:
            labels.append(up.label)
            up = up.parent
        return "/".join(reversed(labels))


@lru_cache(1 << 14)
def part_of(name: str) -> int:
    """Whether a class, id or role names another part than the article: 2 by a word that stands for one alone, 1 by others, 0 if not."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[0] in TAKEN_BACK or OTHER_PARTS.isdisjoint(words):
        return 0
    if words[-1] not in ALONE and any(w not in OTHER_PARTS and w not in FURNITURE for w in words):
        return 0
    return 1 + (not ALONE.isdisjoint(words))


def _read(tag: str, attributes: str, inside: bool) -> tuple[str, bool, int]:
    """(label in the path, whether the element is no text of an article by its kind, whether a name says so)."""
    dropped, other, label = tag in DROPPED or (tag == "header" and not inside), 0, tag
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            dropped = True
        if name == "class" and value.split():
            label = f"{tag}.{'.'.join(sorted(value.split()))}"
        if name in ("class", "id", "role") and tag not in ("html", "body", "main") and (tag != "header" or not inside):
            other = max(other, *map(part_of, value.split())) if value.split() else other
    return label, dropped, other


def text_nodes(page: str) -> list[tuple[Element, int, str]]:
    """(element, number of its block, decoded text) of each text node that isn't of an element set aside by its kind.

    Linear in the page, whatever is left open in it: a tag without an end is text.
    """
    root = Element("", "", None, 0, False, 0)
    paths: dict[tuple[int, str], int] = {}
    at, begin, here, blocks, out = 0, 0, root, 0, []
    is_open: dict[str, int] = {}  # how many elements of a tag are above or here
    last, pattern = page.rfind(">"), TAG

    def leave(closed: Element) -> Element:
        """Close all elements up to this one; what was around it."""
        up = here
        while up is not closed.parent:
            is_open[up.tag] -= 1
            up = up.parent
        return up

    def add(raw: str) -> None:
        if raw and not here.dropped and (text := html.unescape(raw)):
            out.append((here, blocks, text))

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            add(page[begin:at])
            end = page.find("-->", at + 2)
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        if at > last:
            break
        m = pattern.match(page, at)
        if m is None and pattern is TAG and page[at + 1 : at + 2].isalpha():
            pattern = LOOSE_TAG  # a quote stays open to the end: it does for every later tag, too
            m = pattern.match(page, at)
        if m is None:
            at += 1
            continue
        add(page[begin:at])
        at = begin = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if is_open.get(tag):
                up = here
                while up.tag != tag:
                    up = up.parent
                if tag in BLOCKS:
                    blocks += 1
                here = leave(up)
            elif tag == "p":
                blocks += 1
            continue
        if tag in BLOCKS:
            blocks += 1
            if ended := here.ends[RULE_OF.get(tag, 0)]:
                here = leave(ended)
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        raw = tag in RAW
        if not (raw or m[3].rstrip().endswith("/") and tag not in BLOCKS):
            label, dropped, other = _read(tag, m[3], bool(here.tops))
            key = paths.setdefault((here.key, label), len(paths) + 1)
            is_open[tag] = is_open.get(tag, 0) + 1
            here = Element(tag, label, here, key, here.dropped or dropped, max(here.other, other))
        if raw:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, last + 1)
            at = begin = end.end() if end else len(page)
    add(page[begin:])
    return out


def content_keys(nodes: list[tuple[Element, int, str]]) -> set[int]:
    """The keys of the paths whose smoothed and fused ratios reach the threshold."""
    seen: dict[int, list[float]] = {}
    for element, _, text in nodes:
        if bare := len(text.strip()):
            sums = seen.setdefault(element.key, [0.0, 0.0, 0.0])
            sums[0] += bare
            sums[1] += len(PUNCTUATION.findall(text))
            sums[2] += 1
    if not seen:
        return set()
    sums = np.array(list(seen.values()))
    logs = np.log(np.stack([sums[:, 0] / sums[:, 2], 1 + sums[:, 1] / sums[:, 2]], axis=1))
    padded = np.pad(logs, ((1, 1), (0, 0)), mode="edge")
    smooth = sum(w * padded[k : k + len(logs)] for k, w in enumerate(SMOOTHING))
    fused = np.exp(smooth.sum(axis=1))
    least = THRESHOLD * (fused * sums[:, 0]).sum() / sums[:, 0].sum()
    return {p for p, f in zip(seen, fused, strict=True) if f >= least}


def content_paths(nodes: list[tuple[Element, int, str]]) -> set[str]:
    """The paths themselves."""
    keys = content_keys(nodes)
    return {element.path for element, _, _ in nodes if element.key in keys}


def _content(nodes: list[tuple[Element, int, str]], keys: set[int]) -> int:
    return sum(len(text.strip()) for element, _, text in nodes if element.key in keys)


def without_named(nodes: list[tuple[Element, int, str]]) -> list[tuple[Element, int, str]]:
    """The nodes without what its names set aside, if enough content is left without it."""
    for level, share in ((2, WITHOUT_SURE), (1, WITHOUT_OTHERS)):
        plain = [n for n in nodes if n[0].other < level]
        if len(plain) < len(nodes) and _content(plain, content_keys(plain)) > share * _content(nodes, content_keys(nodes)):
            nodes = plain
    return nodes


def in_marked(nodes: list[tuple[Element, int, str]]) -> tuple[list[tuple[Element, int, str]], bool]:
    """The nodes inside main, and of these the nodes inside articles, if these hold most of the content; whether either does.

    Articles that hold little beside the largest, or beside the content around them, go in any case.
    """
    marked = False
    for tag in ("main", "article"):
        keys = content_keys(nodes)
        own: dict[Element, int] = {}
        for n in nodes:
            if top := n[0].tops.get(tag):
                own[top] = own.get(top, 0) + _content([n], keys)
        inside = sum(own.values())
        around = _content(nodes, keys) - inside
        if tag == "article":
            least = ARTICLE_OF_ITS_OWN * max([around, *own.values()])
            small = {top for top, size in own.items() if size < least or not size}
            nodes = [n for n in nodes if n[0].tops.get(tag) not in small]
        if inside > around:
            nodes, marked = [n for n in nodes if tag in n[0].tops], True
    return nodes, marked


def main_nodes(page: str) -> list[tuple[Element, int, str]]:
    """The text nodes of a page's main text."""
    nodes, marked = in_marked(without_named(text_nodes(page)))
    keys = content_keys(nodes)
    if not keys:
        return []
    chosen = {block for element, block, text in nodes if element.key in keys and text.strip()}
    if not chosen:
        return []
    first, last = min(chosen), max(chosen)
    holding: set[Element] = set()
    for element, block, _ in nodes:
        if block in chosen:
            up = element
            while up is not None and up not in holding:
                holding.add(up)
                up = up.parent
    # what holds no chosen block goes by its branch, the largest element around it that doesn't either
    branch: dict[Element, Element] = {}
    texts: dict[Element, list[int]] = {}
    for element, block, text in nodes:
        if block not in chosen:
            up, chain = element, []
            while up not in holding and up not in branch and up.parent is not None and up.parent not in holding:
                chain.append(up)
                up = up.parent
            top = branch.get(up, up)
            for e in (*chain, up):
                branch[e] = top
            sums = texts.setdefault(top, [0, 0, 0])
            n = len(text.strip())
            for k, yes in enumerate((True, element.linked, element.titled)):
                sums[k] += n * yes

    def belongs(element: Element, block: int) -> bool:
        top = branch[element]
        n, linked, titled = texts[top]
        if n and titled == n:
            return True
        among = top in holding or top.tag in AMONG
        beside = top.tag in ("p", "pre", "blockquote") and top.parent is not None and top.parent.tag not in ("", "html", "body")
        return among and linked < LINKED * max(n, 1) and (marked or beside or first < block < last)

    return [n for n in nodes if n[1] in chosen or belongs(n[0], n[1])]


def main_text(page: str | None) -> str:
    """The blocks of a page's article, joined by newlines; empty if it has none."""
    out: list[list] = []
    for _, block, text in main_nodes(page or ""):
        if out and out[-1][0] == block:
            out[-1][1].append(text)
        else:
            out.append([block, [text]])
    lines = (BLANK.sub(" ", "".join(parts)).strip() for _, parts in out)
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of pages; n_chars counts code points.

    Null and empty pages, and pages without content, have an empty text. Rows without an id or
    address and repeated rows stay as they are. Pages are read whole, broken markup included;
    an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), whole_text(pages[html_col]).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op1_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")


QUERIES = {"op1_html_tag_paths": op1_html_tag_paths}
ORACLES: dict[str, str] = {}
