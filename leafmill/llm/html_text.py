"""Operator 4: main text of web pages.

The standard library's parser streams events; text between block tags becomes a line with its count of
characters and tags.  The text-to-tag ratio per line is smoothed by a Gaussian, lines are clustered by a
threshold, runs of paragraphs and headings that touch the cluster join it, and the element that holds the cluster
is the content region: its lines are the article, short ones included.  Lines inside menus, headers, footers, sidebars,
notices, adverts, forms and reader comments never count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values: HTML element classes ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style noscript template head title svg math object iframe canvas audio video map select textarea button datalist".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
APART = frozenset("nav footer aside menu dialog search fieldset".split())
# what a head may hold; anything else begins the body
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot body html legend summary figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre".split())
REGION = frozenset("article main section div td body html".split())
# what an element of this kind ends when it begins
ENDS = {
    "li": ("li", frozenset("ul ol menu dir".split())),
    "dt": ("dt dd", frozenset(["dl"])),
    "dd": ("dt dd", frozenset(["dl"])),
    "tr": ("tr td th", frozenset("table tbody thead tfoot".split())),
    "td": ("td th", frozenset(["tr", "table"])),
    "th": ("td th", frozenset(["tr", "table"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# names of classes and ids, whole words between - _ and blanks
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense adslot sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets "
    "footer foot masthead topbar toolbar banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login paywall comment comments commentlist commentary respond reply replies "
    "disqus discussion share sharing social related recommended recommendations trending popular skip legal copyright "
    "colophon searchform search".split()
)
KEPT_TAGS = frozenset("html body main article".split())
# words beside a name that tell a state of the page ("has-sidebar", "sharing-enabled"), not what the element is
STATES = frozenset("has no not with without enabled disabled".split())
# ids that sections of papers and manuals have, too
SECTIONS = frozenset("commentary copyright discussion legal notice notices search".split())
# whole classes of an article that is a reader's comment
REMARKS = frozenset("comment reply".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def words_of(name: str) -> list[str]:
    return WORDS.findall(CAMEL.sub(" ", name).lower())


def apart(tag: str, attributes: dict[str, str | None], inside: bool) -> bool:
    """Whether an element stands beside the article.  ``inside``: an article is open, where a header is a part of it."""
    if tag in APART or (tag == "header" and not inside):
        return True
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style") or "", re.I):
        return True
    return tag not in KEPT_TAGS and (attributes.get("role") or "").lower() in ROLES


def named_apart(tag: str, attributes: dict[str, str | None]) -> bool:
    """Whether an element is called something beside the article, or is a form; ``way_back`` may overrule it.

    Ids of headings and sections are mostly made from the text of a heading: that of a heading silences nothing, and that
    of a section only where it has no other words.
    """
    classes, ids = (attributes.get("class") or "").split(), (attributes.get("id") or "").split()
    if tag in KEPT_TAGS:
        return tag == "article" and any(n.lower() in REMARKS for n in classes + ids)
    if tag == "form":
        return True
    section = tag == "section" or (tag == "div" and "section" in classes)
    for name in classes if section or tag in HEADINGS else classes + ids:
        words = words_of(name)
        if any(w in NAMES for w in words) and not any(w in STATES for w in words):
            return True
    return section and any(all(w in NAMES and w not in SECTIONS for w in words_of(i)) for i in ids if words_of(i))


class Lines(HTMLParser):
    """Lines of a page: text, tags, and the open elements around it; what stands apart is left out.

    ``released``: numbers of the elements that no name silences.
    """

    def __init__(self, released: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.released = released
        self.open: list[tuple[str, int, bool]] = []  # tag, number, stands apart or is silent
        self.number = 0
        self.parent: list[int] = [0]
        self.tag_of: list[str] = [""]
        self.kind_of: list[tuple[str, str | None]] = [("", None)]  # tag and class
        self.muted = 0
        self.named: set[int] = set()  # silenced by a name only
        self.held: dict[int, int] = {}  # characters right inside an element, silenced by a name or not
        self.marks: list[int] = []  # article, main and h1 elements that no tag or attribute silences
        self.hard = 0
        self.articles = 0
        self.at: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self.blocks: list[int] = []  # depths of the open blocks
        self.labels: set[int] = set()  # open headings whose id is a name
        self.links = 0
        self.prose = 0
        self.headings = 0
        self.linked: list[str] = []
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []  # text, tags, element
        self.is_prose: list[bool] = []  # a heading, or a paragraph that is not mostly links
        self.is_link: list[bool] = []
        self.is_heading: list[bool] = []
        self.is_label: list[bool] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            link = 2 * len(" ".join("".join(self.linked).split())) > len(text)
            self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0))
            self.is_link.append(link)
            self.is_prose.append(self.prose > 0 and (not link or self.headings > 0))
            self.is_heading.append(self.headings > 0)
            self.is_label.append(bool(self.labels))
            self.tags = 0
        self.text = []
        self.linked = []

    def _pop(self) -> None:
        tag, number, mute = self.open.pop()
        self.at[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        self.muted -= mute
        self.hard -= mute and number not in self.named
        self.articles -= tag in ("article", "main")
        self.links -= tag == "a"
        self.prose -= tag in PROSE
        self.headings -= tag in HEADINGS
        self.labels.discard(number)

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self._pop()

    def _depth(self, tags) -> int:
        """Depth of the innermost open element of these tags, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _end(self, tags: str, stop: frozenset) -> None:
        depth = self._depth(tags.split())
        if depth > self._depth(stop):
            self._pop_to(depth)

    def _leave_head(self, tag: str) -> None:
        """An open head ends where the body begins; its end tag may be left out."""
        if not self.at.get("head"):
            return
        if tag == "body" and not self.at.get("template") and not self.at.get("body"):
            self._pop_to(self.at["head"][0])
        elif self.open[-1][0] == "head" and tag not in IN_HEAD and tag not in ("head", "html"):
            self._pop()

    def handle_starttag(self, tag: str, attrs) -> None:
        self._leave_head(tag)
        if tag in BLOCK:
            self.flush()
        if tag in CLOSES_P:
            self._end("p", frozenset("td th li div article section body button table".split()))
        if tag in ENDS:
            self._end(*ENDS[tag])
        if not self.muted:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
        if tag in VOID:
            return
        self.number += 1
        attributes = dict(attrs)
        # an article inside an article is a reader's comment
        hard = tag in SILENT or apart(tag, attributes, self.articles > 0) or (tag == "article" and bool(self.at.get("article")))
        mute = hard or (self.number not in self.released and named_apart(tag, attributes))
        if mute and not hard:
            self.named.add(self.number)
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.tag_of.append(tag)
        self.kind_of.append((tag, attributes.get("class")))
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, self.number, mute))
        self.muted += mute
        self.hard += hard
        self.articles += tag in ("article", "main")
        self.links += tag == "a"
        self.prose += tag in PROSE
        self.headings += tag in HEADINGS
        if tag in HEADINGS and any(w in NAMES for w in words_of(attributes.get("id") or "")):
            self.labels.add(self.number)
        if not self.hard and tag in ("article", "main", "h1"):
            self.marks.append(self.number)

    def handle_startendtag(self, tag: str, attrs) -> None:
        # "<div/>" opens a div in HTML; only void elements end by themselves
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.muted:
            self.tags += 1
        depth = self._depth([tag])
        # an inline end tag never closes a block around it
        if depth < 0 or (tag not in BLOCK and tag not in SILENT and self.blocks and self.blocks[-1] > depth):
            return
        self._pop_to(depth)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._pop()
        if not self.hard:
            at = self.open[-1][1] if self.open else 0
            self.held[at] = self.held.get(at, 0) + len(data.strip())
        if not self.muted:
            self.text.append(data)
            if self.links:
                self.linked.append(data)

    def finish(self) -> None:
        self.close()
        self.flush()


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, renormalised at both ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def way_back(page: Lines) -> frozenset[int]:
    """Elements that their name must not silence: those around the article, its h1 or most of the page's text.

    Names stand where an article outside them has text.  If else hardly any text is left, no name silences.
    """
    if not page.named:
        return frozenset()
    count = len(page.parent)
    above = [0] * count  # the innermost named element around an element, itself included; 0 if there is none
    for element in range(1, count):
        above[element] = element if element in page.named else above[page.parent[element]]
    gross, free = [0] * count, [0] * count
    for element, size in page.held.items():
        gross[element] = size
        free[element] = 0 if above[element] else size
    for element in range(count - 1, 0, -1):
        gross[page.parent[element]] += gross[element]
        free[page.parent[element]] += free[element]
    articles = [e for e in page.marks if page.tag_of[e] != "h1"]
    total = gross[0]
    if any(not above[e] and free[e] >= min(200, max(1, total // 50)) for e in articles):
        return frozenset()
    titles = [e for e in page.marks if page.tag_of[e] == "h1" and gross[e]]
    titled = any(not above[e] for e in titles)
    wanted = [e for e in page.named if gross[e] > (0.9 if titled else 0.5) * total]
    if not titled:
        wanted += titles + (articles if 2 * free[0] < total else [])
    # what is released is open only if all around it is
    released: set[int] = set()
    for element in wanted:
        element = above[element]
        while element and element not in released:
            released.add(element)
            element = above[page.parent[element]]
    left = sum(size for e, size in page.held.items() if not above[e] or above[e] in released)
    return frozenset(page.named if not titled and 10 * left < total else released)


def trimmed_runs(cluster: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The cluster without the lines at the ends of its runs that only their neighbours have carried over the threshold."""
    sides = []
    for step in (1, -1):
        side, met = cluster.copy(), False
        for k in range(len(cluster))[::step]:
            met = bool(cluster[k]) and (met or bool(strong[k]))
            side[k] = met
        sides.append(side)
    return sides[0] & sides[1]


def joined_runs(cluster: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """The cluster with every run of prose lines that touches or holds a line of it."""
    out = cluster.copy()
    for step in (1, -1):
        run = False
        for k in range(len(out))[::step]:
            run = bool(out[k]) or (run and bool(prose[k]))
            out[k] = run
    return out


def main_text(html: str, sigma: float = 1.0, share: float = 1.0) -> str:
    """Blocks of the content region in page order, joined by two line ends; empty if there is none.

    ``sigma`` is the width of the smoothing in lines; lines whose smoothed ratio exceeds the standard
    deviation of all ratios are the content cluster, lines of links are not, nor are lines at its ends that only their
    neighbours lift over it; paragraphs and headings next to it join it, and so does a line that exceeds it by its own ratio
    in a sibling of the same kind (tag and class) as the element of a line of it.  The
    region is the innermost article, main, section, div, cell or body that holds ``share`` of the characters of those lines.
    Containers without a line of the cluster at its two ends are menus, head and foot lines and left out, unless it is an
    article or they hold other lines than links and are of the kind (tag and class) of its content.  A heading whose id is a name ("comments") is left out where no text comes under it.
    """
    page = Lines()
    page.feed(html)
    page.finish()
    released = way_back(page)
    if released:
        page = Lines(released)
        page.feed(html)
        page.finish()
    if not page.lines:
        return ""
    sizes = np.array([len(text) for text, _, _ in page.lines], float)
    ratio = sizes / np.array([max(1, tags) for _, tags, _ in page.lines])
    smooth = smoothed(ratio, sigma)
    link = np.array(page.is_link)
    prose = np.array(page.is_prose)
    cluster = (smooth >= np.std(smooth)) & ~link
    content = joined_runs(trimmed_runs(cluster, prose | (ratio >= np.std(smooth))), prose)
    if not content.any():
        content = cluster
    if not content.any():
        content[:] = True
    # lines that pass by their own ratio, though short neighbours pull them down, right beside a content line
    spot = [(page.parent[e], page.kind_of[e]) for _, _, e in page.lines]
    taken = {at for at, is_content in zip(spot, content, strict=True) if is_content}
    content |= (ratio >= np.std(smooth)) & ~link & np.array([at in taken for at in spot])
    # characters of the content cluster inside every element
    held = [0.0] * len(page.parent)
    for (_, _, element), size, is_content in zip(page.lines, sizes, content, strict=True):
        if is_content:
            held[element] += size
    for element in range(len(held) - 1, 0, -1):
        held[page.parent[element]] += held[element]
    region = 0
    for element in range(1, len(held)):
        # elements are numbered in page order, so a later one that holds enough lies inside the earlier ones
        if page.tag_of[element] in REGION and held[element] >= share * held[0]:
            region = element
    # an article or main around the region is the whole article
    above, article = region, False
    while above:
        if page.tag_of[above] in ("article", "main"):
            region, article = above, True
        above = page.parent[above]
    # the child of the region that an element lies in
    part = [-1] * len(page.parent)
    part[region] = region
    for element in range(region + 1, len(part)):
        around = part[page.parent[element]]
        part[element] = element if around == region else around
    lines = [(text, part[e], k) for k, (text, _, e) in enumerate(page.lines) if part[e] >= 0]
    if not article:
        kinds = {page.kind_of[p] for _, p, _ in lines if held[p]}
        mixed = {p for _, p, k in lines if not link[k] and page.kind_of[p] in kinds}
        beside = {p for _, p, _ in lines if p != region and not held[p]} - mixed
        while lines and lines[0][1] in beside:
            del lines[0]
        while lines and lines[-1][1] in beside:
            lines.pop()
    after = [k for _, _, k in lines[1:]] + [-1]
    lines = [line for line, k in zip(lines, after, strict=True) if not page.is_label[line[2]] or (k >= 0 and not page.is_heading[k])]
    return "\n\n".join(text for text, _, _ in lines)


RESULT = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame, sigma: float = 1.0, share: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.  A null or empty html gives the empty text; repeated rows are
    extracted each; other columns are not read.  No shuffle; a task holds one page and a batch of texts.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [main_text(h or "", sigma, share) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(pages["page_id"].cast("long"), "url", "html").mapInArrow(extract, RESULT)
