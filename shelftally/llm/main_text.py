"""
Main text of web pages by tree scoring.

A page is read into a tree. Parts that are never article text are left out by their element,
role or name. Every remaining block of text passes points for its length and commas to its
ancestors, fewer the further up, discounted by the share of link text. The container with the
best score is kept, with the siblings that are prose or stand among it, and so on up the tree as
long as prose stands beside.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Set
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object xmp noembed".split())
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu canvas audio video".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center dd div html main section table tbody td tr ul ol dl fieldset details li blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Siblings that are part of an article where they are prose or follow some.
PARTS = HEADINGS | frozenset("p pre blockquote div section hgroup ul ol dl table figure details center main article".split())
#: An element that opens ends an open element of these kinds, up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in a class or id that mark something else than the article, also in its midst, unless
#: another class or the id names content.
NAMES_OUT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus dropdown footer login menu modal nav navbar navigation newsletter pagination pager popup promo promotion"
    " related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Compound words that do so too: what holds comments or adverts, and what an advert service names.
NAMES_OUT_LIKE = re.compile(
    r"(comment|reply|response|discussion|disqus)s?(area|body|box|container|form|item|list|section|stream|thread|tree|wrap|wrapper)"
    r"|ad(s|vert)?(bar|block|box|container|frame|holder|panel|rail|slot|space|tag|unit|wrap|wrapper|zone|s?by[a-z]+|sense)"
    r"|(cookie|consent|newsletter|promo|related|share|social|sponsor|subscribe)(bar|bars|block|box|buttons|form|links|list|posts|wrap|wrapper)"
)
#: Words that do so unless a word for content stands beside them.
NAMES_DOUBTFUL = frozenset(
    "alert discussion header masthead notice notices notification overlay reactions responses warning".split()
)
#: A heading that names the comments of readers.
COMMENTS = re.compile(
    r"\W*(\d+\s+|(all|reader|readers|user|latest|recent)\W*\s+)*(comments?|replies)(\s*\W?\d+\W?)?\W*"
    r"|\W*(leave|post|write|add) an? (comment|reply)\W*|\W*join the (conversation|discussion)\W*", re.I
)
#: A list or box in the article of so many links, which are nearly all its text, leads to other pages.
LEAST_LINKS = 3
LINK_SHARE = 0.8
BOXES = frozenset("ul ol dl div section table aside".split())
NAMES_CONTENT = frozenset("article blog body content entry main page post story text".split())
#: A class that begins so tells what a page has or is filed under, not what the element is.
NAMES_ABOUT = frozenset("category has no tag with without".split())
ROLES_OUT = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+")


#: Why an element is no part of an article: by what it is, or only by a name given to it.
_BY_KIND, _BY_NAME = 1, 2


def _left_out(name: str, rest: str) -> int:
    """Whether (not 0) and why an element is no part of an article, by its name and attributes."""
    if name in LEFT_OUT:
        return _BY_KIND
    if "=" not in rest and "hidden" not in rest.lower():
        return 0
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return _BY_KIND
    if name in ("html", "body", "main"):
        return 0
    if found.get("role", "").lower() in ROLES_OUT:
        return _BY_KIND
    if name == "article":
        return 0
    given = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')}\n{found.get('id', '')}".replace(" ", "\n")).lower()
    names = [w for w in map(_WORD.findall, given.split("\n")) if w and not (w[0] in NAMES_ABOUT and len(w) > 1)]
    words = {w for name in names for w in name}
    content = any(not NAMES_CONTENT.isdisjoint(name) and NAMES_OUT.isdisjoint(name) for name in names)
    if not content and any(NAMES_OUT_LIKE.fullmatch("".join(name)) or any(map(NAMES_OUT_LIKE.fullmatch, name)) for name in names):
        return _BY_NAME
    return _BY_NAME if words & NAMES_OUT and not content or words & NAMES_DOUBTFUL and not words & NAMES_CONTENT else 0


class Open:
    """The open elements, and at what depths those of each name are, so that none has to be looked for."""

    def __init__(self) -> None:
        self.nodes, self.names = [0], ["#page"]
        self.depths: dict[str, list[int]] = {}
        self.block_depths = [0]

    @property
    def top(self) -> int:
        return self.nodes[-1]

    def push(self, node: int, name: str) -> None:
        depth = len(self.nodes)
        self.depths.setdefault(name, []).append(depth)
        if name in BLOCKS:
            self.block_depths.append(depth)
        self.nodes.append(node)
        self.names.append(name)

    def pop_from(self, depth: int) -> list[int]:
        gone = self.nodes[depth:]
        for name in reversed(self.names[depth:]):
            self.depths[name].pop()
            if name in BLOCKS:
                self.block_depths.pop()
        del self.nodes[depth:], self.names[depth:]
        return gone

    def _deepest(self, names: Iterable[str]) -> int:
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)

    def nearest(self, kinds: set[str], borders: Set[str]) -> int:
        """The depth of the nearest open element of ``kinds`` if no border is nearer; else beyond all."""
        kind = self._deepest(kinds)
        border = self.block_depths[-1] if borders is BLOCKS else self._deepest(borders)
        return kind if kind and kind >= border else len(self.nodes)

    def to_close(self, name: str) -> int:
        """The depth that an end tag closes from. One of an inline element does not reach out of its block."""
        depth = self._deepest((name,))
        within = name in BLOCKS or depth > self.block_depths[-1]
        return depth if depth and within else len(self.nodes)


class Page:
    """A tree as arrays by node, parents before children, and the texts in page order."""

    def __init__(self, html: str):
        self.names, self.parents, self.out = ["#page"], [0], [False]
        self.blocks, self.links, self.why, self.inside = [0], [False], [0], [False]
        #: (node, text), or (node, None) where a block begins or ends.
        self.texts: list[tuple[int, str | None]] = []
        self._endless: set[str] = set()
        self._read(html)
        self._settle()

    def _open(self, name: str, parent: int, rest: str) -> int:
        node = len(self.names)
        self.inside.append(self.inside[parent] or name in ("article", "main"))
        why = _BY_KIND if name == "header" and not self.inside[parent] else _left_out(name, rest)
        out = self.out[parent] or why == _BY_KIND
        self.why.append(why)
        self.names.append(name)
        self.parents.append(parent)
        self.out.append(out)
        self.blocks.append(node if name in BLOCKS else self.blocks[parent])
        self.links.append(self.links[parent] or name == "a")
        return node

    def _ancestors(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self.parents[node]

    def _read(self, html: str) -> None:
        """One pass over the tags. Where tags end is known beforehand, so no search runs on to the end in vain."""
        stack, at = Open(), 0
        last = html.rfind(">")
        while at <= last or html.startswith("<!--", at):
            found = _TOKEN.search(html, at)
            if not found:
                break
            if found.start() > at:
                self.texts.append((stack.top, html[at : found.start()]))
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["close"]:
                self._cut(stack, stack.to_close(name))
                continue
            if name in BLOCKS:
                self._cut(stack, stack.nearest({"p"}, BLOCKS))
            if name in ENDS:
                self._cut(stack, stack.nearest(*ENDS[name]))
            node = self._open(name, stack.top, found["rest"])
            if name in BLOCKS:
                self.texts.append((node, None))
            if name in RAW:
                end = self._end_of(name, html, at)
                at = end
            elif name == "br":
                self.texts.append((node, " "))
            elif name not in VOID and not found["rest"].endswith("/") or name in BLOCKS - VOID:
                stack.push(node, name)
        if at < len(html):
            self.texts.append((stack.top, html[at:]))

    def _end_of(self, name: str, html: str, at: int) -> int:
        """Where an element of raw text ends; an end that is not there is looked for once."""
        if name in self._endless:
            return len(html)
        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
        if not end:
            self._endless.add(name)
        return end.end() if end else len(html)

    def _settle(self) -> None:
        """Leave out what has a name for it, but for a container of most of the page's text.

        That is one with over half of the text outside links and with the page's h1, article or
        main, or with over nine tenths; long comments alone are none.
        """
        if _BY_NAME not in self.why:
            return
        n = len(self.names)
        prose, head = [0] * n, [name in ("h1", "article", "main") for name in self.names]
        for node, text in self.texts:
            if text is not None and not self.out[node] and not self.links[node]:
                prose[node] += len(text.strip())
        for node in range(n - 1, 0, -1):
            above = self.parents[node]
            prose[above] += prose[node]
            head[above] |= head[node] and not self.out[node]
        for node in range(1, n):
            named = self.why[node] == _BY_NAME and not (2 * prose[node] > prose[0] and head[node] or 10 * prose[node] > 9 * prose[0])
            self.out[node] = self.out[node] or self.out[self.parents[node]] or named

    def _cut(self, stack: Open, depth: int) -> None:
        """Close the open elements from a depth on."""
        for node in stack.pop_from(depth):
            if self.names[node] in BLOCKS:
                self.texts.append((self.parents[node], None))

    # -- scores -------------------------------------------------------------------------

    def kept(self) -> list[bool]:
        """Which nodes belong to the main text, inherited by their children."""
        n = len(self.names)
        own, linked, commas = [0] * n, [0] * n, [0] * n
        for node, text in self.texts:
            if text is None or self.out[node]:
                continue
            block, size = self.blocks[node], len(text.strip())
            own[block] += size
            commas[block] += text.count(",")
            if self.links[node]:
                linked[block] += size
        total, link_total, comma_total, points = own[:], linked[:], commas[:], [0.0] * n
        for node in range(n - 1, 0, -1):
            total[self.parents[node]] += total[node]
            link_total[self.parents[node]] += link_total[node]
            comma_total[self.parents[node]] += comma_total[node]
        for block in range(1, n):
            if not own[block] or self.out[block]:
                continue
            gain = (0.5 + commas[block] + min(3.0, own[block] / 100)) * (1 - linked[block] / own[block])
            if self.names[block] in CONTAINERS:
                points[block] += gain
            share, above = 1.0, self.parents[block]
            while above and share > 1e-6:
                points[above] += gain * share
                share, above = share / 2, self.parents[above]
        score = [p * (1 - link_total[i] / total[i]) if total[i] else 0.0 for i, p in enumerate(points)]
        best = max((i for i in range(1, n) if not self.out[i] and self.names[i] in CONTAINERS), key=lambda i: (score[i], -i), default=0)
        if not best or score[best] <= 0:
            best = 0
        for above in self._ancestors(best):  # a part of an article stands for the whole of it
            if self.names[above] in ("article", "main"):
                best = above
        chosen = {best}
        if best:
            self._beside(best, chosen, total, link_total, comma_total, max(1.0, 0.2 * score[best]), score)
        apart = self._apart(chosen, total, link_total)
        kept = [not best] * n
        for i in range(1, n):
            kept[i] = (i in chosen or kept[self.parents[i]]) and not self.out[i] and i not in apart
        header, heading = [False] * n, [False] * n
        for i in range(1, n):  # of a header inside an article only headings are its text
            header[i] = header[self.parents[i]] or self.names[i] == "header"
            heading[i] = heading[self.parents[i]] or self.names[i] in HEADINGS
            kept[i] = kept[i] and (heading[i] or not header[i])
        return kept

    def _beside(self, best: int, chosen: set[int], total: list[int], links: list[int], commas: list[int], enough: float, score: list[float]) -> None:
        """Add to ``chosen`` what belongs to the article beside its best container and, where that is prose, beside its ancestors.

        Siblings are judged by all that is in them. Few links are under a quarter of the text.
        Before the first prose only headings of the page are taken; from there on all parts
        with few links, short ones, headings, lists and tables too. Beside an article or main
        element only prose and headings are taken, and nothing further up.
        """
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.names)):
            children.setdefault(self.parents[i], []).append(i)
        node, whole = best, self.names[best] in ("article", "main")
        while node:
            beside = [i for i in children[self.parents[node]] if i != node and not self.out[i] and total[i]]
            few = [i for i in beside if self.names[i] in PARTS and links[i] < 0.25 * total[i]]
            prose = {i for i in few if self.names[i] not in HEADINGS and commas[i] + total[i] / 100 >= 1}
            if node == best:
                chosen.update(i for i in beside if score[i] >= enough)
            elif not any(5 * total[i] >= total[node] for i in prose):
                node = self.parents[node]
                continue  # nothing of weight stands beside this ancestor
            chosen |= prose
            if not whole:
                first = min([node, *prose])
                chosen.update(i for i in few if i > first)
            chosen.update(i for i in few if self.names[i] in ("h1", "h2", "hgroup") and i < node)
            if whole:
                return
            node = self.parents[node]

    def _apart(self, chosen: set[int], total: list[int], links: list[int]) -> set[int]:
        """Parts inside what was chosen that are no article: boxes of links with their heading, and comments below one that names them."""
        n = len(self.names)
        n_links, spoken = [0] * n, [""] * n
        for i in range(n - 1, 0, -1):
            n_links[i] += self.names[i] == "a"
            n_links[self.parents[i]] += n_links[i]
        for node, text in self.texts:
            block = self.blocks[node]
            if text is not None and self.names[block] in HEADINGS and len(spoken[block]) < 100:
                spoken[block] += text
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            if total[i] and not self.out[i]:
                children.setdefault(self.parents[i], []).append(i)
        apart: set[int] = set()
        for parent, mine in children.items():
            for place, i in enumerate(mine):
                before = mine[place - 1] if place else 0
                if self.names[i] in BOXES and i not in chosen and n_links[i] >= LEAST_LINKS and links[i] >= LINK_SHARE * total[i]:
                    apart.add(i)
                    if self.names[before] in HEADINGS and self.names[before] != "h1":
                        apart.add(before)
                if self.names[i] in HEADINGS - {"h1"} and COMMENTS.fullmatch(spoken[i].strip()):
                    # what follows it, or the whole box that it heads
                    apart.update(mine[place:])
        return apart

    def text(self) -> str:
        kept, blocks, line = self.kept(), [], []

        def flush() -> None:
            whole = " ".join("".join(line).split())
            if whole:
                blocks.append(whole)
            line.clear()

        for node, text in self.texts:
            if text is None:
                flush()
            elif kept[node]:
                line.append(unescape(text) if "&" in text else text)
        flush()
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "html"):
        texts = [main_text(part.text(i).decode("utf-8", "replace")) for i in range(part.n)]
        columns = [part.rows.column(0), part.rows.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Blocks come in page order, one to a line, with character references decoded and white
    space made one space. Null or empty html, or a page without article text, gives an empty
    text. Null ids and urls and repeated rows come out as they went in; other columns are not
    read.
    """
    common.ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract, SCHEMA)
