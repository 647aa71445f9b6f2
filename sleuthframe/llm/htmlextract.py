"""HTML main-text extraction with consensus host paths.

Pages of a host share a template, so the place of the article is voted on.  Each page's
containers are scored (text, less links, more for article elements); a container's path is
the tag and classes of itself and its ancestors with numbers generalised; votes are summed
by (host, path) in Spark, and every page is extracted anew from the winning path of its host.
A page without that path falls back to the path of its own best container.  All containers
at the path are the article, which adverts may have cut into parts.

Names mark what isn't the article with care.  A class, id or role that says nothing else
(``sidebar-left``) is a mark; one that says more (``search-engines``, ``article-social``), or that
stands beside an article's name, counts only where the element doesn't hold most of the page's
text.  If hardly any text is left, the one named element that holds nearly all of it is
the article.  Parts beside the chosen container (a lead) that hold text without links belong to it.

Pages are hostile input: each is read once from left to right.  As in browsers, elements
deeper than ``DEPTH`` count as siblings, but keep what marks those that they stand in; a long path is kept as a digest; closing tags of
elements whose content is passed over are paired once a page, and an element that is never
closed drops nothing (but for scripts, styles and text areas, whose text is no markup).

Scale: the first pass emits a few short rows a page, which are pre-aggregated before the
shuffle, so a host with a third of all pages is a few rows a task.  Winners are one row a
host: broadcast under a checked bound, otherwise joined by shuffle with adaptive skew splits.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .urlfilter import host

BROADCAST_HOSTS = 50_000
#: A container votes if its score is this share of its page's best.
VOTE_SHARE = 0.5
#: Share of its text that a block passes on to each further ancestor's score.
DECAY = 0.7

#: A tag with whole quoted values, and one up to the next > where quotes don't pair.
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the article, and those of them whose content is no markup.
_DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button title datalist".split())
_RAW = frozenset("script style textarea".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CONTAINERS = frozenset("article body div main section td html".split())
_BOILER_TAGS = frozenset("nav footer aside form dialog menu head".split())
#: Of those, elements that are passed over whole where they are closed.
_PASSED = frozenset("nav footer aside dialog menu head".split())
#: Elements open at once, as in browsers; and most characters of a path that is kept as it is.
DEPTH = 512
_PATH = 300
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": set()}
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("tr", "table", "tbody", "thead", "tfoot"))
#: Words of class, id or role that mark what isn't the article.
_BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners navigation navbar nav menu menus breadcrumb breadcrumbs"
    " sidebar sidebars aside rail footer masthead topbar toolbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion pagination pager widget widgets"
    " complementary contentinfo search skip outbrain taboola paywall legal copyright hidden".split()
)
#: Words that add nothing to such a mark.
_GENERIC = frozenset(
    "site page global primary secondary top bottom left right center middle upper lower first last box block blocks wrap wrapper container inner outer area section list item items bar links link slot unit units"
    " panel form forms button buttons icon icons group zone region module component holder row col column columns cell grid body title heading label text js id the my our view small large mobile desktop fixed sticky main".split()
)
#: Names of parts that open an article beside its body.
_LEADS = frozenset("lead lede intro introduction summary standfirst abstract deck dek".split())
_ARTICLE_WORDS = frozenset("article post entry story content main body text page".split())
#: Of those, words of the article's own element, whose header is part of the article.
_OWN_WORDS = frozenset("article post entry story".split())
#: Words that turn a class into a remark on something else: has-sidebar, no-comments.
_REMARKS = frozenset("no not has have with without is".split())
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: What marks an element as no part of the article: nothing, a name that says more, a plain name, its tag or state.
_NONE, _WEAK, _NAMED, _SURE = range(4)
#: Share of a page's unlinked text from which a weak mark is none, and that of a named element which is taken where all else is dropped.
_MOST, _NEARLY_ALL = 0.5, 0.9
#: Fewest characters of such an element.
_LEAST_TEXT = 140


@dataclass
class Node:
    tag: str
    parent: int
    path: str
    mark: int
    article: bool
    #: Whether it stands in the article's own element.
    inside: bool = False
    lead: bool = False
    #: The element that it really stands in, where that is deeper than ``DEPTH``.
    above: int = -1
    boiler: bool = False
    score: float = 0.0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text, characters inside links) of each block, in page order.
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _words(value: str) -> list[str]:
    """Words of a class or id: parts at signs and digits, camel case too."""
    return [w.lower() for w in _NAMES.findall(value)]


def _mark_of(mark: frozenset[str], root: bool, inside: bool) -> int:
    """How surely one class, id or role marks what isn't the article; the article's own element only if it is a comment."""
    if mark & _REMARKS:
        return _NONE
    found = mark & _BOILER_WORDS
    found = found & {"comment", "comments", "reply"} if root else found - {"header"} if inside else found
    return (_WEAK if mark - _BOILER_WORDS - _GENERIC else _NAMED) if found else _NONE


def _settle(page: Page) -> None:
    """Decides for each element whether it is part of the article, now that the texts are known."""
    nodes, own = page.nodes, [0] * len(page.nodes)
    for node, text, links in page.blocks:
        own[node] += max(0, len(text) - links)
    held, sure = own[:], [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].parent] += held[i]
    for i, n in enumerate(nodes):
        sure[i] = n.mark == _SURE or i > 0 and (sure[n.parent] or n.above >= 0 and sure[n.above])
    total = sum(t for t, s in zip(own, sure, strict=True) if not s)

    def decide(taken: int) -> int:
        left = 0
        for i, n in enumerate(nodes):
            marked = n.mark >= _NAMED or n.mark == _WEAK and held[i] < _MOST * total
            n.boiler = i != taken and (marked or i > 0 and (nodes[n.parent].boiler or n.above >= 0 and nodes[n.above].boiler))
            left += 0 if n.boiler else own[i]
        return left

    if decide(-1) < (1 - _NEARLY_ALL) * total:
        named = max((i for i, n in enumerate(nodes) if n.mark == _NAMED and not sure[i]), key=lambda i: (held[i], i), default=-1)
        if named >= 0 and held[named] >= max(_LEAST_TEXT, _NEARLY_ALL * total):
            decide(named)


def _hidden(names: dict[str, str]) -> bool:
    return "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in re.sub(r"\s", "", names.get("style", "")).lower()


def _label(tag: str, classes: str, name: str) -> str:
    """Generalised step of a path: the tag and its sorted classes (or id), digits as #."""
    own = sorted({re.sub(r"\d+", "#", c) for c in classes.split()}) or ([re.sub(r"\d+", "#", name)] if name else [])
    return ".".join([tag, *own])


def _step(path: str, label: str) -> str:
    """The path one container deeper; a long one starts with a digest of the rest."""
    path = f"{path}>{label}"
    return path if len(path) <= _PATH else f"#{hashlib.md5(path.encode('utf-8', 'replace')).hexdigest()}"


def _pairs(html: str, tag: str) -> dict[int, int]:
    """End of the closing tag by end of the opening tag, of the elements of that name that are closed."""
    out, open_ = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*+>", html, re.IGNORECASE):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.end())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def parse(html: str) -> Page:
    """Containers and text blocks of a page; tolerant of unclosed and stray tags.  Takes time in proportion to the page."""
    page = Page([Node("html", -1, "html", _NONE, False)])
    stack, pieces, links, depth, at, end = [0], [], 0, 0, 0, len(html)
    #: How many open elements have a name; closing tags by name, found when the name is met first; steps of paths.
    opened: Counter[str] = Counter()
    closings: dict[str, dict[int, int]] = {}
    steps: dict[tuple[str, str], str] = {}
    quoted, cdata, last = True, True, html.rfind(">")
    cell: tuple[int, int] | None = None
    #: Elements that are open beyond ``DEPTH``, and how many of a name.
    over: list[int] = []
    over_tags: Counter[str] = Counter()

    def emit(parts: list[str], node: int) -> None:
        text = " ".join("".join(parts).split())
        if text:
            page.blocks.append((node, text, min(links, len(text))))

    def flush() -> None:
        """Ends a block.  Cells of a row are one block, but not those before a cell that holds blocks itself."""
        nonlocal pieces, links, cell
        if cell is not None:
            emit(pieces[: cell[0]], cell[1])
            emit(pieces[cell[0] :], stack[-1])
        elif pieces:
            emit(pieces, stack[-1])
        pieces, links, cell = [], 0, None

    def pop_to(level: int) -> None:
        for n in stack[level:]:
            opened[page.nodes[n].tag] -= 1
        del stack[level:]
        if level < DEPTH and over:
            over.clear()
            over_tags.clear()

    def close_over(tag: str) -> bool:
        """Whether the tag closes an element beyond ``DEPTH`` under the last one."""
        if over_tags[tag] <= 0 or len(stack) > DEPTH and page.nodes[stack[-1]].tag == tag:
            return False
        pop_to(DEPTH)
        while True:
            name = page.nodes[over.pop()].tag
            over_tags[name] -= 1
            if name == tag:
                return True

    def say(raw: str) -> None:
        nonlocal links
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if depth:
            links += len(text.strip())

    def closing(tag: str) -> dict[int, int]:
        if tag not in closings:
            closings[tag] = _pairs(html, tag)
        return closings[tag]

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if cdata and html.startswith("<![CDATA[", lt):
            close = html.find("]]>", lt)
            cdata = close >= 0
            if cdata:
                say(html[lt + 9 : close].replace("&", "&amp;"))
                at = close + 3
                continue
        if lt > last:
            # No tag ends after this: the rest is text, up to a comment.
            comment = html.find("<!--", lt)
            at = comment if comment >= 0 else end
            say(html[lt:at])
            continue
        if html[lt + 1] in "!?":
            at = html.find(">", lt) + 1
            continue
        m = _QUOTED.match(html, lt) if quoted else None
        if m is None:
            m = _PLAIN.match(html, lt)
            # Quotes that don't pair up to the page's end are looked for once.
            quoted = quoted and m is None
        if m is None:
            say("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in _INLINE:
                depth = max(0, depth - 1) if tag == "a" else depth
            elif tag == "br":
                pieces.append(" ")
            elif tag not in _VOID:
                deep = bool(over) and close_over(tag)
                level = next((i for i in range(len(stack) - 1, 0, -1) if page.nodes[stack[i]].tag == tag), 0) if opened[tag] > 0 and not deep else 0
                if tag in _CELLS:
                    pieces.append(" ")
                else:
                    cell = None if tag in _ROWS else cell
                    flush()
                    depth = 0
                if level and not (tag == "p" and any(page.nodes[n].tag in _CONTAINERS for n in stack[level + 1 :])):
                    pop_to(level)
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        if tag in _DROPPED:
            if tag in _RAW:
                # The first closing tag ends it, whatever stands before.
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.IGNORECASE).search(html, at)
                at = close.end() if close else end
            else:
                at = closing(tag).get(at, at)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _INLINE:
            if tag == "a":
                depth += 1
            continue
        if tag in _CELLS:
            pieces.append(" ")
        else:
            cell = None if tag in _ROWS else cell
            flush()
            depth = 0
        if tag in _CLOSES_P and opened["p"] > 0:
            level = next((i for i in range(len(stack) - 1, 0, -1) if page.nodes[stack[i]].tag == "p" or page.nodes[stack[i]].tag in _CONTAINERS), 0)
            if level and page.nodes[stack[level]].tag == "p":
                pop_to(level)
        if tag in _PASSED and at in closing(tag):
            at = closing(tag)[at]
            continue
        if tag in _SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if page.nodes[stack[i]].tag in _SCOPES[tag]:
                    break
                if page.nodes[stack[i]].tag in _SIBLINGS[tag]:
                    pop_to(i)
        if tag == "body":
            pop_to(1)
        if len(stack) > DEPTH:
            over.append(stack[DEPTH])
            over_tags[page.nodes[stack[DEPTH]].tag] += 1
            pop_to(DEPTH)
        if tag in _CELLS:
            cell = (len(pieces), stack[-1])
        parent = page.nodes[stack[-1]]
        names = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        marks = [frozenset(_words(x)) for k in ("class", "id", "role") for x in names.get(k, "").split()]
        words = frozenset().union(*marks)
        inside = parent.inside or parent.tag == "main"
        root = tag in ("html", "body", "article", "main")
        own = tag == "article" or "articlebody" in names.get("itemprop", "").lower() or bool(words & _OWN_WORDS) and tag != "body"
        good = tag in ("article", "main") or own or bool(words & _ARTICLE_WORDS) and tag != "body"
        if tag in _BOILER_TAGS or tag == "header" and not inside or _hidden(names):
            mark = _SURE
        elif tag in ("html", "body"):
            mark = _NONE
        else:
            mark = max((_mark_of(w, root, inside) for w in marks), default=_NONE)
            # Beside the plain name of an article a mark says less.
            if mark and not root and any(w & _ARTICLE_WORDS and not w - _ARTICLE_WORDS - _GENERIC for w in marks):
                mark -= 1
        path = parent.path
        if tag in _CONTAINERS and tag != "html":
            step = (path, _label(tag, names.get("class", ""), names.get("id", "")))
            path = steps[step] = steps.get(step) or _step(*step)
        page.nodes.append(Node(tag, stack[-1], path, mark, good, inside or own, bool(words & _LEADS), over[-1] if over else -1))
        stack.append(len(page.nodes) - 1)
        opened[tag] += 1
    flush()
    _settle(page)
    return page


def _container(page: Page, node: int) -> int:
    while node > 0 and page.nodes[node].tag not in _CONTAINERS:
        node = page.nodes[node].parent
    return node


def score(page: Page) -> None:
    """Score of each container: text of its blocks less twice their links, passed on to ancestors with decay, more for article elements."""
    for node, text, links in page.blocks:
        if page.nodes[node].boiler:
            continue
        gain, at = float(max(0, len(text) - 2 * links)), _container(page, node)
        while at >= 0 and gain > 0.01:
            page.nodes[at].score += gain
            gain *= DECAY
            at = page.nodes[at].parent
            while at > 0 and page.nodes[at].tag not in _CONTAINERS:
                at = page.nodes[at].parent
    for n in page.nodes:
        n.score *= 2.0 if n.tag in ("article", "main") else 1.2 if n.article else 1.0


def votes(page: Page) -> dict[str, float]:
    """Share of the page's best score, by path, of its good containers."""
    score(page)
    best = max((n.score for n in page.nodes), default=0.0)
    out: dict[str, float] = {}
    if best:
        for n in page.nodes:
            if n.tag in _CONTAINERS and not n.boiler and n.score >= VOTE_SHARE * best:
                out[n.path] = max(out.get(n.path, 0.0), n.score / best)
    return out


def _below(page: Page, tops: set[int]) -> set[int]:
    """The elements and what stands in them, less what isn't the article."""
    out = set(tops)
    for i in range(min(out) + 1, len(page.nodes)):
        n = page.nodes[i]
        if n.parent in out and not n.boiler:
            out.add(i)
    return out


def _with_siblings(page: Page, chosen: set[int]) -> set[int]:
    """The chosen containers and the parts beside them that belong to the article.

    Under an element of the article these are all that hold text without links, elsewhere those
    whose name says that they open it.
    """
    parents = {page.nodes[i].parent for i in chosen}
    if len(parents) != 1 or (parent := parents.pop()) < 0:
        return chosen
    up = page.nodes[parent]
    beside = [i for i, n in enumerate(page.nodes) if n.parent == parent and i not in chosen and not n.boiler and n.tag in _CONTAINERS and (n.lead or up.article and up.tag not in ("body", "html"))]
    text = {i: [0, 0] for i in beside}
    if not beside:
        return chosen
    root = dict.fromkeys(beside)
    of = {i: i for i in root}
    for i in range(min(beside) + 1, len(page.nodes)):
        n = page.nodes[i]
        if n.parent in of and not n.boiler and i not in of:
            of[i] = of[n.parent]
    for node, block, links in page.blocks:
        if node in of:
            text[of[node]][0] += len(block)
            text[of[node]][1] += links
    return chosen | {i for i, (size, links) in text.items() if size and 2 * links < size}


def text_of(page: Page, path: str | None) -> str:
    """Blocks of the containers at ``path``, or at the path of the page's best container, in page order, one line each.

    A container whose text is all links is a menu and left out, unless the page has nothing else.
    """
    score(page)
    containers = [i for i, n in enumerate(page.nodes) if n.tag in _CONTAINERS and not n.boiler]
    among = [i for i in containers if page.nodes[i].path == path and page.nodes[i].score] or containers
    if not among:
        return ""
    best = page.nodes[max(among, key=lambda i: (page.nodes[i].score, -i))]
    chosen = {i for i in among if page.nodes[i].path == best.path and (page.nodes[i].score or not best.score)}
    inside = _below(page, _with_siblings(page, chosen))
    return "\n".join(text for node, text, _ in page.blocks if node in inside)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning container path of each host, by summed votes; of equal ones the first in code-point order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], float] = {}
            for h, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, share in votes(parse(source or "")).items():
                    total[h, path] = total.get((h, path), 0.0) + share
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.float64())], names=["host", "path", "votes"])

    ballots = pages.select(host(F.col("url")).alias("host"), "html").filter("host <> ''").mapInArrow(run, "host string, path string, votes double")
    # Whole votes to the thousandth, so that the sum doesn't depend on its order.
    sums = ballots.groupBy("host", "path").agg(F.sum(F.round(F.col("votes") * 1000).cast("long")).alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``: the article's blocks, one line each.

    Dropped are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    reader comments and hidden parts; character references are decoded and white space inside
    a block is one space.  Null, empty and text-less pages have an empty text.  Pages without
    a host use their own best container.  Repeated rows each get their row; columns other
    than page_id, url and html are not read.
    """
    from .durable import materialize

    winners = materialize(host_paths(pages), "host-paths").select(F.col("host").alias("__w"), "path")
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("__host")).join(winners, F.col("__host") == F.col("__w"), "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(parse(h), p) if h else "" for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
