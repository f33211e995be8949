"""Main text of web pages by tree scoring."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import add, mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import text_of
from halyard.llm.markup import VOID, attributes, tokens

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp".split())
#: Elements that never hold main text: menus, forms and their controls, notices, scripts, and what is shown only where something else isn't.
DROPPED = frozenset("script style noscript template iframe object embed applet nav aside footer form button select textarea input dialog canvas audio video menu title head noembed noframes".split())
#: Words in class, id or role of what isn't main text either; see _furniture and _prune.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsbox banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation navigational newsletter notice notices notification pager paginator pagination popup promo promoted promotion related recommended replies reply respond search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Words among these of lists of links; inside an article or the main part, what they name stays where it has text of its own.
LISTS = frozenset("related recommended search share sharing social tags toolbar topbar widget widgets pager paginator pagination skip".split())
#: What may stand beside such a word in a compound that names furniture still: words of place, shape and number.
SHAPES = frozenset("left right top bottom upper lower primary secondary first second third main site global inner outer sub mini small large sticky fixed default mobile desktop inline block wrap wrapper container holder box area region zone slot unit bar panel group row col column list item items entry entries link links button buttons icon icons title form field body section div posts articles stories media network networks recent ad x".split())
#: The same for header: that of an entry, a section or a page holds its title.
SITE = frozenset("site main global top left right wrap wrapper container inner outer area bar sticky fixed mobile desktop".split())
#: Words of what may well hold more text than the main part does.
OTHERS = frozenset("ad ads advert adverts advertisement advertising adsbox comment comments commentlist disqus replies reply respond shoutbox cookie cookies consent gdpr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAFE = frozenset("html body article main".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
#: An open element of the first kind ends where one of the second opens, inside the third.
_P_ENDS = BLOCKS - {"option", "optgroup", "legend", "caption", "body", "html", "tbody", "thead", "tfoot", "tr", "td", "th"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("table td th caption button object html article main".split())
_NEAREST = {"p": ({"p"}, _SCOPE)} | _ENDS
_NAMED = frozenset().union(*(names | scope for names, scope in _NEAREST.values()))
_WORDS = re.compile(r"[a-z]+|[0-9]+")


def _furniture(names: str) -> frozenset[str]:
    """The furniture words of those classes that are such a word, or a compound of such words with words of place and shape: not has-sidebar, page-header, social-issues."""
    found = set()
    for name in names.split():
        words = {w for w in _WORDS.findall(name) if not w.isdigit()}
        if words <= FURNITURE | (SITE if "header" in words else SHAPES):
            found |= words & FURNITURE
    return frozenset(found)


class Node:
    __slots__ = ("name", "words", "classes", "named", "hidden", "parent", "children", "score", "points", "chars", "commas", "linked", "headed", "prose", "dropped", "near", "inside")

    def __init__(self, name: str, parent: Node | None, rest: str = "") -> None:
        self.name, self.parent, self.children = name, parent, []
        self.score, self.points, self.chars, self.commas, self.linked, self.headed, self.prose, self.dropped = 0.0, 0.0, 0, 0, 0, 0, 0, False
        self.words, self.classes, self.named, self.hidden = frozenset(), frozenset(), frozenset(), False
        up = parent.near if parent is not None else {}
        #: For each rule of _NEAREST, the nearest element, this or above, that it names.
        self.near = up if name not in _NAMED else up | {k: self if name in names else None for k, (names, scope) in _NEAREST.items() if name in names or name in scope}
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        if rest and "=" in rest or "hidden" in rest:
            got = attributes(rest)
            names = " ".join(got.get(k, "") for k in ("class", "id", "role")).lower()
            self.words = frozenset(_WORDS.findall(names))
            self.named = _furniture(names) if self.words & FURNITURE else frozenset()
            self.classes = frozenset(got.get("class", "").split())
            self.hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()


def tree(html: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order. Missing and stray end tags are mended as browsers do for blocks. Each element is opened and left once, however deep it lies."""
    root = Node("html", None)
    at, every = root, [root]
    opened: Counter = Counter()

    def leave(x: Node) -> Node:
        """Closes x and all that is open inside it."""
        y = at
        while y is not x.parent:
            opened[y.name] -= 1
            y = y.parent
        return y

    for kind, name, rest in tokens(html):
        if kind == "text" or kind == "raw" and rest == "xmp":
            at.children.append(name)
        elif kind == "open":
            if name in ("html", "body"):
                continue
            if name in _P_ENDS and (p := at.near.get("p")) is not None:
                at = leave(p)
            if name in HEADINGS and at.name in HEADINGS:
                at = leave(at)
            if name in _ENDS and (x := at.near.get(name)) is not None:
                at = leave(x)
            node = Node(name, at, rest)
            at.children.append(node)
            every.append(node)
            if name not in VOID and not rest.endswith("/"):
                at = node
                opened[name] += 1
        elif kind == "close" and name not in VOID and opened[name] > 0:
            x = at
            while x.name != name:
                x = x.parent
            at = leave(x)
    return root, every


def _prune(every: list[Node], by_class: bool = True) -> bool:
    """Marks what isn't main text, and tells whether any of it is so by its class.

    An element that holds over half of the paragraphs' text is kept in spite of its class; not so what OTHERS name, nor what lies
    outside the article of a page that has one, as a short text has less than what surrounds it.
    """
    holds = set()  # what holds an article or the main part isn't furniture, whatever its class
    for x in every:
        if x.name in ("article", "main"):
            y = x.parent
            while y is not None and y not in holds:
                holds.add(y)
                y = y.parent
    for x in every:  # parents come first
        up = x.parent
        if up is not None and up.dropped:
            x.dropped = True
        elif up is not None and up.name == "header":  # one that is kept: an article's, for its headings
            x.dropped = x.name not in HEADINGS and x.name != "hgroup"
        elif x.name == "header" and not x.hidden and up is not None and up.inside:
            x.dropped = False
        elif x not in holds and x.name not in SAFE:
            x.dropped = x.name in DROPPED or x.name == "header" or x.hidden
    running = _running_text(every) if by_class and any(x.named for x in every) else set()
    doubtful = {x for x in every if x.named and not x.dropped and by_class and x not in running and (x not in holds and x.name not in SAFE or x.name == "article" and x.named & {"comment", "comments", "reply"}) and not (x.name == "header" or x.parent is not None and x.parent.name == "header")}
    if not doubtful:
        return False
    _measure(every)
    most = every[0].prose / 2
    article = any(x.name in ("article", "main") and x.chars and not x.dropped and x not in doubtful for x in every)
    for x in every:
        if x.parent is not None and x.parent.dropped:
            x.dropped = True
        elif x in doubtful:
            if x.inside and x.named <= LISTS and x.prose > 0 and not _dense(x):
                continue
            x.dropped = bool(x.named & OTHERS) or x.prose <= most or article and not x.inside
    return True


def _running_text(every: list[Node]) -> set[Node]:
    """Inline elements that hold no block, and whatever lies in a paragraph, in preformatted text or in code: parts of a text, whose classes say how they look."""
    inside: set[Node] = set()
    wraps: set[Node] = set()
    for x in every:  # parents come first
        if x.parent is not None and (x.parent in inside or x.parent.name in ("p", "pre", "code")):
            inside.add(x)
        if x.name in BLOCKS and x.parent is not None and x.parent.name not in BLOCKS:
            y = x.parent
            while y is not None and y.name not in BLOCKS and y not in wraps:
                wraps.add(y)
                y = y.parent
    return inside | {x for x in every if x.name not in BLOCKS and x not in wraps}


def _measure(every: list[Node]) -> None:
    """Counts the characters of what isn't dropped: all, those in links, those in headings, and those of paragraphs outside links; and all commas."""
    for x in every:
        x.chars = x.commas = x.linked = x.headed = x.prose = 0
    for x in reversed(every):  # children first
        if x.dropped:
            continue
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(" ".join(c.split()))
                x.commas += c.count(",") + c.count("，")
        if x.name == "a":
            x.linked = x.chars
        if x.name in HEADINGS:
            x.headed = x.chars
        if x.name in PARAGRAPHS:
            x.prose = x.chars - x.linked
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.commas += x.commas
            x.parent.linked += x.linked
            x.parent.headed += x.headed
            x.parent.prose += x.prose


def _best(root: Node, every: list[Node]) -> Node:
    """The container with the most points. A paragraph's are 1, one for each comma, and one for each 100 characters up to 3; its parent has all, the next half, a third, ..., up to the root, each less by its share of linked text."""
    _measure(every)
    direct: dict[Node, float] = {}
    for x in every:
        if x.dropped:
            continue
        if x.name in PARAGRAPHS:
            size, commas = x.chars, x.commas
        elif x.name in BLOCKS and x.name not in HEADINGS:
            own = [c for c in x.children if isinstance(c, str)]
            size, commas = len("".join(own).strip()), sum(c.count(",") + c.count("，") for c in own)
        else:
            continue
        if not size:
            continue
        points = (1 + commas + min(size / 100, 3)) * (1 - x.linked / max(1, x.chars))
        x.points += points
        up = x.parent if x.name in PARAGRAPHS and x.parent is not None else x
        direct[up] = direct.get(up, 0.0) + points
    for x in reversed(every):
        if not x.dropped and x.parent is not None:
            x.parent.points += x.points
    _scores(every, direct)
    best = max((x for x in every if not x.dropped and x.name in BLOCKS), key=lambda x: x.score * (1 - x.linked / max(1, x.chars)), default=root)
    x = best
    while x is not None and x.name not in ("article", "main"):  # an article is kept whole
        x = x.parent
    return x if x is not None and not x.dropped else best


#: 1 / d for d = 1, 2, ... as a sum of powers of DECAY, by the trapezoid rule on the integral of exp(-d t) over t = exp(u); off by some 1e-5.
DECAY = [math.exp(-math.exp(u / 10)) for u in range(-140, 26, 8)]
SHARE = [0.8 * math.exp(u / 10) for u in range(-140, 26, 8)]


def _scores(every: list[Node], direct: dict[Node, float]) -> None:
    """Each node's points to itself and all above it, divided by 1, 2, 3, ... on the way up. A node passes its sums of powers on to its parent, so time is linear in the nodes."""
    below: dict[Node, list[float]] = {}
    for x in reversed(every):  # children first
        own, sums = direct.get(x, 0.0), below.pop(x, None)
        if sums is None:
            if not own:
                continue
            sums = [own * q for q in DECAY]
        else:
            sums = [(s + own) * q for s, q in zip(sums, DECAY)]
        x.score = sum(map(mul, sums, SHARE))
        if x.parent is not None:
            others = below.get(x.parent)
            below[x.parent] = sums if others is None else list(map(add, sums, others))


def _dense(x: Node) -> bool:
    return x.linked >= 0.3 * max(1, x.chars)


def _titles(x: Node) -> bool:
    """A heading, or a container with no other text."""
    return x.name in HEADINGS or 0 < x.chars == x.headed


def _alike(x: Node, y: Node) -> bool:
    """Equal elements that share a class, or have neither class nor id; cells also lay out pages, so theirs must be shared."""
    return x.name == y.name and bool(x.classes & y.classes or x.name != "td" and not x.words and not y.words)


def _kept(best: Node) -> list[Node]:
    """The best container, and what belongs to it on its own level and on those above it.

    A sibling of the best container, or of one that holds it, counts as text if under 0.3 of it is linked and it has a fifth of the best one's
    points, or any where it is alike. The highest level with such a sibling is the last; each level up to it, the first in any case, keeps
    these, headings and paragraphs, and all but link lists where an alike sibling has that fifth. From above comes the nearest h1, if there is none yet.
    The children of what holds the best container are reduced to what is kept.
    """
    if best.parent is None or best.name in ("article", "main"):
        same = [x for x in (best.parent.children if best.parent is not None else []) if isinstance(x, Node) and x.name == best.name and not x.dropped]
        return same or [best]
    at, top, levels = best, best.parent, []
    while at.parent is not None:
        others = [x for x in at.parent.children if isinstance(x, Node) and x is not at and not x.dropped and not _dense(x)]
        peers = {x for x in others if x.points >= 0.2 * best.score > 0 or x.points > 0 and _alike(x, at)}
        whole = any(_alike(x, at) and x.points >= 0.2 * best.score for x in peers)
        levels.append((at, peers, whole))
        at = at.parent
        if peers:
            top = at
    for x, peers, whole in levels:
        if x is top:
            break
        x.parent.children = [y for y in x.parent.children if y is x or _stays(y, peers, whole)]
    out, x = [top], top
    if not _holds_h1(top):
        while x.parent is not None and len(out) == 1:
            before = x.parent.children[: x.parent.children.index(x)]
            out = [*(y for y in before if isinstance(y, Node) and not y.dropped and _titles(y) and _holds_h1(y)), top]
            x = x.parent
    return out


def _stays(x: Node | str, peers: set[Node], whole: bool) -> bool:
    if isinstance(x, str):
        return whole
    if x.dropped or x in peers or _titles(x):
        return not x.dropped
    if x.name not in BLOCKS:
        return whole
    if x.name in ("p", "pre", "blockquote"):
        return whole or x.chars > 0 and not _dense(x)
    return not _dense(x) and (whole or x.name in ("ul", "ol", "table") and x.chars > 0)


def _holds_h1(top: Node) -> bool:
    stack = [top]
    while stack:
        x = stack.pop()
        if not x.dropped:
            if x.name == "h1" and x.chars:
                return True
            stack.extend(c for c in x.children if isinstance(c, Node))
    return False


def main_text(html: str) -> str:
    """Blocks of the main part in page order, joined by line feeds; inside a block, white space is one space. No text: empty.

    Where nothing is left without what classes name furniture, classes don't count.
    """
    text, dropped = _text(html, True)
    return text if text or not dropped else _text(html, False)[0]


def _text(html: str, by_class: bool) -> tuple[str, bool]:
    root, every = tree(html)
    dropped = _prune(every, by_class)
    blocks, line = [], []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    for top in _kept(_best(root, every)):
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x.name == "br":
                line.append(" ")
            elif not x.dropped:
                block = x.name in BLOCKS
                if block:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.children))
        end()
    return "\n".join(blocks), dropped


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            texts = [main_text(x.as_py()) for x in some.column("_html")]
            names = [n for n in some.schema.names if n != "_html"]
            yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per row of pages: <id_col>, <url_col>, text, n_chars (code points).

    Null html is empty and gives an empty text, as does a page without text. Classes count for blocks and for inline elements around blocks, never for
    parts of a running text such as highlighted code. Of a header inside an article only headings stay, a lead paragraph in it goes. Each page is read by itself, in one pass without a shuffle;
    repeated rows and null ids stay as they are. Nothing is capped.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), text_of(pages, html_col).alias("_html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op9_html_extract(spark, sf_dir):
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
