"""Main text of HTML pages by scoring the tree.

Paragraphs give points for their length and commas to their ancestors, less to farther ones; a container's points
shrink with the share of its text that stands in links. The best container and those siblings that look like more
of the same article are kept, without what is marked as menu, advert, comment and the like. A mark counts for nothing on
an element that holds the article.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas nav header footer aside form button select textarea input label menu dialog "
    "audio video map".split())
#: Dropped elements that may stand around a whole article, as server forms do; see _unwrap.
AROUND = frozenset("form noscript header".split())
LEAST_ARTICLE = 140
MOST_FRAMES = 64  # of frames within frames the outer ones are looked at
#: Elements that hold a line of words.
LINES = frozenset("p li td th dd dt blockquote span em strong b i h1 h2 h3 h4 h5 h6".split())
#: What a head may hold; anything else ends an open one.
IN_HEAD = frozenset("html head title base link meta style script noscript template bgsound basefont noframes".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
#: What an opening tag ends, if it is open within the same scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Whole words of class, id and role that mark what is not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|adsense|banner|sponsor(?:ed|s)?|promo(?:tion)?|sidebar|side|menu|nav(?:bar|igation)?|breadcrumbs?|"
    r"header|masthead|footer|foot|comments?|commentlist|respond|replies|reply|disqus|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommend(?:ed|ations)?|widget|toolbar|pagination|pager|tags|search(?:form)?|hidden|contentinfo|complementary)"
    r"(?:$|[\s_-])", re.IGNORECASE)
#: Of these, what visitors write and what asks for consent: never the article, however long.
VISITORS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|reply|disqus|cookies?|consent)(?:$|[\s_-])", re.IGNORECASE)
#: Classes that tell the state of a page and not what the element is: has-sidebar, no-sidebar, comments-open, header-fixed.
STATE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|not|with|without)[_-]\S*|\S*[_-](?:open|closed|fixed)(?=\s|$)", re.IGNORECASE)
#: Kinds of marks: words beside others or in a longer name, the element's own name, what visitors write, what is not shown.
WORDS, NAMED, SAID, HIDDEN = 1, 2, 3, 4
LEVELS = 5


class Node:
    __slots__ = ("tag", "noise", "parent", "children", "place", "text", "linked", "points", "prose", "length", "lead", "trail", "commas")

    def __init__(self, tag: str, parent: Node | None, noise: int = 0):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.children: list[Node | str] = []
        self.text = self.linked = 0
        self.points = self.prose = 0.0
        self.length = self.lead = self.trail = self.commas = 0

    def add(self, length: int, lead: int, trail: int, commas: int) -> None:
        """Appends a text to what the node holds: its length, white space at its ends (all of it, if it is blank), commas."""
        self.trail = trail if trail < length else length + self.trail
        self.lead = self.lead if self.lead < self.length else self.length + lead
        self.length += length
        self.commas += commas


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """The kind of mark an element carries, 0 for none."""
    marks = {k: v or "" for k, v in attrs}
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or "display:none" in marks.get("style", "").replace(" ", "").lower():
        return HIDDEN
    names = [STATE.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", x)).strip() for k in ("class", "id", "role") if (x := marks.get(k))]
    named = " ".join(names)
    if tag == "article":
        return SAID if "comment" in named.lower() else 0
    if tag == "main" or not NOISE.search(named):
        return 0
    if VISITORS.search(named):
        return SAID
    return NAMED if any(NOISE.fullmatch(x.split()[0]) for x in names if x) else WORDS


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open: dict[str, int] = {}

    def _close(self, upto: Node) -> None:
        """Ends all open elements up to and with this one."""
        while True:
            node = self.at
            self.open[node.tag] -= 1
            self.at = node.parent
            if node is upto:
                return

    def _nearest(self, tags, stop=frozenset()) -> Node | None:
        if not any(self.open.get(t) for t in tags):
            return None
        node = self.at
        while node is not self.root and node.tag not in stop:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def _leave_head(self) -> None:
        if head := self._nearest({"head"}):
            self._close(head)

    def handle_starttag(self, tag, attrs):
        if self.at.tag == "title" and (tag == "body" or tag in BLOCK):
            self._close(self.at)
        if self.open.get("head") and (tag == "body" or tag not in IN_HEAD and not self._nearest({"noscript", "template", "title"}, {"head"})):
            self._leave_head()
        if tag in ("html", "body"):
            return
        if tag in BLOCK and (p := self._nearest({"p"}, {"td", "th", "button", "object"})):
            self._close(p)
        if tag in ENDS and (open_ := self._nearest(*ENDS[tag])):
            self._close(open_)
        node = Node(tag, self.at, _mark(tag, attrs) if attrs else 0)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._close(node)

    def parse_marked_section(self, i, report=1):
        """A marked section is a comment up to the next angle, whatever its name and brackets are."""
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self._leave_head()
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    if tree.rawdata.startswith("<!"):  # a comment or declaration that never ends
        tree.rawdata = ""
    tree.close()
    return tree.root


def _walk(root: Node, most: int = 0):
    """(node or text, whether the node ends) in page order, without dropped parts and parts with a mark beyond ``most``;
    no recursion, pages may be deep."""
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, ends = stack.pop()
        if ends or isinstance(item, str):
            yield item, ends
        elif item.noise <= most and item.tag not in DROPPED:
            yield item, False
            stack.append((item, True))
            stack.extend((x, False) for x in reversed(item.children))


def _unwrap(root: Node) -> None:
    """Lets a form, noscript or header pass that holds most of the page's text outside links, and at least a few lines:
    it is the page's frame and not a part of it. A button or label between the words of a line is part of the line."""
    sizes: dict[int, int] = {}
    frames: list[Node] = []
    total = links = 0
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    within: list[Node] = []
    while stack:
        item, ends = stack.pop()
        if isinstance(item, str):
            size = 0 if links else len(item.strip())
            total += size
            for frame in within:
                sizes[id(frame)] += size
        elif ends:
            links -= item.tag == "a"
            if item.tag in AROUND:
                within.pop()
        else:
            if item.tag in ("button", "label") and item.parent.tag in LINES and any(isinstance(x, str) and x.strip() for x in item.parent.children):
                item.tag = "span"
            if item.tag in DROPPED and item.tag not in AROUND or item.noise >= SAID:
                continue
            if item.tag in AROUND:
                if len(within) == MOST_FRAMES:
                    continue
                sizes[id(item)] = 0
                frames.append(item)
                within.append(item)
            links += item.tag == "a"
            stack.append((item, True))
            stack.extend((x, False) for x in reversed(item.children))
    for frame in frames:
        if sizes[id(frame)] >= LEAST_ARTICLE and 2 * sizes[id(frame)] > total:
            frame.tag = "div"


def _spare(root: Node) -> None:
    """Takes the mark from elements that hold the article, by the lengths of texts outside links.

    These are the elements around a main element or around the article element with most of the page's text. Without
    such an element in plain sight, they are those with most of the text that visitors did not write, if it is twice
    all unmarked text; ten times for an element that is named by a marked word.
    """
    seen: list[Node] = []
    plain: list[Node] = []
    links = said = marks = unmarked = 0
    at = root
    for item, ends in _walk(root, SAID):
        if isinstance(item, str):
            size = 0 if links else len(item.strip())
            at.linked += size  # all of it
            at.text += 0 if said else size
            unmarked += 0 if marks else size
            continue
        step = -1 if ends else 1
        links += step * (item.tag == "a")
        said += step * (item.noise == SAID)
        marks += step * bool(item.noise)
        if not ends:
            at = item
            seen.append(item)
            if item.tag in ("article", "main") and not marks:
                plain.append(item)
        elif item is not root:
            at = item.parent
            at.text += item.text
            at.linked += item.linked
    if any(n.noise for n in seen):
        climbed = set()
        for node in seen:
            home = not node.noise and (node.tag == "main" and node.linked or node.tag == "article" and (2 * node.linked > root.linked or 4 * node.text > root.text))
            while home and node is not None and id(node) not in climbed:
                climbed.add(id(node))
                node.noise = 0
                node = node.parent
        if not any(4 * n.text >= unmarked and 20 * n.text >= root.text for n in plain):
            for node in seen:
                if node.noise in (WORDS, NAMED) and 2 * node.text > root.text and node.text > (2 if node.noise == WORDS else 10) * unmarked:
                    node.noise = 0
    for node in seen:
        node.text = node.linked = 0


def _measure(root: Node) -> list[Node]:
    """Sets the lengths of text and of linked text of all nodes; the kept nodes in page order."""
    seen: list[Node] = []
    links = 0
    at = root
    for item, ends in _walk(root):
        if isinstance(item, str):
            size = len(item.strip())
            at.text += size
            at.linked += size if links else 0
            at.add(len(item), len(item) - len(item.lstrip()), len(item) - len(item.rstrip()), item.count(","))
        elif ends:
            links -= item.tag == "a"
            if item is not root:
                item.parent.text += item.text
                item.parent.linked += item.linked
                item.parent.add(item.length, item.lead, item.trail, item.commas)
                at = item.parent
        else:
            links += item.tag == "a"
            at = item
            seen.append(item)
    return seen


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _score(nodes: list[Node]) -> None:
    """A paragraph's points go to its ancestors: all to the parent, half to the next, then a third of half, and so on.
    ``prose`` has all points of a node and what is in it."""
    for node in nodes:
        direct = "".join(x for x in node.children if isinstance(x, str)).strip()
        if node.tag in PARAGRAPH or node.tag in ("div", "section", "article", "main") and direct:
            commas, size = (node.commas, node.length - node.lead - node.trail) if node.tag in PARAGRAPH else (direct.count(","), len(direct))
            if size <= 0:
                continue
            points = (1 + commas + min(size / 100, 3.0)) * (1 - _density(node))
            node.prose += points
            above = node.parent if node.tag in PARAGRAPH else node
            for level in range(LEVELS):
                if above is None:
                    break
                above.points += points / (1, 2, 6, 9, 12)[level]
                above = above.parent
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.prose += node.prose


def _blocks(roots: list[Node | str]) -> list[str]:
    found, line = [], []

    def end():
        if text := " ".join("".join(line).split()):
            found.append(text)
        line.clear()

    for root in roots:
        for item, _ in _walk(root):
            if isinstance(item, str):
                line.append(item)
            elif item.tag == "br":
                line.append(" ")
            elif item.tag in BLOCK:
                end()
    end()
    return found


def _article(node: Node) -> Node:
    """The nearest article or main element around the best container, which may be a part of it."""
    above = node
    while above is not None:
        if above.tag in ("article", "main"):
            return above
        above = above.parent
    return node


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty for a null or empty page and for one without text.

    Character references are decoded, white space in a block is one space. Without any paragraph the article or
    main element counts, and without that the page, both without what is marked as noise.
    """
    if not html:
        return ""
    root = parse(html)
    _unwrap(root)
    _spare(root)
    nodes = _measure(root)
    _score(nodes)
    scored = [(n.points * (1 - _density(n)), -i) for i, n in enumerate(nodes) if n.points > 0]
    if not scored:
        known = [n for n in nodes if n.tag in ("article", "main") and n.text]
        return "\n".join(_blocks(known[:1] or [root]))
    best = nodes[-max(scored)[1]]
    whole = _article(best)
    if whole.parent is None:
        return "\n".join(_blocks([whole]))
    return "\n".join(_blocks(_beside(whole) if whole.tag in ("article", "main") else _around(whole)))


def _beside(whole: Node) -> list[Node | str]:
    """An article or main element with those siblings that are alike or prose."""
    points = whole.points * (1 - _density(whole))
    kept: list[Node | str] = []
    for sibling in whole.parent.children:
        if sibling is whole:
            kept.append(sibling)
        elif isinstance(sibling, Node) and not sibling.noise and sibling.tag not in DROPPED:
            alike = sibling.tag == whole.tag and sibling.points * (1 - _density(sibling)) >= points / 5
            prose = sibling.tag == "p" and sibling.text > 80 and _density(sibling) < 0.25
            if alike or prose:
                kept.append(sibling)
    return kept


def _around(best: Node) -> list[Node | str]:
    """The best container with all siblings that are not mostly links, and the same again for its ancestors up to the
    highest that has a sibling with a fifth of its paragraph points: the parts of an article may be nested."""
    path, top = [best], 0
    while path[-1].parent.parent is not None:
        path.append(path[-1].parent)

    def kept(item: Node | str, beside: Node) -> bool:
        return isinstance(item, str) or not item.noise and item.tag not in DROPPED and (not item.text or _density(item) < 0.5 or alike(item, beside))

    def alike(item: Node, beside: Node) -> bool:
        return 5 * item.prose >= beside.prose

    for i, node in enumerate(path):
        if any(isinstance(x, Node) and x is not node and x.prose and alike(x, node) for x in node.parent.children):
            top = i
    before: list[list[Node | str]] = []
    after: list[list[Node | str]] = []
    for node in path[: top + 1]:
        around = node.parent.children
        at = next(i for i, x in enumerate(around) if x is node)
        edge: list[Node | str] = [Node(node.parent.tag, None)]  # a line ends at a block's edge
        before.append(edge + [x for x in around[:at] if kept(x, node)])
        after.append([x for x in around[at + 1 :] if kept(x, node)] + edge)
    return [x for part in reversed(before) for x in part] + [best] + [x for part in after for x in part]


def extract(html: Column) -> Column:
    """main_text as a column; small batches keep long pages out of memory together."""

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return texts(html)


def with_main_text(pages, html: str = "html", name: str = "text"):
    """pages with the main text as one more column (replacing one of that name); every row keeps its row."""
    small_batches(pages.sparkSession, 500)
    return pages.withColumn(name, F.coalesce(extract(F.col(html)), F.lit("")))
