"""A small HTML tree: block elements and text blocks, with the features that the extractor's trees read."""

from __future__ import annotations

import html
import re

import numpy as np

#: HTML element classes and the words that attributes use for parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
#: Of these, the ones that reach to the end of a page where their end tag is missing.
ENDLESS = frozenset("script style textarea title".split())
#: Elements whose own tags are no blocks; the end tag, a block or a block's end tag closes them.
FOREIGN = frozenset("svg math select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br img input button object svg math select".split()
)
#: Inline elements that part words.
SPACED = frozenset("br wbr img input button object svg select".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SELF_CLOSING = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "thead": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("table ul ol dl body html article div section main aside nav".split())
TAG_GROUPS = {
    "article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "fieldset": 5,
    "dialog": 5, "section": 6, "div": 7, "p": 8, "h1": 9, "h2": 10, "h3": 10, "h4": 10, "h5": 10, "h6": 10, "li": 11,
    "ul": 12, "ol": 12, "dl": 12, "dt": 11, "dd": 11, "table": 13, "tr": 13, "td": 13, "th": 13, "blockquote": 14,
    "pre": 15, "figure": 16, "figcaption": 16, "body": 17, "html": 17, "#block": 18,
}
OTHER_GROUP, GROUPS = 19, 20
TOKEN_GROUPS = (
    frozenset("content article post entry story main body text page blog single prose markdown".split()),
    frozenset("nav navbar menu navigation breadcrumb breadcrumbs toc pagination pager tabs links topbar skip".split()),
    frozenset("sidebar side rail widget widgets aside column rightcol leftcol secondary related recommended".split()),
    frozenset("footer foot colophon copyright legal credits bottom".split()),
    frozenset("header head masthead top logo site brand branding tagline hero".split()),
    frozenset("ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo banner dfp".split()),
    frozenset("cookie cookies notice gdpr consent alert popup modal overlay warning announcement message".split()),
    frozenset("comment comments commentlist reply replies respond discussion disqus reader readers".split()),
    frozenset("share social sharing follow tags meta byline author newsletter subscribe signup".split()),
    frozenset("form search login signin register contact input poll".split()),
)
FEATURES = GROUPS + 3 * len(TOKEN_GROUPS) + 26

_BEGIN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/<>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "depth", "text", "links", "mark", "inline", "index")

    def __init__(self, tag: str, parent: Node | None, tokens: int = 0, mark: str | None = None):
        self.tag, self.parent, self.tokens, self.mark = tag, parent, tokens, mark
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent is not None else 0
        self.text, self.links, self.inline, self.index = "", 0, 0, 0
        if parent is not None:
            self.index = len(parent.children)
            parent.children.append(self)


def _attributes(source: str) -> tuple[int, str | None]:
    """Groups of the words in class, id, role and aria-label as bits; the training mark."""
    bits, mark = 0, None
    for name, a, b, c in _ATTRIBUTE.findall(source):
        name = name.lower()
        value = a or b or c
        if name in ("class", "id", "role", "aria-label"):
            words = set(_WORDS.findall(_CAMEL.sub(" ", value).lower()))
            for i, group in enumerate(TOKEN_GROUPS):
                if words & group:
                    bits |= 1 << i
        elif name == "data-mark":
            mark = value
    return bits, mark


class _Tags:
    """Cuts a page into tags and text, in time linear in the page however broken its tags are."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.last_quote = {q: source.rfind(q) for q in "\"'"}
        self.quotes = True

    def token(self, position: int) -> tuple[str | None, str | None, str, str | None, int]:
        """``closing, tag, attributes, text, end`` of what begins at ``position``; comments have neither tag nor text."""
        source = self.source
        if source[position] != "<":
            end = source.find("<", position)
            end = len(source) if end < 0 else end
            return None, None, "", source[position:end], end
        found = _BEGIN.match(source, position) if position < self.last or source.startswith("<!--", position) else None
        if found is None:
            return None, None, "", "<", position + 1
        closing, tag = found.groups()
        if tag is None:
            mark, skip = ("-->", 4) if found.group() == "<!--" else (">", 2)
            end = source.find(mark, position + skip)
            return None, None, "", None, len(source) if end < 0 else end + len(mark)
        end = self.end(found.end())
        return closing, tag, source[found.end() : end - 1], None, end

    def end(self, at: int) -> int:
        """The end of a tag whose attributes begin at ``at``: behind the first ``>`` outside quotes, or behind any."""
        source, begin = self.source, at
        while self.quotes:
            found = _STOP.search(source, at)
            if found is None:
                self.quotes = False  # every later tag would run to the end in vain, too
                break
            quote, at = found.group(), found.end()
            if quote == ">":
                return at
            if at <= self.last_quote[quote]:  # a quote that never closes is a sign like others
                at = source.find(quote, at) + 1
        return source.find(">", begin) + 1


def parse(source: str) -> Node:
    """The tree of a page. Unclosed and stray tags are handled as browsers mostly do; nothing raises."""
    root = Node("#root", None)
    at = root
    block: Node | None = None
    pieces: list[str] = []
    link_chars = 0
    anchors = 0
    foreign = False

    def close_block() -> None:
        nonlocal block, link_chars
        if block is not None:
            block.text = " ".join(html.unescape("".join(pieces)).split())
            block.links = link_chars
            if not block.text:
                block.parent.children.pop()
            block = None
        pieces.clear()
        link_chars = 0

    tags, unclosed = _Tags(source), set()
    position, end = 0, len(source)
    while position < end:
        closing, tag, attributes, text, position = tags.token(position)
        if text is not None:
            if block is None and text.strip():
                block = Node("#block", at)
            if block is not None:
                pieces.append(text)
                if anchors:
                    link_chars += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if foreign and tag not in RAW:
            if tag in CLOSES_P or closing and (tag in FOREIGN or _open(at, tag)):
                foreign = False
            else:
                if block is not None and tag == "option":
                    pieces.append(" ")
                continue
        if closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in INLINE or tag in RAW:
                if block is not None and tag in SPACED:
                    pieces.append(" ")
                continue
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                close_block()
                at = up.parent
            elif tag == "p":
                close_block()
            anchors = 0
            continue
        if tag in RAW:
            stop = None
            if tag not in unclosed:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, position)
            if stop is not None:
                position = stop.end()
            elif tag in ENDLESS:
                position = end
            else:  # without its end tag the element hides nothing
                unclosed.add(tag)
            if block is not None:
                pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                anchors += 1
            if tag in FOREIGN and not attributes.endswith("/"):
                foreign = True
            if block is not None:
                block.inline += 1
                if tag in SPACED:
                    pieces.append(" ")
            continue
        close_block()
        anchors = 0
        if tag in CLOSES_P and _open(at, "p"):
            while at.tag != "p":
                at = at.parent
            at = at.parent
        if tag in SELF_CLOSING:
            ends, up = SELF_CLOSING[tag], at
            last = None
            while up.parent is not None and up.tag not in SCOPES:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                at = last.parent
        bits, mark = _attributes(attributes) if attributes else (0, None)
        if tag in ("html", "body") and _open(at, tag):
            continue
        node = Node(tag, at, bits, mark)
        if tag not in VOID:
            at = node
    close_block()
    return root


def _open(at: Node, tag: str) -> bool:
    """Whether an element of this tag is open and no scope stands between."""
    while at.parent is not None:
        if at.tag == tag:
            return True
        if at.tag in SCOPES and tag == "p":
            return False
        at = at.parent
    return False


def flat(root: Node) -> list[Node]:
    """All nodes below the root in page order."""
    out, stack = [], list(reversed(root.children))
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node of one page: tag, attribute words here and above, density below, depth, siblings."""
    n = len(nodes)
    x = np.zeros((n, FEATURES))
    if not n:
        return x
    place = {id(v): i for i, v in enumerate(nodes)}
    chars, links, words, stops, blocks, elements = (np.zeros(n) for _ in range(6))
    parent = np.full(n, -1)
    groups = len(TOKEN_GROUPS)
    for i, v in enumerate(nodes):
        parent[i] = place.get(id(v.parent), -1)
        if v.tag == "#block":
            chars[i], links[i], blocks[i] = len(v.text), min(v.links, len(v.text)), 1
            words[i] = v.text.count(" ") + 1
            stops[i] = sum(map(v.text.count, ".!?,;。"))
            elements[i] = v.inline
        else:
            elements[i] = 1
    below = np.stack([chars, links, words, stops, blocks, elements], axis=1)
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            below[parent[i]] += below[i]
    total = max(1.0, float(chars.sum()))
    before = np.cumsum(chars) - chars
    above = np.zeros((n, groups), dtype=bool)
    tags_above = np.zeros((n, 7))
    sibling = np.zeros((n, 6))
    for i, v in enumerate(nodes):
        g = TAG_GROUPS.get(v.tag, OTHER_GROUP)
        x[i, g] = 1
        p = parent[i]
        own = [v.tokens >> k & 1 for k in range(groups)]
        x[i, GROUPS : GROUPS + groups] = own
        if p >= 0:
            above[i] = above[p] | (x[p, GROUPS : GROUPS + groups] > 0)
            tags_above[i] = tags_above[p]
            pg = TAG_GROUPS.get(nodes[p].tag, OTHER_GROUP)
            if pg <= 5:
                tags_above[i, pg] += 1
            if pg == 13:
                tags_above[i, 6] += 1
            family = v.parent.children
            sibling[i] = (
                len(family),
                v.index,
                v.index / len(family),
                below[i, 0] / max(1.0, below[p, 0]),
                sum(s.tag == v.tag for s in family[max(0, v.index - 4) : v.index + 5]),
                below[p, 1] / max(1.0, below[p, 0]),
            )
    x[:, GROUPS + groups : GROUPS + 2 * groups] = above
    # words of the nearest marked element above count apart from all those above it
    nearest = np.zeros((n, groups))
    for i in range(n):
        p = parent[i]
        if p >= 0:
            direct = x[p, GROUPS : GROUPS + groups]
            nearest[i] = direct if direct.any() else nearest[p]
    x[:, GROUPS + 2 * groups : GROUPS + 3 * groups] = nearest
    c = GROUPS + 3 * groups
    x[:, c] = np.log1p(below[:, 0])
    x[:, c + 1] = below[:, 1] / np.maximum(1, below[:, 0])
    x[:, c + 2] = below[:, 2] / np.maximum(1, below[:, 4])
    x[:, c + 3] = below[:, 3] / np.maximum(1, below[:, 2])
    x[:, c + 4] = np.log1p(below[:, 4])
    x[:, c + 5] = below[:, 0] / np.maximum(1, below[:, 5])
    x[:, c + 6] = below[:, 0] / total
    x[:, c + 7] = before / total
    x[:, c + 8] = [v.depth for v in nodes]
    x[:, c + 9 : c + 16] = tags_above
    x[:, c + 16 : c + 22] = sibling
    x[:, c + 22] = np.arange(n) / n
    x[:, c + 23] = below[:, 0] > 0
    x[:, c + 24] = np.log1p(total)
    x[:, c + 25] = below[:, 5] / np.maximum(1, below[:, 4])
    return x
