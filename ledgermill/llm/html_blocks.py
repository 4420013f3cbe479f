"""Leaf blocks of a page's DOM: their text, their ancestors, and features for the chain model."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from ledgermill.llm.crf import feature
from ledgermill.llm.labelled_pages import NAMES

# Elements of HTML by their role in the page's structure.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text to their closing tag and never of the article.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are parsed like others, but whose text is not shown or is a control's.
HIDDEN = ("svg", "select", "template")
FOREIGN = ("svg", "math")
#: Elements that end an open svg or math element, as HTML's tree construction has it.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main aside nav header footer".split())
#: Elements that no list of options holds, so that they end one left open.
ENDS_SELECT = frozenset("p h1 h2 h3 h4 h5 h6 article section main aside nav header footer table ul ol dl form body blockquote pre figure input textarea".split())
#: Elements that tell the part of a page, however deep a block lies below them.
STRUCTURE = ("html", "body", "head", "nav", "aside", "header", "footer", "form", "article", "main", "section", "noscript", "figure", "table", "ul", "ol", "dl")
_INNER = ("nav", "aside", "header", "footer", "form", "article", "main")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that opens closes the open elements of its row, up to the nearest container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article main body html nav aside form blockquote".split())

#: Outermost and innermost elements of a path that are listed; of those between, STRUCTURE and the names in KNOWN_NAMES are.
PATH_ENDS = 64

# a quote opens a value only behind an equals sign; what no ">" ends reaches to the end of the page
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。]")
KNOWN_NAMES = frozenset(part for names in NAMES.values() for name in names for part in _PARTS.findall(name))


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[tuple[str, str], ...]  # (tag, class and id names) from the root
    linked: int  # characters inside links


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order. A line break or an inline element does not end a block."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    named: Counter[str] = Counter()
    pieces: list[str] = []
    linked = [0]
    last_ends: dict[str, int] = {}

    def path() -> tuple[tuple[str, str], ...]:
        if len(stack) <= 2 * PATH_ENDS:
            return tuple(stack)
        between = [(t, "") for t in STRUCTURE if opened[t]] + [("", n) for n in sorted(named) if named[n]]
        return (*stack[:PATH_ENDS], *between, *stack[-PATH_ENDS:])

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag = next((t for t, _ in reversed(stack) if t not in INLINE), "")
                found.append(Block(text, tag, path(), linked[0]))
            pieces.clear()
            linked[0] = 0

    def add(raw: str) -> None:
        if raw and not any(opened[t] for t in HIDDEN):
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if opened["a"]:
                linked[0] += len(text)

    def push(tag: str, names: str) -> None:
        stack.append((tag, names))
        opened[tag] += 1
        if names:
            named.update(KNOWN_NAMES.intersection(_PARTS.findall(names)))

    def close(i: int) -> None:
        for tag, names in stack[i:]:
            opened[tag] -= 1
            if names:
                named.subtract(KNOWN_NAMES.intersection(_PARTS.findall(names)))
        del stack[i:]

    def close_outermost(tags: tuple[str, ...]) -> None:
        close(next(i for i, (t, _) in enumerate(stack) if t in tags))

    def ends_later(tag: str, at: int) -> bool:
        """Whether a closing tag stands at or after a place."""
        if tag not in last_ends:
            last_ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return at <= last_ends[tag]

    at = 0
    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        closing, attributes = match[1], match[3]
        inline = tag in INLINE or tag in HIDDEN or tag in FOREIGN or any(opened[t] for t in FOREIGN)
        if closing:
            if not inline:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        self_closed = attributes.rstrip().endswith("/")
        if tag in RAW and not opened["svg"]:
            if tag in ("textarea", "iframe"):
                flush()
            if ends_later(tag, at):
                at = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at).end()
            elif tag in ("script", "style") and not self_closed:
                at = len(page)
            continue
        if tag in BREAKOUT and any(opened[t] for t in FOREIGN) and not opened["foreignobject"]:
            close_outermost(FOREIGN)
            inline = tag in INLINE
        if tag in ENDS_SELECT and opened["select"]:
            close_outermost(("select",))
        if tag == "br":
            pieces.append(" ")
            continue
        if not inline:
            flush()
        if tag in VOID or (self_closed and (tag in FOREIGN or any(opened[t] for t in FOREIGN))) or (tag == "template" and not ends_later(tag, at)):
            continue
        if not inline:
            # an open paragraph ends at the next block, and with it the inline elements inside
            for i in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[i][0] in CONTAINERS:
                    break
                if stack[i][0] == "p":
                    close(i)
                    break
            siblings = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1) if any(opened[t] for t in siblings) else ():
                if stack[i][0] in siblings:
                    close(i)
                elif stack[i][0] in CONTAINERS:
                    break
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""
        push(tag, names.lower())
    flush()
    return found


_paths: dict[tuple[tuple[str, str], ...], list[int]] = {}
_PATHS_KEPT = 20_000


def _path_features(path: tuple[tuple[str, str], ...]) -> list[int]:
    known = _paths.get(path)
    if known is None:
        if len(_paths) >= _PATHS_KEPT:
            _paths.clear()
        names = {f"in:{tag}" for tag, _ in path if tag} | {f"name:{part}" for _, text in path for part in _PARTS.findall(text)}
        blocks = [tag for tag, _ in path if tag and tag not in INLINE]
        names |= {f"parent:{'>'.join(blocks[-2:])}", f"block:{blocks[-1] if blocks else ''}"}
        if not {"article", "main"} & set(blocks):
            names.add("outside")
        # a form inside a text is not a text inside a form
        names.add(f"inner:{next((tag for tag in reversed(blocks) if tag in _INNER), '')}")
        known = _paths[path] = [feature(n) for n in sorted(names)]
    return known


def _bucket(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def features_of(blocks: list[Block]) -> list[list[int]]:
    rows = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        own = (
            f"words:{_bucket(words, (2, 4, 8, 16, 40))}",
            f"links:{_bucket(b.linked / max(1, len(b.text)), (0.01, 0.3, 0.8))}",
            f"sentences:{_bucket(len(_SENTENCE.findall(b.text)), (1, 2, 4))}",
            f"end:{b.text[-1] if b.text[-1] in '.!?:,' else ''}",
            "rights" if "©" in b.text or "copyright" in b.text.lower() else "no rights",
            f"edge:{min(i, 2)}" if i < 2 else f"edge:{i - len(blocks)}" if len(blocks) - i < 3 else "edge:no",
        )
        rows.append(_path_features(b.path) + [feature(n) for n in own])
    return rows
