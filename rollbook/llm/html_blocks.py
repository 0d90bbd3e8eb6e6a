"""The blocks of a web page: leaf texts in page order, each with the path of its elements."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

#: Elements that end a block of text; br only puts white space.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose content is never shown as text.
HIDDEN_TAGS = frozenset(
    "applet canvas head iframe math noembed noframes noscript object script style svg template "
    "textarea title".split()
)
#: Of these the content is no markup: it ends only at their end tag.
RAW_TAGS = frozenset(
    "iframe noembed noframes noscript script style textarea title".split()
)
#: Elements that may stand in a head; any other one, or text, ends it without an end tag.
_OF_HEAD = frozenset(
    "base basefont bgsound head link meta noframes noscript script style template title".split()
)
#: Elements that end an open element of the same kind without an end tag.
_SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
#: A search for an open sibling or paragraph stops at these.
_SCOPES = frozenset("table ul ol dl select div section article main body html td th".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(
    r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I
)
_NAME_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_BLANKS = re.compile(r"\s+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.I) for tag in RAW_TAGS}


#: Cells that the tags and names of a path are hashed to.
PATH_CELLS = 256


class Path(NamedTuple):
    """The elements around a block: hashed labels of all (a bit for each cell), innermost tags.

    It has one size at every depth, and that of an inner element follows from the outer one's.
    """

    cells: int = 0
    tag: str | None = None
    outer_tag: str | None = None

    def inside(self, label: str) -> Path:
        """The path within an element of this label."""
        return Path(self.cells | _label_cells(label), label.split(".", 1)[0], self.tag)


@dataclass(frozen=True)
class Block:
    text: str
    path: Path
    linked: float


def path_cell(what: str) -> int:
    return zlib.crc32(what.encode()) % PATH_CELLS


@lru_cache(50_000)
def _label_cells(label: str) -> int:
    """Bits of the tag, the names and their letter trigrams."""
    tag, *names = label.split(".")
    every = [f"<{tag}>", *names]
    every += ["~" + name[k : k + 3] for name in names for k in range(len(name) - 2)]
    cells = 0
    for what in every:
        cells |= 1 << path_cell(what)
    return cells


class _Open:
    """The open elements, with the places of each tag, so that finding one takes one step."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[Path] = [Path()]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.hidden: list[int] = []

    def push(self, tag: str, label: str) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.paths.append(self.paths[-1].inside(label))
        self.places.setdefault(tag, []).append(at)
        if tag in _SCOPES:
            self.scopes.append(at)
        if tag in HIDDEN_TAGS:
            self.hidden.append(at)

    def pop(self) -> str:
        tag = self.tags.pop()
        self.paths.pop()
        self.places[tag].pop()
        if tag in _SCOPES:
            self.scopes.pop()
        if tag in HIDDEN_TAGS:
            self.hidden.pop()
        return tag

    def find(self, tags: tuple[str, ...], scoped: bool) -> int | None:
        """Place of the innermost of ``tags``, none if ``scoped`` and a scope is further in."""
        at = max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=None)
        beyond = scoped and at is not None and self.scopes and self.scopes[-1] > at
        return None if beyond else at

    @property
    def links(self) -> bool:
        return bool(self.places.get("a"))


def _label(tag: str, attributes: str) -> str:
    names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)) if attributes else ""
    words = _NAME_WORDS.findall(names.lower())
    if attributes and _HIDDEN.search(attributes):
        words.append("hidden")
    return ".".join([tag, *words])


def blocks(page: str) -> list[Block]:
    """All blocks of text, character references decoded, white space turned into one blank."""
    out: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _BLANKS.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            share = min(1.0, linked / max(1, sum(map(len, parts))))
            out.append(Block(text, stack.paths[-1], share))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        """Close the elements from ``to`` on; if one ends a block, it ends inside all of them."""
        if any(tag in BLOCK_TAGS for tag in stack.tags[to:]):
            flush()
        while len(stack.tags) > to:
            stack.pop()

    def end_head() -> None:
        if stack.tags and stack.tags[-1] == "head":
            pop(len(stack.tags) - 1)

    def text(piece: str) -> None:
        nonlocal linked
        if stack.hidden and piece.strip():
            end_head()
        if piece and not stack.hidden:
            parts.append(piece)
            linked += len(piece) if stack.links else 0

    at = 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if (place := stack.find((tag,), False)) is not None:
                pop(place)
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag not in _OF_HEAD:
            end_head()
        if tag in _SIBLINGS and (place := stack.find(_SIBLINGS[tag], tag != "tr")) is not None:
            pop(place)
        if tag in BLOCK_TAGS:
            if (place := stack.find(("p",), True)) is not None:
                pop(place)
            flush()
        if tag == "body" and stack.hidden:
            pop(stack.hidden[0])
        attributes = found[3] or found[6] or ""
        if tag == "br":
            text(" ")
        if tag in VOID_TAGS or (attributes.endswith("/") and tag in HIDDEN_TAGS):
            continue
        if tag in RAW_TAGS:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.push(tag, _label(tag, attributes))
    flush()
    return out
