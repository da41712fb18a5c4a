"""A page as text blocks with their place in the tree of containers.

A small tolerant reader of HTML: it follows open elements only as far as
needed to know, for each run of text, the containers around it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names by their role, and words of class and id
# attributes that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul br""".split())
NOISE_TAGS = frozenset("head nav footer aside button select option menu dialog label input".split())
#: Names and forms rule these out never by themselves, nor containers of most of the page.
ROOTS = frozenset("html body main article".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar".split())
FORM_ROLES = frozenset("search form".split())
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|"
    r"consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sidebar|aside|widget|"
    r"widgets|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|comment|comments|commentlist|reply|replies|disqus|"
    r"discussion|share|sharing|social|related|recommended|recommendations|toolbar|pagination|pager|login|search)(?:$|[\s_-])")
#: Article elements of these names are no article.
ASIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:comment|reply|related|recommended|sponsored)(?:$|[\s_-])")
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body article section div main select".split())

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:-->|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>"']|"[^"]*"|'[^']*')*>|[^>]*>)|[!?/][^>]*>)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Element:
    tag: str
    path: str
    main: bool
    #: elements around it, itself among them, that are marked by their kind, and by a name or form alone
    hard: int = 0
    named: tuple[Element, ...] = ()
    #: characters in it, and those of outermost article or main elements that begin in it
    size: int = 0
    around: int = 0
    #: named containers around the outermost article or main element that this is in
    outside: tuple[Element, ...] = ()


@dataclass
class Block:
    """A run of text: its container path, the number of marked-up
    boilerplate elements around it by their kind and by name or form, and
    whether an article or main element is around it."""

    path: str
    text: str
    hard: int
    named: int
    main: bool

    @property
    def noise(self) -> bool:
        return bool(self.hard or self.named)


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: containers in page order: (path, path of the parent)
    containers: list[tuple[str, str]] = field(default_factory=list)


def attributes(source: str) -> tuple[str, str, bool]:
    """(class and id words, role, hidden)."""
    words, role, hidden = [], "", bool(re.search(r"\shidden(?=[\s=/>])", source))
    for name, value in ATTRIBUTE.findall(source):
        value = value.strip("\"'").lower()
        if name.lower() == "role":
            role = value
        elif name.lower() == "style":
            hidden = hidden or bool(HIDDEN.search(value))
        else:
            words.append(value)
    return " ".join(words), role, hidden


#: Longest container path, and the most marked containers that an element
#: keeps; deeper paths stand under the hash of their upper part.
PATH_CHARS = 600
MOST_NAMED = 64


def parse(source: str) -> Page:
    """Time and memory are linear in the length of the source, whatever it
    holds."""
    page, stack, buffer, at = Page(), [Element("", "", False)], [], 0
    last = source.rfind(">")  # no tag ends behind it
    open_tags: Counter[str] = Counter()
    held: list[Element] = []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            top = stack[-1]
            page.blocks.append(Block(top.path, text, top.hard, len(top.named), top.main))
            held.append(top)

    def close(index: int) -> None:
        if any(e.tag in BLOCK for e in stack[index:]):
            flush()
        open_tags.subtract(e.tag for e in stack[index:])
        del stack[index:]

    def nearest(name: str) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0) if open_tags[name] else 0

    while at < len(source):
        m = TAG.search(source, at) if at <= last else None
        if m is None:  # text to the end, or to a comment that never ends
            buffer.append(html.unescape(source[at:].partition("<!--")[0]))
            break
        if m.start() > at:
            buffer.append(html.unescape(source[at:m.start()]))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            place = nearest(name)
            if place and (name in BLOCK or not any(e.tag in BLOCK for e in stack[place:])):
                close(place)
            elif place:
                open_tags[name] -= 1
                del stack[place]
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            if not m["attr"].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in BLOCK:
            flush()
            if name != "br":
                place = nearest("p")
                if place and not any(e.tag in SCOPE for e in stack[place:]):
                    close(place)
            closed = CLOSED_BY.get(name, ())
            for i in range(len(stack) - 1, 0, -1) if closed else ():
                if stack[i].tag in closed:
                    close(i)
                elif stack[i].tag in SCOPE:
                    break
        words, role, hidden = attributes(m["attr"]) if "=" in m["attr"] or "hidden" in m["attr"] else ("", "", False)
        top = stack[-1]
        main = top.main or name == "main" or role == "main" or name == "article" and not (words and ASIDE_WORDS.search(words))
        hard = top.hard + (name in NOISE_TAGS or hidden or role in NOISE_ROLES or not main and name == "header")
        named = name not in ROOTS and (name == "form" or role in FORM_ROLES or bool(words and NOISE_WORDS.search(words))
                                       or not main and bool(words and HEADER_WORDS.search(words)))
        path = top.path
        if name in BLOCK and name not in ("br", "hr"):
            label = re.sub(r"\d+", "", words.split()[0]) if words.split() else ""
            above = top.path if len(top.path) < PATH_CHARS else f"/#{hashlib.md5(top.path.encode()).hexdigest()}"
            path = f"{above}/{name}{'.' if label else ''}{label}"
            page.containers.append((path, top.path))
        if name not in VOID:
            inner = Element(name, path, main, hard, top.named, outside=top.outside if top.main else top.named)
            inner.named += (inner,) if named and len(inner.named) < MOST_NAMED else ()
            stack.append(inner)
            open_tags[name] += 1
    flush()
    lift(page, held)
    return page


def lift(page: Page, held: list[Element]) -> None:
    """Takes back the marks by name or form of containers of most of the
    text; ``held`` are the blocks' elements.  On a page with article or main
    elements their text counts: more than half of it for a container around
    such elements, more than three quarters for one inside; otherwise more
    than half of all text."""
    inside = any(b.main and not b.hard for b in page.blocks)
    total = 0
    for block, element in zip(page.blocks, held):
        if block.hard or inside and not block.main:
            continue
        total += len(block.text)
        for e in element.named:
            e.size += len(block.text)
        for e in element.outside if inside else ():
            e.around += len(block.text)
    for block, element in zip(page.blocks, held):
        if block.named:
            block.named = sum(2 * e.around <= total and (not e.main or 4 * e.size <= 3 * total if inside else 2 * e.size <= total)
                              for e in element.named)
