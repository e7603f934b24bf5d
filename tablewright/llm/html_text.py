"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by where they stand,
by link density, and by length with stop-word density; what stays open, mostly short blocks, takes
in the second pass the label of the nearest decided block. Where stop words decide for no block,
as in languages that the list does not have, length and link density alone do.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.common import map_rows, text_strings

#: Words of a block from which its stop words decide, and from which few links do no harm.
LONG, MEDIUM = 30, 12
#: Share of stop words that speaks for running text, and share of linked characters against it.
STOP_SHARE, LINK_SHARE = 0.2, 0.5
#: Letters of a block that is long without counting words; share of a page's letters from which a
#: container is the page's frame, so that its name and kind say nothing.
LONG_LETTERS, FRAME_SHARE = 120, 0.8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or
    she that the their they this to was we were which will with you
    als am auch auf aus bei das dass dem den der des die ein eine einen einer es für hat ich im
    ist mit nach nicht noch sich sie sind so über um und von vor war wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne
    nous ou où par pas pour qu que qui sa se ses son sur un une vous
    al como con del el ella esta este fue ha hay la las lo los más mi muy no nos para pero por
    que se sin sobre su sus también un una uno y ya""".split()
)
#: Elements that begin a new block.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol
    p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose nesting is followed.
CONTAINER = frozenset(
    """article aside blockquote body center details dialog div dl fieldset figure footer form head
    header html main menu nav ol section table ul""".split()
)
#: Elements that hold no text of the page.
DROPPED = frozenset(
    """audio button canvas iframe map noscript object option script select style svg template
    textarea title video""".split()
)
#: Elements and roles that hold boilerplate.
ASIDE = frozenset("aside dialog footer form head menu nav".split())
ASIDE_ROLES = frozenset(
    "alert banner complementary contentinfo dialog form menu menubar navigation search".split()
)
#: Words in a class or id that name boilerplate.
ASIDE_NAMES = frozenset(
    """ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment
    comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar
    navigation newsletter notice notices notification pager pagination popup promo promoted
    promotion recommended related replies reply respond search share sharing sidebar signup skip
    social sponsor sponsored subscribe toolbar widget widgets""".split()
)
WHOLE = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[a-z0-9]+")


END_TAGS = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I | re.A) for tag in DROPPED}


@dataclass
class Block:
    """Text with the containers around it (outermost first) and what the first pass looks at."""

    text: str
    linked: int
    path: tuple[int, ...]
    aside: bool
    whole: bool
    named: bool = False  # boilerplate by a name of its own, which says nothing of its neighbours


@dataclass
class Container:
    """An element whose nesting is followed; letters of the blocks in it, and whether one of its
    inner elements is an article."""

    tag: str
    attributes: str
    parent: int
    letters: int = 0
    holds_whole: bool = False


def _names(attributes: str) -> tuple[bool, bool]:
    """Whether the role says boilerplate, and whether class or id do."""
    names = {}
    for m in NAMED.finditer(attributes):
        names[m[1].lower()] = html.unescape(m[2] or m[3] or m[4] or "").lower()
    role = not ASIDE_ROLES.isdisjoint(names.get("role", "").split())
    parts = NAME_PART.findall(names.get("class", "") + " " + names.get("id", ""))
    return role, not ASIDE_NAMES.isdisjoint(parts)


def _aside(c: Container, inside: bool, total: int) -> bool:
    """Whether a container holds boilerplate by its kind or its names."""
    frame = c.letters >= FRAME_SHARE * total
    if c.tag == "form":
        if not (frame or c.holds_whole):
            return True
    elif c.tag in ASIDE or (c.tag == "header" and not inside):
        return True
    if not c.attributes or c.tag in ("html", "body"):
        return False
    role, named = _names(c.attributes)
    if c.tag == "main" or (c.tag == "article" and not inside):
        return role
    return (role or named) and not frame


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; markup may be broken or end anywhere."""
    found: list[tuple[str, int, int, bool]] = []  # text, linked letters, container, own name
    containers = [Container("", "", 0)]
    stack: list[int] = [0]
    words: list[str] = []
    at = linked = anchors = 0
    named = False

    def close() -> None:
        nonlocal linked, named
        text = " ".join("".join(words).split())
        if text:
            found.append((text, linked, stack[-1], named))
            for c in stack:
                containers[c].letters += len(text)
        words.clear()
        linked, named = 0, False

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            own = html.unescape(raw)
            words.append(own)
            if anchors:
                linked += len("".join(own.split()))

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "a":
            anchors = 0 if ends else 1
        elif tag == "br":
            words.append(" ")
        elif tag in DROPPED:
            if tag in BLOCK:
                close()
            if not ends and not attributes.rstrip().endswith("/"):
                stop = END_TAGS[tag].search(page, at)
                at = stop.end() if stop else len(page)
        elif tag in BLOCK:
            close()
            anchors = 0
            if tag not in CONTAINER:
                named = not ends and bool(attributes) and any(_names(attributes))
            elif not ends:
                if tag in WHOLE:
                    for c in stack:
                        containers[c].holds_whole = True
                containers.append(Container(tag, attributes, stack[-1]))
                stack.append(len(containers) - 1)
            elif any(containers[c].tag == tag for c in stack):
                while containers[stack.pop()].tag != tag:
                    pass
    close()
    return _placed(found, containers)


def _placed(found: list[tuple[str, int, int, bool]], containers: list[Container]) -> list[Block]:
    """Blocks with what their containers say, which depends on all that these hold."""
    total = containers[0].letters
    state: list[tuple[tuple[int, ...], bool, bool]] = [((), False, False)]
    for number, c in enumerate(containers[1:], 1):
        path, aside, whole = state[c.parent]
        aside = aside or _aside(c, whole, total)
        state.append(((*path, number), aside, whole or (c.tag in WHOLE and not aside)))
    out = []
    for text, linked, container, named in found:
        path, aside, whole = state[container]
        out.append(Block(text, linked, path, aside, whole, named))
    return out


def first_pass(block: Block) -> bool | None:
    """True for text, False for boilerplate, None if the block itself does not tell."""
    if block.aside or block.named:
        return False
    words = block.text.lower().split()
    letters = sum(map(len, words))
    share = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
    if block.linked > LINK_SHARE * letters and not (block.whole and len(words) >= LONG):
        return False
    if len(words) >= LONG and share >= STOP_SHARE / 2:
        return True
    if len(words) >= MEDIUM and share >= STOP_SHARE:
        return True
    return None


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided one.

    Nearest is the block that shares the deepest container, then the one fewest blocks away, the
    earlier on ties. Each container keeps its decided blocks, so the search goes up from the
    block's own container and looks only left and right. An open block of an article is text if
    no decided block shares the article; elsewhere it is text only if nothing on the page is
    decided. What stands outside a marked article that has text is not part of it.
    """
    inside: dict[int, list[int]] = {0: []}
    for i, (b, own) in enumerate(zip(found, labels)):
        if own is not None and not b.named:
            for c in (0, *b.path):
                inside.setdefault(c, []).append(i)
    marked = {c for b in found if b.whole for c in b.path}
    outer = {c for b in found if not b.whole for c in b.path}
    shells = marked - outer  # containers that lie within an article
    out = []
    for i, (b, own) in enumerate(zip(found, labels)):
        if own is None:
            for c in (*reversed(b.path), 0):
                if b.whole and c not in shells:
                    own = True
                    break
                if spots := inside.get(c):
                    k = bisect_left(spots, i)
                    near = min(spots[max(0, k - 1) : k + 1], key=lambda j: (abs(j - i), j))
                    own = labels[near]
                    break
            else:
                own = True
        out.append(own)
    if any(b.whole and own for b, own in zip(found, out)):
        out = [own and b.whole for b, own in zip(found, out)]
    return out


def without_stop_words(found: list[Block], labels: list[bool | None]) -> list[bool | None]:
    """Long open blocks are text, where the first pass has found none on the page.

    The open blocks are those of few links that do not stand in boilerplate.
    """
    if any(labels):
        return labels
    return [True if own is None and len(b.text) >= LONG_LETTERS else own
            for b, own in zip(found, labels)]


def main_text(page: str) -> str:
    """Blocks of the main text, one a line."""
    found = blocks(page)
    keep = second_pass(found, without_stop_words(found, [first_pass(b) for b in found]))
    return "\n".join(b.text for b, own in zip(found, keep) if own)


OUTPUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(df: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """The ``keep`` columns, text and n_chars of every row.

    The whole page is read; a null or empty page, or one without main text, gives the empty text.
    Null and repeated keys are rows like any other; an empty table gives no rows. ``keep`` may not
    hold columns called text or n_chars; other columns are not read.
    """
    if clash := set(keep) & set(OUTPUT.names):
        raise ValueError(f"rename these columns first: {sorted(clash)}")

    def compute(columns):
        texts = [main_text(p) for p in text_strings(columns[0])]
        return [texts, [len(t) for t in texts]]

    return map_rows(df, [html_column], OUTPUT, compute, keep)
