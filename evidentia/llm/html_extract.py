"""Main text of web pages by line-block distribution.

Markup is read in one pass, in time linear in the page. Each block element is a line, and the borders of containers are
empty lines. Over the lines, text lengths (without link text) are summed in sliding windows. The page's own distribution
sets the threshold: a third of the sum that half of the page's text reaches. The main text begins where the sum surges
to the threshold and ends where it dives below it; all such stretches are found text. The innermost container that
holds nearly all of it is the body of the article. Of what else stands in the body, lines come back that lie between
its first surge and its last dive, or directly in a container with as much found text as a surge, such as a short last paragraph; boxes
after it and before the line at which it surges, such as teasers and linkless lists of other pages, stay out. Article and main elements are containers like
others.

Scripts, styles, comments and what is hidden have no lines. Names say what sums can't: elements that are menus, headers,
footers, sidebars, notices, adverts, forms or reader comments, by tag, role, class or id, give empty lines, whatever their
sums. A name counts for nothing on what holds the page: a form, or an element whose name only has such a word
among others, like main-with-sidebar, with more than half of the text outside what surely is furniture, and any other with more
than nineteen twentieths of all text.
Without names at all (``names=False``) the sums alone part the text from the rest.

On a page whose text is all in links, what stands in an article or main element is the text.

Character references are decoded within one run of text; a reference that a tag cuts in two is none.

Defined cases: null and empty pages give empty texts; unclosed or cut markup ends where its parent or the page ends, and
a tag without an end is dropped with what follows; repeated rows are each extracted; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm._shared import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

_TAG = re.compile(
    r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"<]*"|'[^'<]*')*+)>|([^>]*)>)|[!?][^>]*>)""",
)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Names of HTML elements, as its standard has them.
_RAW = frozenset("script style noscript template textarea title svg iframe math object select canvas audio video xmp noembed noframes".split())
_DROP = frozenset("nav footer aside form head dialog menu button label fieldset datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article aside body center details dialog div fieldset footer form header main menu nav section table td".split())
_WITHOUT = frozenset("p li dt dd td th tr option".split())  # their end tags may be left out

#: Parts of class, id and role names by which page furniture is known.
_FURNITURE = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer sidebar side rail widget related recommended share sharing social newsletter subscribe subscription signup login search pagination pager toolbar copyright legal disclaimer comment comments commentlist disqus respond reply replies discussion complementary contentinfo navigation tags sitemap skip outbrain taboola".split()
)
#: A header named after the content stands over it: title and date.
_CONTENT = frozenset("article content main post entry story body text".split())
_ABOUT = frozenset("has no with without show hide is".split())
_CUT = re.compile(r"<[a-zA-Z/!][^>]*\Z")
_SPLIT = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

LINK, ARTICLE, SKIP, HIDDEN, SURE = 1, 2, 4, 8, 16
#: Of twenty parts of a page's text, how many an element must exceed for its name to count for nothing.
_HOLDS, _MUST_HOLD = 10, 19


def _furniture(attrs: str, heading: bool) -> tuple[int, int]:
    """SKIP or HIDDEN or 0, and how much of the page an element must hold for its name to count for nothing."""
    found, share = 0, _MUST_HOLD
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true":
            return HIDDEN, share
        if name == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                return HIDDEN, share
        elif name in ("class", "id", "role"):
            for word in value.split():
                parts = _SPLIT.findall(_CAMEL.sub("-", word).lower())
                own = [p for p in parts if p in _FURNITURE]
                if own and parts[0] not in _ABOUT and not (own == ["header"] and (heading or parts[0] in _CONTENT)):
                    if not found or len(own) == len(parts):
                        share = _MUST_HOLD if len(own) == len(parts) else _HOLDS
                    found = SKIP
    return found, share


class Lines:
    """Lines of a page in order: their text, length without link text, whether in an article or main element, container.

    An empty text marks a border between containers or a piece of furniture. Containers are numbered as they begin, 0
    is the page; ``parent`` has the one around each.
    """

    def __init__(self, page: str, spared: frozenset[int] = frozenset(), names: bool = True):
        """spared: where the elements begin whose names count for nothing; names: whether any do."""
        self._names = names
        self.text: list[str] = []
        self.size: list[int] = []
        self.inside: list[bool] = []
        self.container: list[int] = []
        self.parent = [0]
        #: Text seen outside links, and outside what surely is furniture; and of it, in elements with names of furniture, by where they begin
        #: and the share that they must hold.
        self.seen, self.plain, self.named = 0, 0, {}
        self._stack: list[tuple[str, int, int, tuple[int, int] | None]] = []  # tag, flags, container, and if named where it begins, and the share
        #: For each container whether it is a table or a cell, whose lines count as its parent's.
        self.table = [False]
        self._before: list[tuple[int, int]] = []
        self._open: dict[str, list[int]] = {}
        self._holders: list[int] = []
        self._parts: list[str] = []
        self._links, self._flags, self._at = 0, 0, 0
        self._read(page, spared)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.text.append(text)
                self.size.append(max(len(text) - self._links, 0))
                self.inside.append(bool(self._flags & ARTICLE))
                self.container.append(self._at)
            self._parts.clear()
        self._links = 0

    def _border(self) -> None:
        if self.text and self.text[-1]:
            self.text.append("")
            self.size.append(0)
            self.inside.append(False)
            self.container.append(-1)

    def _push(self, tag: str, flags: int, container: int, named: tuple[int, int] | None) -> None:
        self._open.setdefault(tag, []).append(len(self._stack))
        if tag in _CONTAINER:
            self._holders.append(len(self._stack))
        self._stack.append((tag, flags, container, named))
        self._before.append((self.seen, self.plain))
        self._flags, self._at = flags, container

    def _shut(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag, _, _, named = self._stack.pop()
            seen, plain = self._before.pop()
            self._open[tag].pop()
            if tag in _CONTAINER:
                self._holders.pop()
            if named:
                self.named[named] = self.seen - seen if named[1] == _MUST_HOLD else self.plain - plain
        self._flags, self._at = self._stack[-1][1:3] if self._stack else (0, 0)

    def _words(self, chunk: str) -> None:
        chunk = html.unescape(chunk) if "&" in chunk else chunk
        if self._flags & HIDDEN:
            return
        if not self._flags & LINK:
            self.seen += len(chunk.strip())
            if not self._flags & SURE:
                self.plain += len(chunk.strip())
        if not self._flags & SKIP:
            self._parts.append(chunk)
            if self._flags & LINK:
                self._links += len(chunk.strip())

    def _end_tag(self, tag: str) -> None:
        depth = self._open[tag][-1] if self._open.get(tag) else -1
        if tag in _BLOCK:
            skipped = self._flags & (SKIP | HIDDEN)
            if not skipped:
                self._flush()
            if depth >= 0:
                self._shut(depth)
            if tag in _CONTAINER and not skipped:
                self._border()
        elif depth >= 0 and not (self._holders and self._holders[-1] > depth):
            self._shut(depth)

    def _start_tag(self, tag: str, attrs: str, at: int, spared: frozenset[int]) -> None:
        stack = self._stack
        if tag in _BLOCK:
            if not self._flags & (SKIP | HIDDEN):
                self._flush()
            if stack and stack[-1][0] == "p":
                self._shut(len(stack) - 1)
            if tag in _WITHOUT and stack and stack[-1][0] == tag:
                self._shut(len(stack) - 1)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            return
        if tag == "body":
            self._shut(0)
        new, named = self._flags, None
        if tag in ("article", "main"):
            new |= ARTICLE
        if tag == "a":
            new |= LINK
        found, share = _furniture(attrs, tag[0] == "h" and tag[1:].isdigit()) if attrs and tag not in ("html", "body", "article", "main") else (0, 0)
        if tag in _DROP or (tag == "header" and not self._flags & ARTICLE):
            found, share = found | SKIP, _HOLDS if tag == "form" and not found else _MUST_HOLD
        if tag == "head":
            found = HIDDEN
        if found == SKIP and self._names:
            named = (at, share)
            new |= SURE if share == _MUST_HOLD else 0
        if found & HIDDEN or (named and at not in spared):
            new |= found
        if tag == "body":
            new = 0
        if tag == "a" and stack and stack[-1][0] == "a":
            self._shut(len(stack) - 1)
        container = self._at
        if tag in _CONTAINER and not new & (SKIP | HIDDEN):
            self._border()
            self.parent.append(container)
            self.table.append(tag in ("table", "td"))
            container = len(self.parent) - 1
        self._push(tag, new, container, named)

    def _read(self, page: str, spared: frozenset[int]) -> None:
        pos, end, last = 0, len(page), page.rfind(">")
        closers: dict[str, re.Pattern] = {}
        unclosed: set[str] = set()
        while pos < end:
            m = _TAG.search(page, pos, last + 1) if pos <= last else None
            if not m:
                self._words(_CUT.sub("", page[pos:]))
                break
            if m.start() > pos:
                self._words(page[pos : m.start()])
            pos = m.end()
            if m[1]:
                stop = page.find("-->", pos)
                pos = end if stop < 0 else stop + 3
            elif m[3]:
                tag, attrs = m[3].lower(), m[4] or m[5] or ""
                if m[2]:
                    self._end_tag(tag)
                elif tag in _RAW:
                    if not attrs.rstrip().endswith("/"):
                        close = None
                        if tag not in unclosed:
                            close = closers.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I)).search(page, pos)
                        if not close:
                            unclosed.add(tag)
                        pos = close.end() if close else end
                else:
                    self._start_tag(tag, attrs, m.start(), spared)
        if not self._flags & (SKIP | HIDDEN):
            self._flush()
        self._shut(0)


def lines_of(page: str, names: bool = True) -> Lines:
    """The lines of a page, where names count for nothing on elements that hold it."""
    lines = Lines(page, names=names)
    most = frozenset(at for (at, share), n in lines.named.items() if 20 * n > share * (lines.seen if share == _MUST_HOLD else lines.plain))
    return Lines(page, most) if most else lines


def window_sums(sizes: list[int], window: int) -> list[int]:
    """The sum of each line and those after it in the window."""
    upto = [0]
    for size in sizes:
        upto.append(upto[-1] + size)
    return [upto[min(i + window, len(sizes))] - upto[i] for i in range(len(sizes))]


def threshold(sizes: list[int], sums: list[int], share: float) -> float:
    """A share of the sum that half of the text reaches; a page's text is at least one character."""
    half, total = 0, sum(sizes)
    for at in sorted(range(len(sizes)), key=sums.__getitem__, reverse=True):
        half += sizes[at]
        if 2 * half >= total:
            return max(share * sums[at], 1.0)
    return 1.0


def stretches(sums: list[int], filled: list[bool], surge: float) -> list[tuple[int, int]]:
    """Where text begins and ends: from a line with text where the sum surges to the next line where it has dived below."""
    out, i = [], 0
    while i < len(sums):
        if not filled[i] or sums[i] < surge:
            i += 1
            continue
        stop = i
        while stop < len(sums) and sums[stop] >= surge:
            stop += 1
        out.append((i, stop))
        i = stop
    return out


def main_text(page: str | None, window: int = 3, share: float = 1 / 3, names: bool = True) -> str:
    """The main text: blocks in page order, joined by a line break."""
    lines = lines_of(page or "", names)
    filled = [bool(t) for t in lines.text]
    sums = window_sums(lines.size, window)
    surge = threshold(lines.size, sums, share)
    kept = stretches(sums, filled, surge)
    if not kept:
        return "\n".join(t for t, inside in zip(lines.text, lines.inside, strict=True) if inside and t)
    # A table's lines count as those of the container around it. Inner containers have greater numbers.
    parent, home = lines.parent, list(range(len(lines.parent)))
    for c in range(1, len(parent)):
        home[c] = home[parent[c]] if lines.table[c] else c
    held, depth = [0] * len(parent), [0] * len(parent)
    for a, b in kept:
        for i in range(a, b):
            if filled[i]:
                held[home[lines.container[i]]] += lines.size[i]
    direct = [n >= surge for n in held]
    for c in range(len(held) - 1, 0, -1):
        held[parent[c]] += held[c]
    for c in range(1, len(depth)):
        depth[c] = depth[parent[c]] + 1
    body = max((c for c, n in enumerate(held) if 10 * n >= 8 * held[0]), key=lambda c: (depth[c], -c))
    within = [False] * len(held)
    for c in range(len(held)):
        within[c] = c == body or (c > 0 and within[parent[c]])
    found = [False] * len(filled)
    for a, b in kept:
        found[a:b] = [True] * (b - a)
    own = [i for i, c in enumerate(lines.container) if found[i] and filled[i] and within[c]]
    first, last = (own[0], own[-1]) if own else (0, -1)
    return "\n".join(
        t for i, (t, c) in enumerate(zip(lines.text, lines.container, strict=True))
        if t and (found[i] or (within[c] and (first < i < last or direct[home[c]])))
    )


def extract(pages: DataFrame, window: int = 3, share: float = 1 / 3) -> DataFrame:
    """page_id, url, text, n_chars of every page. share: of the sum that half of a page's text reaches, what a window must have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(page, window, share) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"]
    ).mapInArrow(run, SCHEMA)
