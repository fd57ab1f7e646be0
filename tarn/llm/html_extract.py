"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks of text at block-level tags. A linear classifier over
the block's place (landmarks, class and id words) and text (length, sentence
ends, link density) gives the cost of calling it boilerplate or content; these
are the capacities to the two terminals. Edges between neighbouring blocks, and
between blocks of the same container, carry the cost of a change of label. The
maximum flow splits the blocks: those still reachable from the source over
residual edges are content.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.runtime import text_batches

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noframes".split())
SKIP = frozenset("script style textarea title xmp iframe noframes noscript template head svg math object select button option datalist audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FOREIGN = ("svg", "math")
LANDMARK = frozenset("nav footer aside form dialog menu fieldset".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id attributes, and values of role, that mark boilerplate.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar header cookie cookies consent gdpr notice notification popup modal overlay alert comment comments reply replies "
    "respond disqus discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login search widget "
    "pagination pager toolbar copyright legal disclaimer contentinfo complementary dialog form teaser response responses guestbook anzeige".split()
)
#: Beginnings of such words, for names that are written together.
BAD_STEMS = tuple("advert cookie comment sponsor newsletter sidebar breadcrumb promo subscri navig kommentar comentario werbung publicid publicit".split())
GOOD_WORDS = frozenset("article content entry post story main body text prose".split())
#: Phrases that short blocks of boilerplate hold, lower-cased.
PHRASES = (
    "©", "(c) ", "copyright", "all rights reserved", "cookies", "privacy policy", "terms of use", "terms of service", "subscribe", "sign up", "log in",
    "newsletter", "advertisement", "sponsored", "share this", "read more", "leave a comment", "leave a reply", "alle rechte vorbehalten", "tous droits réservés",
    "todos los derechos reservados",
)
#: Tags that an opening tag ends when they are still open above their container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# Weights of the classifier and capacities of the edges, in the same units. A mark of
# boilerplate (or the main landmark) outweighs the edges of a block; what a block's own
# text says doesn't, so that its neighbours can turn it.
W_MAIN, W_LANDMARK, W_BAD, W_GOOD, W_HEADING, W_BIAS = 2.0, -8.0, -6.0, 1.0, 0.5, -1.0
W_LENGTH, W_SENTENCE, W_LINKS, W_PHRASE = 1.5, 0.8, -3.0, -3.0
NEAR, SAME_PARENT, APART = 0.6, 0.6, 0.05

#: A tag's end, or a quoted value that may hold one.
_STOP = re.compile(r""">|=\s*(["'])""")
_COMMENT_END = re.compile("--!?>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An unquoted value, with the slash that may end it.
_VALUE_END = re.compile(r"""=\s*[^\s"'>]+$""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
#: References to characters by numbers with leading zeros, or of more digits than any character has.
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_FAR = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


class Page:
    """Cuts a page into texts and tags, in time that grows with its length."""

    def __init__(self, source: str):
        self.source = source
        # Where no further quote of a kind closes a value; known once a search has failed.
        self.open_from = {'"': len(source) + 1, "'": len(source) + 1}

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, -1 if none does. A ``>`` inside a quoted
        value is part of it; a quote that nothing closes is a character like others."""
        while m := _STOP.search(self.source, at):
            quote = m.group(1)
            if not quote:
                return m.start()
            at = m.end()
            if at < self.open_from[quote]:
                close = self.source.find(quote, at)
                if close < 0:
                    self.open_from[quote] = at
                else:
                    at = close + 1
        return -1

    def comment_end(self, lt: int) -> int:
        """Where the page goes on after ``<!--``; a comment that nothing closes takes the rest."""
        for short in ("<!-->", "<!--->"):
            if self.source.startswith(short, lt):
                return lt + len(short)
        found = _COMMENT_END.search(self.source, lt + 4)
        return found.end() if found else len(self.source)

    def __iter__(self):
        """``("text", str, "")``, ``("open", name, attributes)`` and ``("close", name, "")``."""
        page, at, end = self.source, 0, len(self.source)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                yield "text", page[at:], ""
                return
            if lt > at:
                yield "text", page[at:lt], ""
            if page.startswith("<!--", lt):
                at = self.comment_end(lt)
                continue
            nxt = page[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
                continue
            m = _NAME.match(page, lt + 1 + (nxt == "/"))
            if not m:
                yield "text", "<", ""
                at = lt + 1
                continue
            close = self.tag_end(m.end())
            if close < 0:
                return
            inside = page[m.end() : close]
            name = m.group().lower()
            at = close + 1
            if nxt == "/":
                yield "close", name, ""
                continue
            yield "open", name, inside
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                yield "text", page[at : stop.start() if stop else end], ""
                at = stop.start() if stop else end


def decoded(text: str) -> str:
    """Character references decoded; a number beyond all characters is U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _FAR.sub("�", _ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role speak for boilerplate (or the element is hidden), and for content."""
    words: set[str] = set()
    hidden = False
    for key, a, b, c in _ATTR.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role"):
            words.update(w.lower() for w in _WORD.findall(a or b or c))
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= (a or b or c).strip().lower() == "true"
        elif key == "style":
            hidden |= bool(_NONE.search(a or b or c))
    bad = hidden or bool(words & BAD_WORDS) or any(w.startswith(BAD_STEMS) for w in words)
    return bad, bool(words & GOOD_WORDS)


class Block:
    __slots__ = ("text", "main", "mark", "landmark", "bad", "good", "heading", "links", "parent", "grand")

    def __init__(self, text, main, mark, good, heading, links, parent, grand):
        self.text, self.main, self.mark, self.good = text, main, mark, good
        self.heading, self.links, self.parent, self.grand = heading, links, parent, grand
        self.landmark = self.bad = False


class Mark:
    """An element that speaks for boilerplate, below the marked element that holds it."""

    __slots__ = ("up", "landmark", "bad", "form", "size", "blocks", "inside", "void", "depth", "below")

    def __init__(self, up, landmark, bad, form):
        self.up, self.landmark, self.bad, self.form = up, landmark, bad, form
        self.size, self.blocks, self.inside, self.void = 0, [], [], False
        # How many marks there are from here outwards, and whether a landmark other than a form is one of them.
        self.depth = up.depth + 1 if up else 1
        self.below = landmark and not form or bool(up and up.below)


class Article:
    """An article that is marked, or inside a marked element, and what lies in it."""

    __slots__ = ("up", "marks", "blocks", "open")

    def __init__(self, up):
        self.up, self.marks, self.blocks, self.open = up, [], [], True


class Element:
    __slots__ = ("name", "mark", "good", "number")

    def __init__(self, name, mark, good, number):
        self.name, self.mark, self.good, self.number = name, mark, good, number


class Reader:
    """Reads a page's blocks. Each tag costs a constant, and what it closes."""

    def __init__(self):
        self.out: list[Block] = []
        self.marks: list[Mark] = []
        self.articles: list[Article] = []
        self.stack = [Element("#root", None, False, 0)]
        self.at_name: dict[str, list[int]] = {}
        self.block_level = [0]  # places of the block-level elements in the stack
        self.parts: list[str] = []
        self.links = self.number = self.skip = self.mains = self.goods = self.in_link = 0
        self.cleared = 0  # elements below this place hold the main text and mark nothing

    def flush(self):
        if self.parts:
            text = " ".join(decoded("".join(self.parts)).split())
            self.parts.clear()
            if text:
                holder = self.stack[self.block_level[-1]]
                grand = self.stack[self.block_level[-2]].number if len(self.block_level) > 1 else 0
                links = min(1.0, self.links / len(text))
                self.out.append(Block(text, self.mains > 0, self.mark(), self.goods > 0, holder.name in HEADING, links, holder.number, grand))
                if self.mains and self.articles and self.articles[-1].open:
                    self.articles[-1].blocks.append(self.out[-1])
        self.links = 0

    def mark(self) -> Mark | None:
        return self.stack[-1].mark if len(self.stack) > self.cleared else None

    def push(self, element: Element):
        place = len(self.stack)
        self.stack.append(element)
        self.at_name.setdefault(element.name, []).append(place)
        if element.name not in INLINE:
            self.block_level.append(place)
        self.skip += element.name in SKIP
        self.mains += element.name in MAIN
        self.in_link += element.name == "a"
        self.goods += element.good

    def close_to(self, place: int):
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.at_name[gone.name].pop()
            if gone.name not in INLINE:
                self.block_level.pop()
            self.skip -= gone.name in SKIP
            self.mains -= gone.name in MAIN
            if not self.mains and self.articles:
                self.articles[-1].open = False
            self.in_link -= gone.name == "a"
            self.goods -= gone.good
        self.cleared = min(self.cleared, len(self.stack))

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if none is open."""
        return max((self.at_name[n][-1] for n in names if self.at_name.get(n)), default=0)

    def text(self, text: str):
        if not self.skip:
            self.parts.append(text)
            if self.in_link:
                self.links += len(text.strip())

    def open(self, name: str, attributes: str):
        if name == "br":
            self.parts.append("\n")
            return
        if name not in INLINE and not self.skip:
            self.flush()
            # A block-level tag ends an open paragraph, with what is open in it.
            if self.stack[self.block_level[-1]].name == "p":
                self.close_to(self.block_level[-1])
            if name in ENDS and (place := self.last(ENDS[name])) > self.last(SCOPE[name]):
                self.close_to(place)
            if name == "body":
                self.close_to(1)
        if name in VOID:
            return
        # A slash ends an element only where the page is no HTML: in pictures and formulas.
        if attributes.endswith("/") and (name in FOREIGN or self.last(FOREIGN)) and not _VALUE_END.search(attributes):
            return
        self.number += 1
        bad = good = False
        if attributes and name not in ("body", "html"):
            bad, good = _marks(attributes)
        up = self.mark()
        outermost = name in MAIN and not self.mains
        if outermost and name == "main":
            # What holds the main text is no sidebar, whatever it is called.
            self.cleared = len(self.stack) + 1
            bad, up = False, None
        landmark = name in LANDMARK or name == "header" and not self.mains
        if bad or landmark:
            up = Mark(up, landmark, bad, name == "form")
            self.marks.append(up)
            if self.mains and self.articles and self.articles[-1].open:
                self.articles[-1].marks.append(up)
        if outermost and up:
            # Whether an article lies in a sidebar or among comments, and is one, can be told at the end only.
            self.articles.append(Article(up))
        self.push(Element(name, up, good and name not in MAIN, self.number))

    def close(self, name: str):
        """To the opening tag if there is one; an inline tag closes nothing beyond its block."""
        place = self.last((name,))
        if place and (name not in INLINE or place > self.block_level[-1]):
            if name not in INLINE and not self.skip:
                self.flush()
            self.close_to(place)
        elif not place and name not in INLINE and not self.skip:
            self.flush()


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with what the classifier needs."""
    reader = Reader()
    for kind, name, attributes in Page(page):
        if kind == "text":
            reader.text(name)
        elif kind == "open":
            reader.open(name, attributes)
        else:
            reader.close(name)
    reader.flush()
    free_article(reader.out, reader.articles)
    clear_wrappers(reader.out, reader.marks)
    return reader.out


def free_article(blocks: list[Block], articles: list[Article]) -> None:
    """An article that holds most of the page's text is the main one: marks around it don't
    count, those in it do. Where none does and nothing unmarked scores as content, it is
    the one with the fewest marks around it, of these the longest, unless it lies in a
    landmark. Others keep theirs, as comments do and what stands in sidebars."""
    size = [sum(len(b.text) for b in a.blocks) for a in articles]
    total = sum(len(b.text) for b in blocks)
    free = [a for a, n in zip(articles, size) if 2 * n > total]
    if not free and not any(score(b) > 0 for b in blocks if not b.mark):
        free = [a for a, _ in sorted(zip(articles, size), key=lambda x: (x[0].up.depth, -x[1])) if not a.up.below][:1]
    for a in free:
        for b in a.blocks:
            if b.mark is a.up:
                b.mark = None
        for m in a.marks:
            if m.up is a.up:
                m.up = None


def clear_wrappers(blocks: list[Block], marks: list[Mark]) -> None:
    """Turns the marked elements around each block into its two flags.

    A form, or an element marked by a class word alone, that holds most of the
    page's text, while nothing unmarked scores as content, is the page's wrapper
    and marks nothing. Wrappers in wrappers are found from the outside inwards.
    """
    outer: list[Mark] = []
    for m in marks:
        (m.up.inside if m.up else outer).append(m)
    for b in blocks:
        if b.mark:
            b.mark.blocks.append(b)
            b.mark.size += len(b.text)
    for m in reversed(marks):  # an element comes before what it holds
        if m.up:
            m.up.size += m.size
    total = sum(len(b.text) for b in blocks)
    plain = [b for b in blocks if not b.mark]
    while not any(score(b) > 0 for b in plain):
        # Only an outermost mark counts its text: what is marked inside is judged next.
        largest = max(outer, key=lambda m: m.size, default=None)
        if not largest or 2 * largest.size <= total or not (largest.form or largest.bad and not largest.landmark):
            break
        largest.void = True
        plain, outer = largest.blocks, largest.inside
    # The flags of all marks around, that are not void.
    for m in marks:
        if m.void:
            m.landmark = m.bad = False
        elif m.up:
            m.landmark, m.bad = m.landmark or m.up.landmark, m.bad or m.up.bad
    for b in blocks:
        if b.mark:
            b.landmark, b.bad = b.mark.landmark, b.mark.bad


def score(b: Block) -> float:
    """The classifier: above zero for content."""
    n = len(b.text)
    s = W_BIAS + W_LENGTH * min(n / 120, 2.0) + W_LINKS * b.links
    s += W_SENTENCE * (b.text[-1] in ".!?…:;\"'”»")
    if n < 200 and not b.main:
        low = b.text.lower()
        s += W_PHRASE * any(p in low for p in PHRASES)
    s += W_MAIN * b.main + W_LANDMARK * b.landmark + W_BAD * b.bad + W_GOOD * b.good + W_HEADING * b.heading
    return s


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost; True for the side of the source.

    Leaving the source side costs a positive score, leaving the other side the
    absolute value of a negative one, and each edge between two sides its
    capacity. A block whose score outweighs all of its edges has its label in any
    cut of least cost: it is taken out, its edges become part of its neighbours'
    scores, and maximum flows split what is left, one connected part at a time.
    """
    room = [round(s * 1024) for s in scores]
    near: list[list[tuple[int, int]]] = [[] for _ in scores]
    for a, b, c in edges:
        near[a].append((b, round(c * 1024)))
        near[b].append((a, round(c * 1024)))
    left = [sum(c for _, c in x) for x in near]
    fixed = [abs(r) > c for r, c in zip(room, left)]
    queue = [i for i, f in enumerate(fixed) if f]
    for i in queue:
        for j, c in near[i]:
            if not fixed[j]:
                room[j] += c if room[i] > 0 else -c
                left[j] -= c
                if abs(room[j]) > left[j]:
                    fixed[j] = True
                    queue.append(j)
    label = [f and r > 0 for f, r in zip(fixed, room)]
    seen = list(fixed)
    for i in range(len(scores)):
        if not seen[i]:
            seen[i] = True
            part = [i]
            for v in part:
                for w, _ in near[v]:
                    if not seen[w]:
                        seen[w] = True
                        part.append(w)
            for v in content_side(part, room, near, fixed):
                label[v] = True
    return label


def content_side(part: list[int], scores: list[int], near: list[list[tuple[int, int]]], fixed: list[bool]) -> list[int]:
    """Nodes of a connected part that the maximum flow leaves on the source's side.

    Augments along shortest paths (blocking flows by level).
    """
    if not any(scores[v] > 0 for v in part):
        return []
    number = {v: k for k, v in enumerate(part)}
    n = len(part)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, there: int, back: int):
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for v, k in number.items():
        if scores[v] > 0:
            link(source, k, scores[v], 0)
        elif scores[v] < 0:
            link(k, sink, -scores[v], 0)
        for w, c in near[v]:
            if not fixed[w] and k < number[w]:
                link(k, number[w], c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for v in queue:
            for e in head[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [v for v, k in number.items() if level[k] >= 0]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[v] < len(head[v]):
                e = head[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            else:
                if not path:
                    break
                v = to[path.pop() ^ 1]
                turn[v] += 1
                continue
            path.append(e)
            v = to[e]


def labelled(page: str | None) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks of a page, their scores, and whether the cut calls them content."""
    blocks = blocks_of(page or "")
    scores = [score(b) for b in blocks]
    edges = []
    last_in: dict[int, int] = {}
    for i, b in enumerate(blocks):
        flags = (b.landmark, b.bad, b.main)
        if i:
            a = blocks[i - 1]
            edges.append((i - 1, i, NEAR if (a.landmark, a.bad, a.main) == flags else APART))
        if (j := last_in.get(b.grand)) is not None:
            a = blocks[j]
            edges.append((j, i, SAME_PARENT if (a.landmark, a.bad, a.main) == flags else APART))
        last_in[b.grand] = i
    return blocks, scores, minimum_cut(scores, edges)


def main_blocks(page: str | None) -> list[str]:
    """The texts of the blocks labelled content, in page order."""
    blocks, _, kept = labelled(page)
    return [b.text for b, k in zip(blocks, kept) if k]


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: ``page_id, url, text, n_chars``.

    ``text`` joins the main blocks by one space, references decoded and white
    space inside a block turned into one space; empty if there are none. A null
    or empty page has an empty text. Whole pages are read, in time that grows with
    their length. Bytes that are not UTF-8 become U+FFFD. Repeated rows each keep
    a row; other columns are neither read nor returned; an empty table gives an
    empty result.
    """
    rows = text_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                texts = [" ".join(main_blocks(p.as_py().decode("utf-8", "replace") if p.is_valid else "")) for p in piece.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    schema = T.StructType(
        [
            T.StructField("page_id", pages.schema[id_col].dataType),
            T.StructField("url", pages.schema[url_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    return rows.mapInArrow(run, schema)
