"""Operator 9: main text of web pages by site style trees.

The pages of a host are merged into one style tree: its nodes are chains of block elements with
their classes. A presentation node counts the sequences of children that pages show there, a content
node the texts. A node is important as far as these counts spread (their entropy), more so inside an article; branches of
low importance repeat on page after page and are left out, as are those whose element or class says menu, advert and the
like, unless they wrap the article or nearly all of the page. Each page is parsed once, in time and memory linear in its size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, stored, strings
from .url_filter import host_of

#: Share of the content in a node's importance; the least importance that stays.
CONTENT, LEAST = 0.9, 0.2
#: What an article or main element multiplies its branches' importance by; the share of a page's text that makes a branch a wrapper.
RAISED, WRAPS = 1.5, 0.75
#: Up to so many low branches in all go to every task; more are joined by host, whose pages Spark splits where they are many.
BROADCAST_PATHS = 100_000

# fixed values of HTML: elements by their role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
_NEVER = frozenset("script style noscript template iframe svg canvas object button select option textarea head title audio video math xmp noembed noframes datalist".split())
_ASIDE = frozenset("nav aside form footer dialog menu search".split())
_MAIN = frozenset(("article", "main"))
# fixed values: what classes and ids of branches outside the main text are called
_WORDS = r"(?:ads?|advert\w*|banner|side-?bar\w*|menu\w*|nav\w*|breadcrumbs?|footer|header|masthead|cookies?|notices?|consent|gdpr|pop-?up|modal|comments?|replies|disqus|respond|shar(?:e|ing)|social|promo\w*|sponsor\w*|related|subscribe|newsletter|login|sign-?up|widgets?|toolbar|skip-?link|alert)"
_WHOLE, _PART = re.compile(_WORDS, re.I), re.compile(rf"(?:^|[_-]){_WORDS}(?:$|[_-])", re.I)
# classes that say how a page is laid out, not what a branch is, and those of headings
_LAYOUT = re.compile(r"(?:^|[_-])(?:no|has|with|without)[_-]|(?:^|[_-])(?:entry|post|article|content|story)[_-]+header$", re.I)
_HEADING = re.compile(r"(?:^|[_-])(?:header|masthead)$", re.I)
_START, _STOP = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile("[>\"']")
_NAME = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# fixed values of HTML: what an element ends when it opens, up to which elements
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


def _named(attributes: str) -> str:
    """The class, id and role of an element."""
    return " ".join(filter(None, (x for m in _NAME.finditer(attributes) for x in m.groups()[1:]))) if attributes else ""


def _said(element: str, named: str, main: bool) -> int:
    """Whether element and names say that a branch is outside the main text: 0 no, 1 part of a name or a form does, 2 they do."""
    said = (1 if element == "form" else 2) if element in _ASIDE or (element == "header" and not main) else 0
    for name in named.split() if element not in ("html", "body") else ():
        if _LAYOUT.search(name) or (main and _HEADING.search(name)):
            continue
        said = max(said, 2 if _WHOLE.fullmatch(name) else 1 if _PART.search(name) else 0)
    return said


class Page:
    """The blocks of a page outside ruled-out branches, and what each chain of elements has as children.

    A chain is known by a 64-bit hash of its elements and their classes, from the page's host on. After a quote that nothing closes,
    quotes do not matter to the end of the page, so that no part of it is read twice.
    """

    def __init__(self, source: str, host: str = ""):
        self._root = xxhash.xxh3_64_intdigest(host)
        self.shapes: dict[int, list[str]] = {}
        self._found: list[tuple[int, int, bool, str, int]] = []  # chain, its parent, in an article, text, innermost mark
        # marks: branches that their element or class rules out; each with its strength, the mark around it, its text's size, an article's text inside
        self._said: list[int] = []
        self._around: list[int] = []
        self._size: list[int] = []
        self._in_main: list[bool] = []
        self._article = False
        # element, chain, its parent, never text, innermost mark, that of the article (-2: no article)
        self._stack: list[tuple[str, int, int, bool, int, int]] = [("", self._root, self._root, False, -1, -2)]
        self._open_names: dict[str, int] = {}
        self._text: list[str] = []
        self._parse(source)
        self.blocks: list[tuple[int, int, bool, str]] = self._unmarked()

    def _unmarked(self) -> list[tuple[int, int, bool, str]]:
        """The blocks outside the marked branches; a mark does not count where the branch wraps the main text."""
        for i in range(len(self._said) - 1, -1, -1):  # an inner mark comes after the one around it
            if (j := self._around[i]) >= 0:
                self._size[j] += self._size[i]
                self._in_main[j] |= self._in_main[i]
        most = WRAPS * sum(len(block[3]) for block in self._found)
        for wraps_stay in (False, True):
            out: list[bool] = []
            for i, said in enumerate(self._said):
                wraps = self._size[i] > most
                here = self._in_main[i] + wraps < said and not (wraps_stay and wraps)
                out.append(here or (self._around[i] >= 0 and out[self._around[i]]))
            kept = [block[:4] for block in self._found if block[4] < 0 or not out[block[4]]]
            if kept or self._article:
                break
        return kept

    def _flush(self) -> None:
        if self._text:
            _, chain, parent, never, mark, main = self._stack[-1]
            if not never:
                text = " ".join(html.unescape("".join(self._text)).split())
                if text:
                    self._found.append((chain, parent, main > -2, text, mark))
                    if mark >= 0:
                        self._size[mark] += len(text)
                        self._in_main[mark] |= main == mark
            self._text = []

    def _open(self, name: str, attributes: str) -> None:
        _, chain, parent, never, mark, main = self._stack[-1]
        named = _named(attributes)
        said = 0 if never else _said(name, named, main > -2)
        never = never or name in _NEVER
        if said or name in _NEVER:
            self._flush()
        if name in _MAIN and main == -2 and said < 2:
            main = mark
            self._article |= mark < 0 and not said and not never
        if said and name not in _VOID:
            self._said.append(said)
            self._around.append(mark)
            self._size.append(0)
            self._in_main.append(False)
            mark = len(self._said) - 1
        if name in _BLOCK:
            step = name + ("." + re.sub(r"\d+", "0", named) if named else "")
            self.shapes.setdefault(chain, []).append(step)
            chain, parent = xxhash.xxh3_64_intdigest(step, seed=chain), chain
        if name not in _VOID:
            self._stack.append((name, chain, parent, never, mark, main))
            self._open_names[name] = self._open_names.get(name, 0) + 1

    def _cut(self, at: int) -> None:
        for element in self._stack[at:]:
            self._open_names[element[0]] -= 1
        del self._stack[at:]

    def _close(self, name: str) -> None:
        if not self._open_names.get(name):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                if self._stack[-1][3:] != self._stack[i - 1][3:]:
                    self._flush()
                self._cut(i)
                return

    def _parse(self, source: str) -> None:
        at, text_from, quotes = 0, 0, True
        while (at := source.find("<", at)) >= 0:
            begin = at
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                self._take(source, text_from, begin)
                at = text_from = end + 3 if end >= 0 else len(source)
                continue
            m = _START.match(source, at)
            if not m:
                end = source.find(">", at) if source[at + 1 : at + 2] in ("!", "?", "/") else -1
                if end >= 0:
                    self._take(source, text_from, begin)
                    at = text_from = end + 1
                else:
                    at += 1
                continue
            end = _tag_end(source, m.end()) if quotes else source.find(">", m.end())
            if end < 0 and quotes:
                quotes, end = False, source.find(">", m.end())
            if end < 0:
                break
            self._take(source, text_from, begin)
            at = text_from = self._tag(source, m[2].lower(), bool(m[1]), source[m.end() : end], end + 1)
        self._take(source, text_from, len(source))
        self._flush()

    def _take(self, source: str, start: int, end: int) -> None:
        if end > start:
            self._text.append(source[start:end])

    def _tag(self, source: str, name: str, closing: bool, attributes: str, at: int) -> int:
        """Takes one tag; where the page goes on."""
        edge = name in _BLOCK or name in _RAW
        if edge:
            self._flush()
        elif name == "br":
            self._text.append(" ")
        if closing:
            self._close(name)
            return at
        if name in _RAW:  # no markup inside
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            end = source.find(">", m.end()) if m else -1
            return end + 1 if end >= 0 else len(source)
        if edge:
            if self._open_names.get("p"):  # a block ends an open paragraph
                self._close("p")
            if name in _ENDS:
                self._end_open(name)
        self._open(name, attributes)
        return at

    def _end_open(self, name: str) -> None:
        """A list item, cell or the like ends an open one of the same list or row."""
        same, walls = _ENDS[name]
        if not any(self._open_names.get(x) for x in same):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in walls:
                return
            if self._stack[i][0] in same:
                self._cut(i)
                return

    def text(self) -> str:
        """All blocks outside ruled-out branches, in page order."""
        return "\n".join(block[3] for block in self.blocks)


def _tag_end(source: str, at: int) -> int:
    """Where the tag's ``>`` stands, quoted ones skipped; -1 if none does or a quote stays open."""
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.start()
        at = source.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


BLOCKS = "blocks array<struct<chain:long,parent:long,main:boolean,value:long,text:string>>, shapes array<struct<chain:long,value:long>>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, host, html)`` to page_id, url, host, blocks and shapes."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
    digest = xxhash.xxh3_64_intdigest

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                read = [Page(source, host) for source, host in zip(strings(batch.column(3)).to_pylist(), strings(batch.column(2)).to_pylist(), strict=True)]
                blocks, shapes = [b for p in read for b in p.blocks], [x for p in read for x in p.shapes.items()]
                ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                block = pa.StructArray.from_arrays([signed([b[0] for b in blocks]), signed([b[1] for b in blocks]), pa.array([b[2] for b in blocks], pa.bool_()), signed([digest(b[3]) for b in blocks]), pa.array([b[3] for b in blocks], pa.string())], ["chain", "parent", "main", "value", "text"])
                shape = pa.StructArray.from_arrays([signed([c for c, _ in shapes]), signed([digest(" ".join(steps)) for _, steps in shapes])], ["chain", "value"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends([len(p.blocks) for p in read]), block), pa.ListArray.from_arrays(ends([len(p.shapes) for p in read]), shape)], ["page_id", "url", "host", "blocks", "shapes"])

    return pages.select("page_id", "url", "host", "html").mapInArrow(parse, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, {BLOCKS}")


def _importance(seen: DataFrame, *keys: str) -> DataFrame:
    """``importance`` of each node: the entropy of what it shows, as a share of the most it could have.

    One thing never seen is added to each node, so that a node that few pages have is not judged by them: for n equal ones the
    importance falls from 1 at one towards 0, below 0.2 from seven on.
    """
    counts = seen.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    total = (F.sum("n") + 1).cast("double")
    return counts.groupBy(*keys).agg(((F.log(total) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / total) / F.log(total)).alias("importance"))


def style_nodes(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content nodes ``host, chain, main, parent, importance`` and presentation nodes ``host, chain, importance`` of the merged trees."""
    content = parsed.select("host", F.explode("blocks").alias("b")).select("host", "b.chain", "b.main", "b.parent", "b.value")
    presentation = parsed.select("host", F.explode("shapes").alias("s")).select("host", "s.chain", "s.value")
    return _importance(content, "host", "chain", "main", "parent"), _importance(presentation, "host", "chain")


def low_branches(parsed: DataFrame) -> DataFrame:
    """``host, low``: the branches (chain, main) of each host whose importance, raised inside an article, is below ``LEAST``."""
    content, presentation = style_nodes(parsed)
    raised = F.when(F.col("main"), RAISED).otherwise(1.0)
    text = content.where(F.col("importance") * CONTENT * raised < LEAST).withColumnRenamed("importance", "content")
    both = text.join(presentation.select("host", F.col("chain").alias("parent"), F.col("importance").alias("presentation")), ["host", "parent"], "left")
    importance = (CONTENT * F.col("content") + (1 - CONTENT) * F.coalesce("presentation", F.lit(1.0))) * raised
    return both.where(importance < LEAST).groupBy("host").agg(F.collect_set(F.struct("chain", "main")).alias("low"))


def _left(blocks: Column, low: Column) -> Column:
    """The blocks of branches that aren't low; if all of an article's are, or all there are, the tree doesn't tell and they stay."""
    is_low = lambda b: F.coalesce(F.array_contains(low, F.struct(b["chain"].alias("chain"), b["main"].alias("main"))), F.lit(False))
    lost = F.exists(blocks, lambda b: b["main"]) & F.forall(blocks, lambda b: ~b["main"] | is_low(b))
    some = F.filter(blocks, lambda b: ~is_low(b) | (b["main"] & lost))
    return F.when(low.isNull(), blocks).when(F.size(some) == 0, blocks).otherwise(some)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars.

    The text is the blocks of all branches that are neither of low importance on their host nor named as something
    else by element or class; an article raises the importance of its branches, and a name does not count where its
    branch wraps the article or nearly all of the page. A null html is empty, a null URL has the empty host; repeated rows each get a row and count each.
    Pages of any length and depth are read whole in linear time; markup without an end is text. No pages, no rows; other columns are left out.
    """
    parsed = stored(parsed_pages(pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))))
    low = settled(low_branches(parsed))
    size = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]
    rows = parsed.select("page_id", "url", "host", "blocks").join(F.broadcast(low) if size <= BROADCAST_PATHS else low, "host", "left")
    text = F.array_join(F.transform(_left(F.col("blocks"), F.col("low")), lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
