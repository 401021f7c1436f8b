"""Main text of web pages: site templates are removed, then the article is read.

Every element's subtree is hashed with its tag, class, id and text.  Spark
counts, for each host, in how many different pages a subtree occurs; copies of
a page count once.  A subtree that recurs in several pages of its host belongs
to the site's template and is deleted, however many pages the host has: adverts,
notices and boxes take turns, and a host may have several layouts.  Prose inside
an article (paragraphs, headings, quotations, preformatted text) is never taken
for a template, since articles of a site do repeat passages; items of lists and
cells of tables inside an article are one only if they also occur in a large
share of the host's pages.

Parts whose text is new on every page, such as readers' comments, related links
or an advert, recur by their frame alone: the tag, class and id of an element
that is named like such a part.  Such frames are hashed and counted too, and
deleted where the host repeats them.  A host of a single page repeats nothing,
so there the name decides.  Parts that HTML itself marks as no article (menus,
forms, scripts and the like) are deleted on every page.

A page is parsed once.  What is left of it, its text in pieces with the hashes
that each piece hangs on, is written as a table, counted, and read again to be
put together.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed

#: Pages of a host that repeat a frame: the first repetition tells.
FRAME_PAGES = 2
#: A subtree is a template if it occurs in so many different pages of its host; for parts of an article's lists and tables, also in this share of them.
MIN_PAGES, SHARE = 5, 0.2
#: Up to so many template hashes (9 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Names that HTML defines.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split()) | {"li", "dd", "dt"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "optgroup"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_PARTS = frozenset("caption dd dt figcaption li tbody td tfoot th thead tr".split())
_NO_TEXT = frozenset("head script style noscript template svg math iframe object embed canvas audio video map title noembed noframes form fieldset button select textarea input label dialog menu nav aside footer search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())

#: Words in a class or id that name parts of a page beside its article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "cookie cookies consent gdpr notice notices notification disclaimer newsletter subscribe subscription signup login popup modal overlay social share sharing related recommended recommendations "
    "comment comments commentlist disqus replies respond widget widgets toolbar pagination pager skiplink paywall banner".split()
)
_HEADER_MARKS = frozenset("header siteheader pageheader".split())


class Page:
    """The elements of a page in order, and its text with the element it stands in.

    Open elements are closed as browsers do: a block ends an open paragraph, a
    list item the one before, and an end tag everything inside its element; end
    tags without a start are ignored.
    """

    def __init__(self, source: str):
        self.tags, self.marks, self.parents = ["html"], [""], [-1]
        self.noise, self.named, self.article, self.inside = [False], [False], [False], [False]
        self.content: list[list] = [[]]  # for each element its texts and the numbers of its children
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        number = len(self.tags)
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /\n\t") else {}
        mark = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
        words = set(re.findall(r"[a-z]+", mark)) if mark else ()
        inside = self.inside[parent] or self.article[parent]
        role = found.get("role", "").lower()
        main = tag in ("article", "main") or role in ("article", "main") or found.get("itemprop", "") == "articleBody"
        hidden = "hidden" in found or found.get("aria-hidden", "") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        noise = tag in _NO_TEXT or role in _ROLES or bool(hidden) or (tag == "header" and not inside)
        named = not _MARKS.isdisjoint(words) or (not inside and not _HEADER_MARKS.isdisjoint(words))
        self.tags.append(tag)
        self.marks.append(mark)
        self.parents.append(parent)
        self.noise.append(noise and not main)
        self.named.append(named and not noise and not main)
        self.article.append(main)
        self.inside.append(inside)
        self.content.append([])
        self.content[parent].append(number)
        return number

    def _read(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self.content[stack[-1]].append(source[at : m.start()])
            at = m.end()
            if m[1]:
                self._close(stack, m[1].lower())
            elif name := (m[2] or m[4] or "").lower():
                self._make_room(stack, name)
                number = self._open(name, m[3] or "", stack[-1])
                if name in _RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else size
                elif name not in _VOID and not (m[3] or "").endswith("/") or name in _BLOCK - {"hr"}:
                    stack.append(number)
        if at < size:
            self.content[stack[-1]].append(source[at:])

    def _close(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if self.tags[stack[depth]] == name:
                del stack[depth:]
                return
            if name not in _BLOCK and self.tags[stack[depth]] in _BLOCK:
                return  # an inline end tag does not end a block

    def _make_room(self, stack: list[int], name: str) -> None:
        if name in _ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if self.tags[stack[depth]] == "p":
                    del stack[depth:]
                    break
                if self.tags[stack[depth]] in _BLOCK:
                    break
        if name in _SIBLINGS:
            ends, within = _SIBLINGS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if self.tags[stack[depth]] in within:
                    break
                if self.tags[stack[depth]] in ends:
                    del stack[depth:]

    def hashes(self) -> list[int]:
        """A hash of each element's subtree, even, of 63 bits."""
        out = [0] * len(self.tags)
        for number in range(len(self.tags) - 1, -1, -1):
            h = blake2b(f"{self.tags[number]}\0{self.marks[number]}".encode(), digest_size=8)
            for x in self.content[number]:
                text = b"\2%d" % out[x] if isinstance(x, int) else b"\1" + " ".join(x.split()).encode("utf-8", "replace")
                if text != b"\1":
                    h.update(text)
            out[number] = int.from_bytes(h.digest(), "little", signed=True) & ~1
        return out

    def countable(self) -> list[int]:
        """Elements whose subtree may be a template: block elements but prose inside an article, and what holds an article."""
        holds = self._holding()
        return [n for n in range(1, len(self.tags)) if self.tags[n] in _BLOCK and not holds[n] and not self.article[n] and not (self.tags[n] in _PROSE and self.inside[n])]

    def _holding(self) -> list[bool]:
        """Which elements have an article below them that is not itself inside a dropped part of an article."""
        out = [False] * len(self.tags)
        for number in range(len(self.tags) - 1, 0, -1):
            if self.article[number] or out[number]:
                out[self.parents[number]] = True
        return out

    def parts(self) -> Parts:
        """The page's text in pieces, with the hashes that each hangs on."""
        hashes, holds = self.hashes(), self._holding()
        countable = set(self.countable())
        out = Parts(hashes[0])
        hangs = [-1] * len(self.tags)  # for each element the last of its conditions; -2 for what is dropped on every page
        for n in range(1, len(self.tags)):
            parent = self.parents[n]
            exempt = holds[n] and not self.inside[n] and self.tags[n] not in ("nav", "aside", "footer")
            hangs[n] = -2 if self.noise[n] and not exempt else hangs[parent]
            if hangs[n] == -2:
                pass
            elif self.named[n] and not exempt:
                hangs[n] = out.hang(hangs[n], _frame(self.tags[n], self.marks[n]), FRAME)
            if n in countable:
                out.counted.append(hashes[n])
                if hangs[n] != -2:
                    hangs[n] = out.hang(hangs[n], hashes[n], PART if self.inside[n] and self.tags[n] in _PARTS else SUBTREE)
            if self.article[n] and hangs[n] != -2:
                out.articles.append(hangs[n])
        block = 0
        todo: list[tuple[int, int]] = [(0, 0)]
        while todo:
            number, k = todo.pop()
            content = self.content[number]
            if k == len(content):
                block += self.tags[number] in _BLOCK
                continue
            todo.append((number, k + 1))
            x = content[k]
            if not isinstance(x, int):
                out.add(block, hangs[number], self.article[number] or self.inside[number], html.unescape(x))
            elif self.tags[x] in ("br", "wbr"):
                out.add(block, hangs[number], self.article[number] or self.inside[number], " " if self.tags[x] == "br" else "")
            else:
                block += self.tags[x] in _BLOCK
                if hangs[x] != -2:
                    todo.append((x, 0))
        if -1 in out.articles:  # nothing beside the article is ever read
            out.keep_inside()
        return out

    def text(self, template: set[int] | frozenset[int], often: set[int] | frozenset[int] | None = None) -> str:
        """The page's text without its dropped parts, without template subtrees and without repeated frames.

        Parts of an article's lists and tables are looked up in `often`, all
        else in `template`; without `often`, they are looked up there as well.
        """
        return self.parts().text(template, template if often is None else often)


def _frame(tag: str, mark: str) -> int:
    """The hash of an element's frame: odd, as those of subtrees are even."""
    return int.from_bytes(blake2b(f"{tag}\0{mark}\0frame".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) | 1


#: The frame that every page has: it is repeated on hosts of several pages.
PAGE_FRAME = _frame("", "")
#: What a condition is: a subtree, a part of a list or table inside an article, a frame.
SUBTREE, PART, FRAME = 0, 1, 2


class Parts:
    """A parsed page: conditions as a tree, and pieces of text that hang on them."""

    def __init__(self, digest: int):
        self.digest = digest
        self.counted: list[int] = []
        self.parents: list[int] = []
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.articles: list[int] = []  # the condition of each article element
        self.blocks: list[int] = []
        self.hangs: list[int] = []
        self.inside: list[bool] = []
        self.texts: list[str] = []

    def hang(self, parent: int, value: int, kind: int) -> int:
        self.parents.append(parent)
        self.hashes.append(value)
        self.kinds.append(kind)
        return len(self.hashes) - 1

    def add(self, block: int, hangs: int, inside: bool, text: str) -> None:
        if self.blocks and (self.blocks[-1], self.hangs[-1], self.inside[-1]) == (block, hangs, inside):
            self.texts[-1] += text
        elif text and (not text.isspace() or (self.blocks and self.blocks[-1] == block)):  # a block never begins with white space
            self.blocks.append(block)
            self.hangs.append(hangs)
            self.inside.append(inside)
            self.texts.append(text)

    def keep_inside(self) -> None:
        for name in ("blocks", "hangs", "texts"):
            setattr(self, name, [x for x, inside in zip(getattr(self, name), self.inside) if inside])
        self.inside = [True] * len(self.blocks)

    def all_hashes(self) -> list[int]:
        """Subtrees and frames of the page, each once."""
        return sorted({*self.counted, *(h for h, k in zip(self.hashes, self.kinds) if k == FRAME), PAGE_FRAME})

    def text(self, template: set[int] | frozenset[int], often: set[int] | frozenset[int]) -> str:
        alone = PAGE_FRAME not in template
        dropped = [False] * (len(self.hashes) + 1)  # the last stands for no condition
        for n, (parent, value, kind) in enumerate(zip(self.parents, self.hashes, self.kinds)):
            dropped[n] = dropped[parent] or value in (often if kind == PART else template) or (kind == FRAME and alone)
        articles = not all(dropped[n] for n in self.articles)
        blocks: dict[int, list[str]] = {}
        for block, n, inside, text in zip(self.blocks, self.hangs, self.inside, self.texts):
            if not dropped[n] and (inside or not articles):
                blocks.setdefault(block, []).append(text)
        texts = (" ".join("".join(own).split()) for own in blocks.values())
        return "\n\n".join(t for t in texts if t)


_PARTS_KINDS = {
    "page": pa.int64(), "counted": pa.list_(pa.int64()), "parents": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64()), "kinds": pa.list_(pa.int8()), "articles": pa.list_(pa.int32()),
    "blocks": pa.list_(pa.int32()), "hangs": pa.list_(pa.int32()), "inside": pa.list_(pa.bool_()), "texts": pa.list_(pa.string()),
}
_PARTS_TYPES = "page long, counted array<long>, parents array<int>, hashes array<long>, kinds array<tinyint>, articles array<int>, blocks array<int>, hangs array<int>, inside array<boolean>, texts array<string>"
_PIECES = list(_PARTS_KINDS)[2:]


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some megabytes of text each."""
    at = 0
    while at < b.num_rows:
        n = 64
        while n > 1 and b.column(column).slice(at, n).nbytes > 16 << 20:
            n //= 2
        yield b.slice(at, n)
        at += n


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, host, html) becomes (id, url, host) and the page's parts."""
    for b in batches:
        for some in _slices(b, 3):
            pages = [Page(source).parts() for source in some.column(3).to_pylist()]
            columns = [[p.digest for p in pages], [p.all_hashes() for p in pages], *([getattr(p, name) for p in pages] for name in _PIECES)]
            columns = [pa.array(c, kind) for c, kind in zip(columns, _PARTS_KINDS.values())]
            yield pa.RecordBatch.from_arrays([*some.columns[:3], *columns], names=["id", "url", "host", *_PARTS_KINDS])


class Templates:
    """Template hashes by host, for lookups of a page's own hashes."""

    def __init__(self, hosts: pa.ChunkedArray, hashes: np.ndarray, often: np.ndarray):
        coded = hosts.combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((hashes, codes))
        self._hashes, self._often = hashes[order], often[order]
        cuts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        self._places = {host: (int(cuts[k]), int(cuts[k + 1])) for k, host in enumerate(coded.dictionary.to_pylist())}

    def of(self, host: str, hashes: list[int]) -> tuple[list[int], list[int]]:
        """Those of a page's hashes that are templates of its host, and those of them that occur often."""
        a, b = self._places.get(host, (0, 0))
        if a == b:
            return [], []
        own = np.array(hashes, dtype=np.int64)
        at = np.minimum(a + np.searchsorted(self._hashes[a:b], own), b - 1)
        known = self._hashes[at] == own
        return own[known].tolist(), own[known & self._often[at]].tolist()


def _put_together(batches: Iterator[pa.RecordBatch], known: Templates | None) -> Iterator[pa.RecordBatch]:
    """(id, url, host, own hashes, pieces), or with templates already joined (id, url, template, often, pieces), becomes (id, url, text)."""
    for b in batches:
        for some in _slices(b, b.num_columns - 1):
            texts = []
            for first, second, *pieces in zip(*(some.column(i).to_pylist() for i in range(2, some.num_columns))):
                template, often = known.of(first, second) if known else (first, second)
                page = Parts(0)
                for name, value in zip(_PIECES, pieces):
                    setattr(page, name, value)
                texts.append(page.text(frozenset(template or ()), frozenset(often or ())))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def site_templates(parsed: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hash, often): the templates and repeated frames of each host, and whether they occur in that share of its pages.

    `parsed` has host, page (a digest; copies count once) and counted (hashes).
    """
    distinct = parsed.groupBy("host", "page").agg(F.first("counted").alias("counted"))
    counts = distinct.select("host", F.explode("counted").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    frame = F.col("hash").bitwiseAND(1) == 1
    counts = checkpointed(counts.where(F.col("n") >= F.when(frame, FRAME_PAGES).otherwise(min_pages)))
    totals = counts.where(F.col("hash") == PAGE_FRAME).select("host", F.col("n").alias("pages"))
    if totals.count() <= BROADCAST_HASHES:
        totals = F.broadcast(totals)
    often = F.col("n") >= F.coalesce("pages", F.lit(1)) * share
    return checkpointed(counts.join(totals, "host", "left").select("host", "hash", often.alias("often")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """The main text of each page: id_col, url_col, text, n_chars.

    The text is the article's blocks, joined by an empty line; white space
    inside a block is one space, character references are decoded.  A page
    without an article or main element is read as a whole, without its dropped
    parts.  Dropped are template subtrees, repeated frames of elements named
    like side parts (on a host of one page, all such elements) and what HTML
    marks as no article.

    A null or empty page has the empty text.  Pages whose address is null or
    has no host count as one host.  Repeated rows each get their text.  Pages
    of any length are read whole.  No rows give no rows.  Other columns are not
    read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    parsed = checkpointed(rows.mapInArrow(_parsed, f"id {kind}, url string, host string, {_PARTS_TYPES}"))
    templates = site_templates(parsed.select("host", "page", "counted"), min_pages, share)
    if templates.count() <= BROADCAST_HASHES:
        held = templates.toArrow()
        shared = pages.sparkSession.sparkContext.broadcast(Templates(held.column("host"), held.column("hash").to_numpy(), held.column("often").to_numpy()))
        own = parsed.select("id", "url", "host", "counted", *_PIECES)
        out = own.mapInArrow(lambda batches: _put_together(batches, shared.value), f"id {kind}, url string, text string")
    else:
        own = parsed.select("host", "page", F.explode("counted").alias("hash")).distinct().join(templates, ["host", "hash"])
        own = own.groupBy("host", "page").agg(F.collect_list("hash").alias("template"), F.collect_list(F.when(F.col("often"), F.col("hash"))).alias("often"))
        joined = parsed.join(own, ["host", "page"], "left").select("id", "url", "template", "often", *_PIECES)
        out = joined.mapInArrow(lambda batches: _put_together(batches, None), f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
