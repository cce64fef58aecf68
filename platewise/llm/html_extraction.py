"""Main text of web pages, without what a site repeats on its pages.

Every page is read into a tree of elements, in time that grows as the page and at any depth of
nesting. Elements that are never text of an article (scripts, menus, forms, page headers and
footers, and those whose class, id or role says so, see ``_is_chrome``) go at once. Of the others, each subtree has a hash of its names, attributes and text;
hashes are counted per host, and a subtree that ``least_pages`` pages and a share of
``least_share`` of the pages of a host have is part of the site's template and goes as well.
Pages of which the same is left count as one, so copies of a page make no template, and pages
without text do not count. An element that is or holds an ``article`` or ``main`` is never
template, nor is an inline element within text of its parent, which would leave half a
sentence. Where articles hold at least half of the letters of a page, what is inside them
counts once for all pages that say the same in their articles: what an article says stays,
however often it is copied.

If at least half of the letters that are left are inside ``article`` or ``main`` elements, a
page gives the text inside them, any other page all that is left of its body.

Block elements and line breaks separate; white space within a block becomes one blank, and
blocks are joined by one blank. All other elements, also those that go, leave nothing between the
texts around them. Character references are decoded.

Pages are dealt into parts of bounded size, and the template hashes go to the parts that
have them, so a host of a third of all pages is spread over all tasks. Hashes are counted
after a shuffle by hash and page, so no group grows with a host.

Null and empty pages have the empty text. A page without a host counts as of the host "".
Repeated rows are pages of their own. Columns added replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import (
    arrow_schema,
    importable,
    replaced,
    shuffle_partitions,
    slices,
    staged,
    table,
    with_columns,
)

LEAST_PAGES = 5
LEAST_SHARE = 0.5
ROWS_PER_PART = 1000
PART_BYTES = 4 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas button select"
    " option textarea input dialog menu object embed audio video map title noembed noframes".split()
)
#: Elements that separate what is before them from what is after; all others are inline.
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li"
    " main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr"
    " ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that a new one of the listed names ends.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4"
        " h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
}
#: Elements that the end of an inner element never reaches beyond.
SCOPES = frozenset("html body article main section div table td th ul ol nav aside footer form".split())
#: Words of class names and ids of what is not text of an article.
_CHROME = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|masthead|comments?|disqus|reply|replies"
    r"|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|skip"
)
#: Words that may stand beside those in a name that means nothing else.
_BESIDE = frozenset(
    "area bar block bottom box btn button buttons container content footer form global header icons inner item"
    " items left link links list main msg outer page panel post posts primary right secondary section site"
    " slot text top unit wrap wrapper".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
)

#: Quantifiers that give nothing back: a place that is no markup is left after one look.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>",
    re.S,
)
#: Markup that the end of the page cuts off.
_CUT_OFF = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)")


@dataclass
class Element:
    name: str
    attributes: str
    article: bool  #: it, or an element around it, holds the article
    dropped: bool
    parts: list = field(default_factory=list)  #: texts and elements, in order


class _Frame:
    """An element whose subtree is being hashed. ``in_text``: the element around it has text
    of its own."""

    def __init__(self, element: Element, in_text: bool) -> None:
        self.element, self.in_text = element, in_text
        self.hash = xxhash.xxh64(f"{element.name} {element.attributes}")
        self.own = any(isinstance(p, str) and p.strip() for p in element.parts)
        self.text, self.holds = self.own, element.name in ("article", "main")
        self.left = iter(element.parts)


def keys(root: Element) -> tuple[int, bool, list[tuple[int, Element]]]:
    """Hash of a page, whether it has text, and the elements that may be template with the
    hashes of their subtrees. Nesting of any depth takes no recursion."""
    found: list[tuple[int, Element]] = []
    frames = [_Frame(root, False)]
    while True:
        frame = frames[-1]
        for p in frame.left:
            if isinstance(p, str):
                frame.hash.update(" ".join(p.split()) + "\n")
            elif not p.dropped:
                frames.append(_Frame(p, frame.own))
                break
        if frames[-1] is not frame:
            continue
        frames.pop()
        key, name = frame.hash.intdigest(), frame.element.name
        within = frame.in_text and name not in BLOCK
        if frame.text and not frame.holds and not within and name not in ("html", "body"):
            found.append((key, frame.element))
        if not frames:
            return key, frame.text, found
        above = frames[-1]
        above.hash.update(key.to_bytes(8, "little"))
        above.text, above.holds = above.text or frame.text, above.holds or frame.holds


@lru_cache(maxsize=1 << 14)
def names_chrome(names: str, only: bool) -> bool:
    """Whether one of the names (of a class or id) has a word of what is no text; with ``only``
    it must have no other words but such as stand beside them."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        chrome = [bool(_CHROME.fullmatch(w)) for w in words]
        if any(chrome) and (not only or all(c or w in _BESIDE or w.isdigit() for c, w in zip(chrome, words, strict=True))):
            return True
    return False


def _is_chrome(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element goes by its name, role, class or id. Ids are often made from
    headings, and classes inside articles tell of their parts, so those count only if they mean
    nothing else; ids inside articles, and names of headings, do not count."""
    if name in NEVER or (name == "header" and not in_article):
        return True
    classes = attributes.get("class", "")
    if name in ("html", "body", "article", "main") and not _COMMENT.search(classes):
        return False
    if (
        attributes.get("role", "").lower() in _ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
    ):
        return True
    if name in HEADINGS:
        return False
    return names_chrome(classes, in_article) or (not in_article and names_chrome(attributes.get("id", ""), True))


_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.I)


class _Open:
    """The elements that are open, with the places of those that end others or stop an end."""

    def __init__(self, root: Element) -> None:
        self.elements = [root]
        self.places: dict[str, list[int]] = {}
        #: Places of elements that may be ended by others, and of scopes.
        self.marked: list[int] = []
        self.scopes: list[int] = []

    def push(self, element: Element) -> None:
        at, name = len(self.elements), element.name
        self.elements.append(element)
        self.places.setdefault(name, []).append(at)
        if name in SCOPES or name in ENDED_BY:
            self.marked.append(at)
        if name in SCOPES:
            self.scopes.append(at)

    def cut(self, depth: int) -> None:
        while len(self.elements) > depth:
            name = self.elements.pop().name
            self.places[name].pop()
        for places in (self.marked, self.scopes):
            while places and places[-1] >= depth:
                places.pop()

    def begin(self, name: str) -> None:
        """Ends what a new element of this name ends."""
        for at in reversed(self.marked):
            open_name = self.elements[at].name
            if name in ENDED_BY.get(open_name, ()):
                self.cut(at)
                return
            if open_name in SCOPES:
                return

    def end(self, name: str) -> None:
        places = self.places.get(name)
        if places and (name in SCOPES or not self.scopes or places[-1] > self.scopes[-1]):
            self.cut(places[-1])


def parsed(html: str) -> Element:
    """The tree of a page. Unclosed elements end where HTML ends them, or with their parent."""
    root = Element("html", "", False, False)
    stack, at = _Open(root), 0
    # Beyond the last end of a tag nothing is markup but what the end of the page cuts off.
    end = html.rfind(">") + 1
    while match := _MARKUP.search(html, at, max(at, end)):
        if match.start() > at:
            stack.elements[-1].parts.append(unescape(html[at : match.start()]))
        at = match.end()
        name = (match[2] or "").lower()
        if name and match[1]:
            stack.end(name)
        elif name:
            at = _start(stack, name, match[3] or "", html, at)
        elif at == end and match[0].startswith("<!--") and not match[0].endswith("-->"):
            at = len(html)
    cut_off = _CUT_OFF.search(html, at)
    stack.elements[-1].parts.append(unescape(html[at : cut_off.start() if cut_off else len(html)]))
    return root


def _start(stack: _Open, name: str, attributes: str, html: str, at: int) -> int:
    """Puts a new element in; gives the place to read on, beyond raw text."""
    stack.begin(name)
    parent = stack.elements[-1]
    values = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes):
        values["hidden"] = ""
    article = parent.article or name in ("article", "main")
    chrome = parent.dropped or _is_chrome(name, values, parent.article)
    marks = " ".join(f"{k}={values[k]}" for k in ("class", "id", "role", "href") if k in values)
    element = Element(name, marks, article and not chrome, chrome)
    parent.parts.append(element)
    if name in VOID or attributes.rstrip().endswith("/"):
        return at
    if name in RAW:
        end = re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I).search(html, at)
        close = html.find(">", end.end()) if end else -1
        return close + 1 if close >= 0 else len(html)
    stack.push(element)
    return at


def text_of(root: Element, templates: set[int]) -> str:
    """Text of what is left. ``templates`` holds the ``id()`` of elements that go."""
    inside, whole = _texts(root, templates)
    return inside if _is_most(inside, whole) else whole


def _is_most(inside: str, whole: str) -> bool:
    """Whether at least half of the letters (signs that are no white space) are inside articles."""
    return 2 * len(inside.replace(" ", "")) >= len(whole.replace(" ", ""))


def _texts(root: Element, templates: set[int]) -> tuple[str, str]:
    """Text inside articles, and all text."""
    inside: list[str] = []
    out: list[str] = []

    def put(blank: str) -> None:
        out.append(blank)
        inside.append(blank)

    left: list = [root]
    while left:
        e = left.pop()
        if isinstance(e, str):
            put(e)
        elif isinstance(e, tuple):
            text, article = e
            out.append(text)
            if article:
                inside.append(text)
        else:
            gone = e.dropped or id(e) in templates
            if e.name in BLOCK:
                put(" ")
                if not gone:
                    left.append(" ")
            if not gone:
                left.extend((p, e.article) if isinstance(p, str) else p for p in reversed(e.parts))
    return " ".join("".join(inside).split()), " ".join("".join(out).split())


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _keyed(html: bytes, url: str | None) -> tuple[Element, list[tuple[int, Element]], int, int | None]:
    """The page, its possible template elements with their keys, the host in them, the
    host, and a hash of what is left of the page; that is None if it has no text."""
    root = parsed(html.decode("utf-8", "replace"))
    content, text, found = keys(root)
    seed = xxhash.xxh64_intdigest(host_of(url))
    keyed = [(xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed), e) for k, e in found]
    return root, keyed, seed, content if text else None


def _subtrees(html: bytes, url: str | None) -> tuple[Element, list[tuple[int, Element]]]:
    """The page and its possible template elements with their keys, the host in them."""
    return _keyed(html, url)[:2]


def _send(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(part, host, key, content), once in a slice; the key of a page itself is null."""
    for batch, pages in slices(batches, "html"):
        sent: set[tuple[int, int, int | None, int]] = set()
        rows = zip(batch.column("__part").to_pylist(), pages, batch.column("url").to_pylist(), strict=True)
        for part, html, url in rows:
            root, keyed, host, content = _keyed(html, url)
            if content is None:
                continue
            inside, whole = _texts(root, set())
            said = xxhash.xxh64_intdigest(inside) if _is_most(inside, whole) else content
            sent.add((part, host, None, content))
            sent.update((part, host, k, said if e.article else content) for k, e in keyed)
        if sent:
            parts, hosts, keys, contents = zip(*sent, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), _longs(hosts), _longs(keys), _longs(contents)], schema=schema
            )


def _longs(hashes: tuple[int | None, ...]) -> pa.Array:
    """The bits of 64-bit hashes as signed numbers."""
    return pa.array(hashes, pa.uint64()).view(pa.int64())


def _extract(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, known = None, set()
    for batch, pages in slices(batches, "html"):
        out: list[str] = []
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("__part", "__key", "url")]
        for i, (number, key, url) in enumerate(zip(*columns, strict=True)):
            if number != part:
                part, known = number, set()
            if key is not None:
                known.add(key & 0xFFFFFFFFFFFFFFFF)
                continue
            root, keyed = _subtrees(pages[i], url)
            out.append(text_of(root, {id(e) for k, e in keyed if k in known}))
            rows.append(i)
        if rows:
            kept = batch.take(pa.array(rows, pa.int32())).drop_columns(["__part", "__key"])
            yield replaced(kept, schema, text=out, n_chars=[len(t) for t in out])


def extract_text(
    pages: DataFrame,
    least_pages: int = LEAST_PAGES,
    rows_per_part: int = ROWS_PER_PART,
    least_share: float = LEAST_SHARE,
    row_id: Column | None = None,
) -> DataFrame:
    """All pages without ``html``, with ``text`` and ``n_chars``.

    ``row_id`` is an expression that tells rows apart and is the same whenever the table is read;
    without it, pages that are alike in all of id, url and html share a part.
    """
    schema = with_columns(pages.drop("html"), ("text", "string"), ("n_chars", "long"))
    size = pages.agg(F.count("*").alias("rows"), F.sum(F.octet_length("html")).alias("bytes")).first()
    parts = max(1, -(-size["rows"] // rows_per_part), -(-(size["bytes"] or 0) // PART_BYTES))
    told = F.xxhash64("page_id", "url", "html") if row_id is None else F.xxhash64(row_id)
    number = F.pmod(told, F.lit(parts)).cast("int")
    # Columns of the result are made anew, so only the others travel with the pages.
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*kept).withColumn("__part", number)
    fields = pa.schema([("part", pa.int32())] + [(c, pa.int64()) for c in ("host", "key", "content")])
    hashed = importable(rows.select("__part", "url", "html")).mapInArrow(
        partial(_send, schema=fields), "part int, host long, key long, content long"
    )
    # Staged as Parquet, which takes less disk than a checkpoint; and Spark then
    # knows the size of the templates, so that few of them are joined without a shuffle.
    sent = staged(hashed, "html-subtrees")
    distinct = sent.select("host", "key", "content").distinct()
    counted = distinct.groupBy("host", "key").agg(F.count("*").alias("n"))
    often = staged(counted.filter(F.col("n") >= least_pages), "html-often")
    hosts = often.filter("key is null").select("host", (F.col("n") * least_share).alias("least"))
    joined = often.filter("key is not null").join(hosts, "host").filter("n >= least")
    templates = staged(joined.select("key"), "html-templates")
    back = sent.filter("key is not null").select("part", "key").join(templates, "key").distinct()
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "__part"]
    first = back.select(*blank, F.col("part").alias("__part"), F.col("key").alias("__key"))
    both = first.unionByName(rows.withColumn("__key", F.lit(None).cast("long")))
    # A task gets a few parts, however many there are.
    n = max(shuffle_partitions(pages), parts // 4)
    dealt = both.repartition(n, "__part").sortWithinPartitions(
        "__part", F.col("__key").isNull()
    )
    return importable(dealt).mapInArrow(partial(_extract, schema=arrow_schema(schema)), schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", place)
    return extract_text(pages, row_id=F.col("place")).select("page_id", "url", "text", "n_chars")
