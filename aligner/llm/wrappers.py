"""Main text of web pages by wrappers: union-free regular expressions over a host's token streams.

A page is a stream of tags and text slots. Repeated runs become groups; the streams of a host's pages are aligned one after the other, and
what doesn't match becomes optional or joins a repeated group. A slot that never changes over three or more different pages is template
text. Slots are judged once per wrapper (containers, links, constancy), and each page's slots take the verdict of the wrapper's slots they
align with. Which containers of a page without article elements are its main text is decided per page.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from zlib import compress, crc32, decompress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import byte_slices

_SLICE_BYTES = 4 << 20
_SALTS = 16
#: Hosts whose partial wrappers a task holds at a time.
_HELD_HOSTS = 500
#: Contents of pages that a task remembers at a time.
_SEEN_PAGES = 100_000
#: A container beside the main one is main text from this share of its text on, or from this many characters where template text is known.
_BESIDE_SHARE, _BESIDE_CHARS = 0.2, 80

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

# Elements of HTML by their role in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                     "strong sub sup time tt u var").split())
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math".split())
_DROPPED = frozenset(("head nav footer aside form button select option textarea dialog menu object canvas audio video map applet input "
                      "fieldset legend datalist output progress meter").split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
_LISTS = frozenset("ul ol dl li table tbody tr blockquote".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPES = frozenset("ul ol dl table select article main section div body".split())
_BOILERPLATE = frozenset((
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion banner nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs pagination pager sidebar aside rail widget footer footnav header masthead topbar toolbar cookie cookies "
    "consent gdpr notice notification alert disclaimer popup modal overlay lightbox share sharing social follow subscribe subscription "
    "newsletter navigation contentinfo complementary alertdialog menubar dialog signup login signin register search related recommended recommendations trending popular comment comments "
    "disqus reply replies respond discussion feedback skip hidden sr screenreader copyright").split())
#: Of these, the ones that an article's own title block uses as well.
_TITLE_WORDS = frozenset(("header", "masthead", "banner"))


class Node:
    """A token or a repeated group of the wrapper. ``at`` holds the page's slots, in a page's own stream only."""

    __slots__ = ("key", "body", "optional", "pages", "chars", "links", "constant", "at", "label")

    def __init__(self, key: str, body: list[Node] | None = None, optional: bool = False, pages: int = 1, chars: int = 0, links: int = 0,
                 constant: int | None = None, at: list[int] | None = None) -> None:
        self.key, self.body, self.optional, self.pages = key, body, optional, pages
        self.chars, self.links, self.constant, self.at, self.label = chars, links, constant, at or [], 0

    def packed(self) -> list:
        return [self.key, None if self.body is None else [n.packed() for n in self.body], self.optional, self.pages, self.chars,
                self.links, self.constant]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], None if x[1] is None else [Node.unpacked(n) for n in x[1]], *x[2:])

    def slots(self) -> Iterator[Node]:
        if self.body is not None:
            for n in self.body:
                yield from n.slots()
        elif self.key[0] == "#":
            yield self


def _element(tag: str, attributes: str) -> str:
    """An element's name and the words of its class, id and role; the same for all pages of a host."""
    if not attributes:
        return tag
    words = {w for m in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())}
    if _HIDDEN.search(attributes):
        words.add("hidden")
    return ".".join([tag, *sorted(words)])


def read(page: str) -> tuple[list[Node], list[str]]:
    """The token stream of a page and the texts of its slots (blocks of inline text, decoded, white space folded)."""
    nodes: list[Node] = []
    texts: list[str] = []
    stack: list[str] = []
    names: list[str] = []
    run: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                nodes.append(Node("#" + "/".join(stack), chars=len(text), links=min(linked, len(text)), constant=crc32(text.encode()),
                                  at=[len(texts)]))
                texts.append(text)
            run.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            run.append(text)
            linked += len(text) if in_link else 0

    def close(count: int) -> None:
        flush()
        for _ in range(count):
            nodes.append(Node("/" + stack.pop()))
            names.pop()

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            add(m["cdata"] or "")
            continue
        tag, attributes, ending = tag.lower(), m["attributes"] or m["attributes2"] or "", m["end"] or m["end2"]
        if tag in _RAW:
            if not ending and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else n
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = max(0, in_link + (-1 if ending else 1))
            key = "" if ending else _element(tag, attributes)
            if key and "." in key and not _BOILERPLATE.isdisjoint(key.split(".")[1:]):
                flush()  # an inline advert or notice is a container
                stack.append(key)
                names.append(tag)
                nodes.append(Node("<" + key))
            elif ending and names and names[-1] == tag:
                close(1)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                run.append(" ")
            continue
        in_link = 0
        if ending:
            if tag in names:
                close(len(names) - max(i for i, x in enumerate(names) if x == tag))
            elif tag == "p":
                flush()
            continue
        flush()
        if "p" in names[-1:]:
            close(1)
        for other in _CLOSES.get(tag, ()):
            scope = max((i for i, x in enumerate(names) if x in _SCOPES), default=-1)
            own = [i for i, x in enumerate(names) if x == other and i > scope]
            if own:
                close(len(names) - own[0])
        if attributes.endswith("/"):
            continue
        key = _element(tag, attributes)
        stack.append(key)
        names.append(tag)
        nodes.append(Node("<" + key))
    close(len(stack))
    return nodes, texts


def _together(a: Node, b: Node) -> Node:
    """One node for two of the same key."""
    body = None if a.body is None else [_together(x, y) for x, y in zip(a.body, b.body, strict=True)]
    return Node(a.key, body, a.optional or b.optional, a.pages + b.pages, a.chars + b.chars, a.links + b.links,
                a.constant if a.constant == b.constant else None, a.at + b.at)


def _group(runs: list[list[Node]]) -> Node:
    """The repeated group of runs with the same keys; a repeated slot is no constant."""
    body = runs[0]
    for run in runs[1:]:
        body = [_together(x, y) for x, y in zip(body, run, strict=True)]
    if len(runs) > 1:
        for node in body:
            for slot in node.slots():
                slot.constant = None
    return Node("(" + " ".join(n.key for n in body) + ")+", body, pages=1)


def collapse(nodes: list[Node], widest: int = 12) -> list[Node]:
    """Adjacent equal runs as repeated groups, short runs first, until there are none."""
    changed = True
    while changed:
        changed = False
        for width in range(1, widest + 1):
            keys = [n.key for n in nodes]
            out, i = [], 0
            while i < len(nodes):
                n = 1
                if i + 2 * width <= len(nodes) and keys[i] == keys[i + width]:
                    while keys[i + n * width:i + (n + 1) * width] == keys[i:i + width]:
                        n += 1
                if n == 1:
                    out.append(nodes[i])
                    i += 1
                    continue
                changed = True
                runs = [nodes[i + k * width:i + (k + 1) * width] for k in range(n)]
                if width == 1 and nodes[i].body is not None:
                    same = nodes[i]
                    for (node,) in runs[1:]:
                        same = _together(same, node)
                    out.append(same)
                else:
                    out.append(_group(runs))
                i += n * width
            nodes = out
    return nodes


def _regrouped(nodes: list[Node], bodies: list[tuple[str, ...]]) -> list[Node]:
    """Runs that occur once here but are repeated on the other side, as groups."""
    first: dict[str, list[tuple[str, ...]]] = defaultdict(list)
    for b in bodies:
        first[b[0]].append(b)
    keys = [n.key for n in nodes]
    out, i = [], 0
    while i < len(nodes):
        body = next((b for b in first.get(keys[i], ()) if tuple(keys[i:i + len(b)]) == b), None)
        if body is None:
            out.append(nodes[i])
            i += 1
        else:
            out.append(_group([nodes[i:i + len(body)]]))
            i += len(body)
    return out


def _bodies(nodes: list[Node]) -> list[tuple[str, ...]]:
    found = {tuple(x.key for x in n.body) for n in nodes if n.body is not None}
    return sorted(found, key=lambda b: (-len(b), b))


def _matches(a: list[Node], b: list[Node]) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, [n.key for n in a], [n.key for n in b], autojunk=False).get_opcodes()


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The wrapper of two wrappers: equal tokens merge, the others become optional."""
    if [n.key for n in a] == [n.key for n in b]:
        return [_together(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _regrouped(a, _bodies(b)), _regrouped(b, _bodies(a))
    out = []
    for kind, i, j, k, m in _matches(a, b):
        if kind == "equal":
            out += [_together(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            for node in a[i:j] + b[k:m]:
                node.optional = True
                out.append(node)
    return collapse(out)


def _dropped(path: list[str]) -> bool:
    """Whether a container says that it isn't main text."""
    inside = False
    for element in path:
        tag, *words = element.split(".")
        if tag in _MAIN:
            inside = True
        if tag in _DROPPED or (tag == "header" and not inside):
            return True
        odd = _BOILERPLATE.intersection(words) if tag not in ("html", "body", *_MAIN) else ()
        if odd and not (inside and odd <= _TITLE_WORDS):
            return True
    return False


def _container(slot: Node) -> tuple[str, ...]:
    """The path of the element that holds a slot's block; lists, tables and quotes belong to the element around them."""
    path = slot.key[1:].split("/")
    if path[-1].split(".")[0] in _HEADINGS:
        path = path[:-1]
    while len(path) > 1 and path[-1].split(".")[0] in _LISTS:
        path = path[:-1]
    return tuple(path)


def _amounts(slots: list[Node], labels: list[int]) -> dict[tuple[str, ...], int]:
    """Characters outside of links per container, of the slots with label 1."""
    amount: dict[tuple[str, ...], int] = defaultdict(int)
    for s, label in zip(slots, labels, strict=True):
        if label == 1:
            amount[_container(s)] += s.chars - s.links
    return amount


def _largest(amount: dict[tuple[str, ...], int]) -> tuple[str, ...]:
    return max(sorted(amount), key=lambda c: amount[c])


def judge(wrapper: list[Node]) -> tuple[str, ...] | None:
    """Labels every slot: 2 main text in an article or main element, 1 possible main text where a page has none of these, 0 neither.

    Returns the container that holds most text of label 1.
    """
    slots = [s for n in wrapper for s in n.slots()]
    pages = max((n.pages for n in wrapper), default=1)
    for s in slots:
        path = s.key[1:].split("/")
        linked = s.links > 0.5 * s.chars
        if _dropped(path):
            s.label = 0
        elif any(e.split(".")[0] in _MAIN for e in path):
            s.label = 2
        else:
            template = s.constant is not None and s.pages >= 3 and 2 * s.pages >= pages
            s.label = 0 if linked or template else 1
    amount = _amounts(slots, [s.label for s in slots])
    return _largest(amount) if amount else None


class Extractor:
    """Applies a host's wrapper to its pages; verdicts are remembered per stream of tokens."""

    def __init__(self, wrapper: list[Node]) -> None:
        self.usual = judge(wrapper)
        self.wrapper, self.bodies = wrapper, _bodies(wrapper)
        self.compared = max((n.pages for n in wrapper), default=1) >= 3
        self.by_key: dict[str, int] = {}
        for node in wrapper:
            for s in node.slots():
                self.by_key[s.key] = max(s.label, self.by_key.get(s.key, 0))
        self.known: dict[tuple[str, ...], list[int]] = {}

    def text(self, page: str) -> str:
        nodes, texts = read(page)
        nodes = _regrouped(collapse(nodes), self.bodies)
        slots = [s for n in nodes for s in n.slots()]
        stream = tuple(n.key for n in nodes)
        labels = self.known.get(stream)
        if labels is None:
            labels = self._labels(nodes, slots)
            if len(self.known) < 4096:
                self.known[stream] = labels
        if 2 in labels:
            main = [s for s, label in zip(slots, labels, strict=True) if label == 2]
        else:
            main = self._main(slots, labels)
        return " ".join(texts[i] for i in sorted(i for s in main for i in s.at))

    def _main(self, slots: list[Node], labels: list[int]) -> list[Node]:
        """The slots of a page's main container and of those beside it that hold much text as well.

        The wrapper's usual container, or the page's own largest one where the usual one is missing or holds little.
        """
        amount = _amounts(slots, labels)
        if not amount:
            return []
        best = _largest(amount)
        if self.usual is not None and amount.get(self.usual, 0) > _BESIDE_SHARE * amount[best]:
            best = self.usual
        beside: dict[tuple[str, ...], int] = defaultdict(int)
        for c, n in amount.items():
            if len(c) >= len(best) and c[:len(best) - 1] == best[:-1]:
                beside[c[:len(best)]] += n
        kept = {c for c, n in beside.items() if n >= _BESIDE_SHARE * beside[best] or (self.compared and n >= _BESIDE_CHARS)} | {best}
        return [s for s, label in zip(slots, labels, strict=True) if label == 1 and _container(s)[:len(best)] in kept]

    def _labels(self, nodes: list[Node], slots: list[Node]) -> list[int]:
        for s in slots:
            s.label = self.by_key.get(s.key, 0)
        for kind, i, j, k, _ in _matches(nodes, self.wrapper):
            if kind == "equal":
                for a, b in zip(nodes[i:j], self.wrapper[k:k + j - i], strict=True):
                    for s, t in zip(a.slots(), b.slots(), strict=True):
                        s.label = t.label
        return [s.label for s in slots]


def _packed(wrapper: list[Node]) -> str:
    return json.dumps([n.packed() for n in wrapper], separators=(",", ":"))


def _unpacked(text: str) -> list[Node]:
    return [Node.unpacked(x) for x in json.loads(text)]


_STREAM = "host string, page long, stream binary"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed token streams of pages; contents repeated within a task are left out as far as they are remembered."""
    seen: set[tuple[str, int]] = set()
    for part in byte_slices(batches, "html", _SLICE_BYTES):
        out: list[tuple[str, int, bytes]] = []
        for host, page, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
            if (host, page) in seen:
                continue
            if len(seen) >= _SEEN_PAGES:
                seen.clear()
            seen.add((host, page))
            out.append((host, page, compress(_packed(collapse(read(html or "")[0])).encode(), 1)))
        hosts, pages, streams = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(streams, pa.binary())],
                                         ["host", "page", "stream"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of a task's streams, per host."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % _SALTS
    held: dict[str, list[Node]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([_packed(w) for w in held.values()], pa.string())],
            ["host", "salt", "wrapper"])

    for part in batches:
        for host, stream in zip(part.column("host").to_pylist(), part.column("stream").to_pylist(), strict=True):
            nodes = _unpacked(decompress(stream).decode())
            held[host] = align(held[host], nodes) if host in held else nodes
            if len(held) >= _HELD_HOSTS:
                yield out()
                held.clear()
    if held:
        yield out()


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    wrapper: list[Node] | None = None
    for text in sorted(table.column("wrapper").to_pylist()):
        nodes = _unpacked(text)
        wrapper = nodes if wrapper is None else align(wrapper, nodes)
    return pa.table({"host": [key[0].as_py()], "wrapper": [_packed(wrapper or [])]},
                    schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))


def infer(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` for rows ``host, html``: every distinct content of a host counts as one page.

    The tasks that read the pages pack their token streams, one stream of each content is kept (told apart by 64 bits), and streams are
    folded per task, then per host and salt, then per host.
    """
    streams = pages.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(_streams, _STREAM)
    distinct = streams.groupBy("host", "page").agg(F.first("stream").alias("stream"))
    partial = distinct.select("host", "stream").mapInArrow(_partial, "host string, salt int, wrapper string")
    salted = partial.groupBy("host", "salt").applyInArrow(_merged, "host string, wrapper string")
    return salted.groupBy("host").applyInArrow(_merged, "host string, wrapper string")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Extractor] = {}
    for part in byte_slices(batches, "html", _SLICE_BYTES):
        texts = []
        for host, page, wrapper in zip(*(part.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
            if host not in known:
                if len(known) >= _HELD_HOSTS:
                    known.clear()
                known[host] = Extractor(_unpacked(wrapper or "[]"))
            texts.append(known[host].text(page or ""))
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; ``text`` is empty where a page has no main text.

    The wrapper of a host is inferred from all its pages; copies of a page count once. Null or empty pages give an empty text; pages without a readable host in
    their url (or a null url) share one wrapper, but each page of these chooses its own containers. Repeated rows and null ids stay; extra columns are ignored; an empty table gives
    an empty result. Whole pages are read, however long.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host.alias("host"))
    wrappers = infer(rows).withColumnRenamed("host", "_host")
    joined = rows.join(wrappers, F.col("host") == F.col("_host"), "left").drop("_host")
    texts = joined.mapInArrow(_extracted, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
