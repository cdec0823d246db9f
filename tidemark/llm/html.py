"""Main text of web pages: site templates are element subtrees that recur across many pages of one host, inside its main text too."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tasks import of_batches
from tidemark.session import written

#: A subtree is a template if it is on so many pages of its host that differ in their main text (copies of a page are one),
#: and on one in SHARE of the host's pages, or of those of one section, the first folder of the path. A large host's menus
#: fill their sections, while a list or figure that a few articles share stays text. An element of running text outside
#: article and main (a paragraph, never a heading) needs one page in LOOSE.
MIN_PAGES, SHARE, LOOSE = 3, 10, 2
#: No template is more than this part of the text it is deleted from: half inside article and main, three fifths without them.
PART_WITHIN, PART = (1, 2), (3, 5)
#: At most so many templates are broadcast; more are joined with the pages' subtrees by a shuffle on host and hash.
BROADCAST_TEMPLATES = 200_000
#: In that shuffle, templates on more rows than this are joined by broadcast: one task would get all their rows.
HOT_ROWS = 1_000_000

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation object canvas video audio select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded semantics".split())
CONTAINERS = frozenset("div section ul ol dl table figure details address center hgroup".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu head fieldset".split()) | RAW
#: A start tag of a key closes an open element of the value that is nearer than the stop elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead tfoot section article main div body html".split())
# Words of class, id and role that name what is not main text.
NAMED = frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond share sharing social related recommended widget pagination pager toolbar login signup signin search complementary contentinfo alert dialog form".split())
NAMED_OUTSIDE = frozenset("header masthead topbar".split())
# Inside article and main a name counts as a whole: words of NAMED, with words of what holds them around.
FRAMES = frozenset("slot box container wrapper wrap block bar panel inner unit user reader posts articles links list".split())
#: An id is also what links aim at: inside article and main only these words make it a name.
NAMED_IDS = frozenset("ad ads advert advertisement advertising banner cookie cookies consent gdpr newsletter popup sidebar nav navbar breadcrumb breadcrumbs comments disqus replies respond pagination pager toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

#: Tells the hash of a subtree inside the main text from that of the same subtree outside.
_WITHIN = 0x2545F4914F6CDD1D


class Page:
    """Blocks of text and the elements they stand in. A node is (parent, is boilerplate, is main, hash)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.bad, self.main, self.hash = [-1], [""], [False], [""], [0]
        self.blocks: list[tuple[str, int]] = []
        self._stack, self._inside = [0], [[]]
        self._text: list[str] = []
        self._at = 0
        self._muted: list[str] = []
        self._read(html)
        self._measure()

    def _flush(self) -> None:
        self._muted = []
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            self._text = []
            if text:
                self.blocks.append((text, self._at))
                self._inside[-1].append(text)

    def _named(self, tag: str, names: list[tuple[str, str]], words: set[str]) -> bool:
        """Whether class, id or role name what is not main text. The outermost article, and main, are never named so."""
        top = self._stack[-1]
        if tag in ("html", "body", "main") or tag == "article" and not any(self.tag[n] == "article" for n in self._stack):
            return False
        if not self.main[top]:
            return bool(words & NAMED)
        for kind, value in names if words & NAMED and tag not in HEADINGS else ():
            known = NAMED if kind != "id" else NAMED_IDS if tag != "section" else frozenset()
            for token in value.split():
                parts = {x for x in re.split("[_-]+", token) if x}
                if parts & known and parts <= known | FRAMES:
                    return True
        return False

    @staticmethod
    def _names(attributes: str) -> tuple[list[tuple[str, str]], set[str]]:
        names = [(kind.lower(), (a or b or c).lower()) for kind, a, b, c in _ATTRIBUTE.findall(attributes)] if "=" in attributes else []
        return names, {x for _, value in names for x in re.split(r"[\s_-]+", value)}

    def _inline(self, tag: str, closing: str, attributes: str) -> None:
        """An inline element that is hidden or named as boilerplate mutes its text, up to its end or the next block."""
        if self._muted:
            if tag == self._muted[0] and tag not in VOID:
                self._muted.pop() if closing else self._muted.append(tag)
        elif attributes and not closing and tag not in VOID:
            names, words = self._names(attributes)
            if _HIDDEN.search(attributes) or names and self._named(tag, names, words):
                self._muted.append(tag)

    def _open(self, tag: str, attributes: str) -> None:
        names, named = self._names(attributes)
        top = self._stack[-1]
        main = self.main[top] or ("article" if tag == "article" else "main" if tag == "main" or "main" in named and "role" in attributes else "")
        bad = self.bad[top] or tag in BOILERPLATE or self._named(tag, names, named) or not self.main[top] and tag not in ("html", "body", "main", "article") and (tag == "header" or bool(named & NAMED_OUTSIDE)) or bool(attributes and _HIDDEN.search(attributes))
        self.parent.append(top)
        self.tag.append(tag)
        self.bad.append(bad)
        self.main.append(main)
        self.hash.append(0)
        self._stack.append(len(self.tag) - 1)
        self._inside.append([])

    def _close(self) -> None:
        node, inside = self._stack.pop(), self._inside.pop()
        self.hash[node] = xxhash.xxh3_64_intdigest("\x00".join([self.tag[node], *inside])) >> 1
        self._inside[-1].append(f"\x01{self.hash[node]}")

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            m = _TOKEN.search(html, at)
            if not m:
                self._add(html[at:])
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._add(m[0][9:-3])
                continue
            tag = m[2].lower()
            inline = tag in INLINE
            if inline:
                if tag == "br":
                    self._text.append(" ")
                self._inline(tag, m[1], m[3])
                continue
            self._flush()
            if m[1]:
                for depth in range(len(self._stack) - 1, 0, -1):
                    if self.tag[self._stack[depth]] == tag:
                        while len(self._stack) > depth:
                            self._close()
                        break
                continue
            if tag in VOID:
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = _RAW_END[tag].search(html, at)
                self._open(tag, "")
                self._inside[-1].append(html[at : end.start() if end else len(html)])
                self._close()
                at = end.end() if end else len(html)
                continue
            closes = CLOSES.get(tag, {"p"})
            for depth in range(len(self._stack) - 1, 0, -1):
                near = self.tag[self._stack[depth]]
                if near in closes or near == "p":
                    while len(self._stack) > depth:
                        self._close()
                    if near != "p":
                        break
                elif near in STOPS or near == tag:
                    break
            self._open(tag, m[3])
        self._flush()
        while len(self._stack) > 1:
            self._close()

    def _add(self, text: str) -> None:
        if self._muted:
            return
        if not self._text or not "".join(self._text).strip():
            self._at = self._stack[-1]
        self._text.append(text)

    def _measure(self) -> None:
        """root, the node that the main text stands in (0: the whole page), and which nodes stand in it.

        In main: its longest article, if that is half of main's text at least, else main itself. Without main: the longest
        article. Only outermost articles count, and no boilerplate.
        """
        n = len(self.tag)
        self.size = [0] * n
        for text, node in self.blocks:
            if not self.bad[node]:
                self.size[node] += len(text)
        for node in range(n - 1, 0, -1):
            self.size[self.parent[node]] += self.size[node]

        def longest(nodes: list[int]) -> int:
            return max(nodes, key=lambda x: (self.size[x], -x), default=0)

        articles, mains, holder = [], [], [0] * n  # holder: the outermost main around a node
        outer = [False] * n
        for node in range(1, n):
            up = self.parent[node]
            holder[node], outer[node] = holder[up], outer[up] or self.tag[up] == "article"
            if not self.bad[node]:
                if self.tag[node] == "article" and not outer[node]:
                    articles.append(node)
                elif self.main[node] == "main" and not self.main[up] and not holder[node]:
                    mains.append(node)
                    holder[node] = node
        self.root = longest([m for m in mains if self.size[m]])
        if self.root:
            inner = longest([a for a in articles if holder[a] == self.root])
            if inner and self.size[inner] * 2 >= self.size[self.root]:
                self.root = inner
        else:
            self.root = longest([a for a in articles if self.size[a]])
        self.inside = [False] * n
        for node in range(n):
            self.inside[node] = node == self.root or node > 0 and self.inside[self.parent[node]]

    def _candidates(self) -> dict[int, tuple[int, bool]]:
        """node: (hash, whether it is running text) of the elements that may be templates of the main text they stand in."""
        part, of = PART_WITHIN if self.root else PART
        whole, out = self.size[self.root], {}
        for node in range(1, len(self.tag)):
            tag = self.tag[node]
            if node == self.root or not self.inside[node] or self.bad[node] or not 0 < self.size[node] * of <= whole * part:
                continue
            if self.root:
                if tag in CONTAINERS:
                    out[node] = (self.hash[node] ^ _WITHIN, False)
            elif tag not in HEADINGS and tag not in ("html", "body"):
                out[node] = (self.hash[node], tag not in CONTAINERS and tag != "header")
        return out

    def subtrees(self) -> tuple[int, dict[int, bool]]:
        """A hash of the page's main text, by which copies of a page are known, and {hash: is running text} of what may be a template."""
        texts = [t for t, node in self.blocks if self.inside[node] and not self.bad[node]]
        return xxhash.xxh3_64_intdigest("\x00".join(texts)) >> 1, dict(self._candidates().values())

    def marks(self) -> set[int]:
        """Hashes that text() looks for among the templates."""
        return {h for h, _ in self._candidates().values()}

    def text(self, templates: set[int]) -> str:
        found = {node for node, (h, _) in self._candidates().items() if h in templates} if templates else ()
        gone = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            gone[node] = gone[self.parent[node]] or self.bad[node] or node in found
        return "\n\n".join(t for t, node in self.blocks if self.inside[node] and not gone[node])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, section, hash, text, loose) of each page's candidates, and one row with a null hash for the page itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            rows: list[tuple] = []
            for h, s, x in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                text, found = Page(x or "").subtrees()
                rows.append((h, s, None, text, False))
                rows += [(h, s, mark, text, loose) for mark, loose in found.items()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "section", "hash", "text", "loose"])


def _page_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            page, host, hashes = [], [], []
            for p, h, x in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                found = Page(x or "").marks()
                page += [p] * len(found)
                host += [h] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.string()), pa.array(host, pa.string()), pa.array(hashes, pa.int64())], ["page", "host", "hash"])


def _extract(of_host):
    """Text of (page_id, url, html, host) by a broadcast {host: hashes}, or of (page_id, url, html, hashes) without one."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [of_host.value.get(t, ()) if of_host else set(t or ()) for t in part.column(3).to_pylist()]
                texts = [Page(x or "").text(t) for x, t in zip(part.column(2).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return extract


def host_of(url):
    """Host of a URL, lower case, without port; the null or odd URL's host is empty."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^\w+://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def section_of(url):
    """The first folder of a URL's path; empty where the path has none."""
    return F.coalesce(F.regexp_extract(F.col(url), r"^\w+://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def site_templates(pages: DataFrame) -> DataFrame:
    """host, hash, rows: the subtrees that recur on the host's pages (see MIN_PAGES), and how many pages have them.

    Pages count by their different main texts, in the host and in each section. A page's own row, with a null hash, counts
    the pages there are.
    """
    source = pages.select(host_of("url").alias("host"), section_of("url").alias("section"), F.col("html").cast("string").alias("html"))
    per_page = source.mapInArrow(of_batches(_subtrees), "host string, section string, hash long, text long, loose boolean")
    by_text = written(per_page.groupBy("host", "section", "hash", "text").agg(F.count(F.lit(1)).alias("n"), F.min("loose").alias("loose")), "subtrees")

    def often(by: list[str]) -> DataFrame:
        """host, hash of what is on enough pages that share `by`."""
        different = by_text.groupBy(*by, "hash", "text").agg(F.min("loose").alias("loose")) if by == ["host"] else by_text
        counts = different.groupBy(*by, "hash").agg(F.count(F.lit(1)).alias("pages"), F.min("loose").alias("loose"))
        total = counts.where("hash IS NULL").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("pages").alias("all"))
        some = counts.where((F.col("hash").isNotNull()) & (F.col("pages") >= MIN_PAGES))
        same = [F.col(c) == F.col(f"_{c}") for c in by]
        need = F.when(F.col("loose"), F.col("pages") * LOOSE).otherwise(F.col("pages") * SHARE)
        return some.join(total, same).where(need >= F.col("all")).select("host", "hash")

    found = often(["host"]).unionByName(often(["host", "section"])).distinct()
    rows = by_text.where("hash IS NOT NULL").groupBy("host", "hash").agg(F.sum("n").alias("rows"))
    return rows.join(found, ["host", "hash"], "left_semi")


def _templates_of_pages(source: DataFrame, found: DataFrame) -> DataFrame:
    """page, templates: the templates among the subtrees of each different page of source (page, host, html)."""
    marks = source.select("page", "host", "html").mapInArrow(of_batches(_page_subtrees), "page string, host string, hash long")
    named = found.withColumnsRenamed({"host": "_host", "hash": "_hash"})
    hot, rest = (named.where(w).select("_host", "_hash") for w in (F.col("rows") > HOT_ROWS, F.col("rows") <= HOT_ROWS))
    same = (F.col("host") == F.col("_host")) & (F.col("hash") == F.col("_hash"))
    # all rows of hot templates stay where they are; no other (host, hash) that finds a partner has more than HOT_ROWS
    few = marks.join(F.broadcast(hot), same).select("page", "hash")
    cold = marks.join(F.broadcast(hot), same, "left_anti").join(rest, same).select("page", "hash")
    return few.unionByName(cold).groupBy("page").agg(F.collect_set("hash").alias("templates"))  # at most one page's elements


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: blocks of the main text, joined by two newlines.

    Main text is what stands in main's longest article, else in main, else in the longest article, else the page (see
    Page._measure); without boilerplate elements, elements named as such by class, id or role (see _named), and the host's
    templates (see MIN_PAGES). A heading is never a template, nor a paragraph inside article and main, however often it
    recurs. Null html is empty; a null url's host is empty; copies of a page count once for templates, whatever their
    addresses; an empty table gives no row; other columns are ignored.
    """
    found = written(site_templates(pages), "templates")
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    if found.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        of_host: dict[str, set[int]] = {}
        for host, h in zip(*(c.to_pylist() for c in found.select("host", "hash").toArrow().columns), strict=True):
            of_host.setdefault(host, set()).add(h)
        joined, shared = source, pages.sparkSession.sparkContext.broadcast(of_host)
    else:  # equal pages of a host have equal templates, so a digest serves as the key of a page
        source = source.withColumn("page", F.sha2(F.concat_ws("\n", "host", "html"), 256))
        theirs = written(_templates_of_pages(source, found), "found").withColumnRenamed("page", "_page")
        joined, shared = source.join(theirs, F.col("page") == F.col("_page"), "left").select("page_id", "url", "html", "templates"), None
    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(of_batches(_extract(shared)), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
