"""Main text of web pages by a site style tree: the pages of a host are merged, branches of low importance go.

1. Every whole page becomes its blocks: the text between the borders of block elements, character references
   decoded, white space (Unicode's) as one space. A block belongs to a leaf, the path of its elements from the root; an
   element's part of the path is its tag, role, and its classes and id without numbers of several digits. An article (else a main
   element) in the page is part of the root's key, as pages with and without one are presented differently. Elements
   nested deeper than ``DEEPEST`` count as siblings, as in browsers.
2. The pages of a host are merged by paths: this is the style tree. A node's presentation importance is the entropy
   of its styles (the sequences of its children's tags) over the node's pages; a leaf's content importance is 1 less
   the mean entropy of its texts over its pages, times the share that is no link text. Both are relative to the
   logarithm of the number of pages, so a text on every page has no importance and one on a single page all. Of pages of
   equal blocks one is counted, and nodes on fewer than ``MIN_PAGES`` pages, or of pages without a host, have importance 1.
3. A branch's importance mixes both: with l styles, ``(1 - GAMMA**l)`` times its presentation's and ``GAMMA**l`` times the mean content
   importance of the leaves below. Roles weigh in as presentation: branches that their tag, role or class names as menu, header
   (outside an article), footer, sidebar, notice, advert, form or comments have none, nor has what lies outside the article
   of a page that has one; plain paragraphs, headings, lists, quotations and tables of an article keep all.
4. A leaf goes if the least importance of its branches is below ``LEAST``. Pages of a host with the same set of
   leaves share what goes, so that set is joined to the pages and no text is exchanged where those sets are few.

Scripts, styles, templates, controls, comments of the markup and the head have no text. Null or empty html: empty text.
Null or repeated page_ids and urls: every row has its own result, with its own id and url. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, schema_columns

GAMMA, LEAST, MIN_PAGES, DEEPEST = 0.9, 0.2, 4, 512
#: Elements that begin and end blocks.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption "
    "header footer nav aside form fieldset legend address details summary dialog menu hgroup center".split()
)
#: Elements without any text of the page.
SILENT = frozenset("head script style template noscript iframe object svg math canvas audio video select textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element that opens closes first, if that is open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("html body main article section div ul ol dl menu table td th blockquote form nav aside header footer fieldset details figure".split())
#: Tags, roles and words in classes and ids of branches that are no part of an article.
NOISE_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "footer masthead comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar skip search form copyright teaser".split()
)
#: Beginnings of classes that tell a state.
STATES = ("has-", "with-", "no-", "is-")
#: Text elements that an article keeps, unless their class says otherwise.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption hgroup header address".split())
_WORD, _DIGITS = re.compile(r"[a-z]+"), re.compile(r"\d{2,}")
_STAGED = (
    "rid long, page_id long, url string, host string, digest long, template long, blocks array<struct<leaf:long,text:string>>, "
    "leaves array<struct<leaf:long,chain:array<long>,allowed:boolean,plain:boolean,links:double>>, styles array<struct<node:long,style:long>>, features array<struct<leaf:long,feature:long,n:int>>"
)


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    """The host of an address, without user, port and capitals; empty if there is none."""
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found.group(1).lower() if found else ""


class Element:
    """An open element: its path from the root and what the path says about text in it."""

    __slots__ = ("tag", "key", "up", "node", "noise", "zone", "plain", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None], up: "Element | None"):
        names = [*(attrs.get("class") or "").lower().split(), *([attrs["id"].lower()] if attrs.get("id") else [])]
        role = (attrs.get("role") or "").lower()
        self.tag, self.up, self.children = tag, up, []
        self.key = " ".join([tag, role, *sorted(_DIGITS.sub("", n) for n in names)])
        self.zone = max(up.zone if up else 0, 2 if tag == "article" or attrs.get("itemprop") == "articleBody" else 1 if tag == "main" or role == "main" else 0)
        # "has-sidebar" is a state and names nothing; of a container of the whole page or article a class must say it as a whole
        named = [n for n in names if not n.startswith(STATES)]
        words = named if tag in ("html", "body", "main", "article") else [w for n in named for w in _WORD.findall(n)]
        own = tag in NOISE_TAGS or role in NOISE_ROLES or not NOISE_WORDS.isdisjoint(words) or not self.zone and (tag == "header" or "header" in words)
        self.noise = own or bool(up and up.noise)
        begins = bool(up) and up.zone < self.zone
        self.plain = not own and self.zone > 0 and (begins or up.plain and tag in PLAIN and not names)
        self.node = 0


class PageBlocks(HTMLParser):
    """The blocks (element, text, characters in links) of one page, in its order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[Element, str, int]] = []
        self.root = Element("#", {}, None)
        self.made, self.stack, self.buffer = [self.root], [self.root], []
        self.linked, self.in_link, self.silent = 0, False, ""

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.blocks.append((self.stack[-1], text, self.linked))
        self.buffer, self.linked, self.in_link = [], 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            return
        if tag in SILENT:
            self.silent = tag
        elif tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "wbr", "img", "input"):
                self.buffer.append("" if tag == "wbr" else " ")
        elif tag in BLOCKS:
            self.flush()
            self.close_implied(tag)
            self.open(tag, dict(attrs))
        else:
            self.in_link = self.in_link or tag == "a"
            if any(k in ("class", "id", "role") for k, _ in attrs):
                inline = Element(tag, dict(attrs), self.stack[-1])
                if inline.noise and not self.stack[-1].noise:  # a branch of its own inside a block
                    self.flush()
                    self.open(tag, dict(attrs))

    def open(self, tag: str, attrs: dict[str, str | None]) -> None:
        if len(self.stack) > DEEPEST:
            self.stack.pop()
        made = Element(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(tag)
        self.stack.append(made)
        self.made.append(made)

    def close_implied(self, tag: str) -> None:
        closed = CLOSES.get(tag, set())
        for i in range(len(self.stack) - 1, 0, -1):
            at = self.stack[i].tag
            if at in closed:
                del self.stack[i:]
                if tag not in ("tr", "td", "th"):
                    return
            elif at == "p":  # a paragraph ends where a block begins
                del self.stack[i:]
            elif at in HOLDERS:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end of a tag says nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.silent = "" if tag == self.silent else self.silent
            return
        if tag == "a":
            self.in_link = False
        for i in range(len(self.stack) - 1, 0, -1):
            at = self.stack[i].tag
            if at == tag:
                self.flush()
                del self.stack[i:]
                return
            if tag not in BLOCKS and at in BLOCKS:  # an inline element doesn't end blocks
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)
            self.linked += len("".join(data.split())) if self.in_link else 0

    def finish(self, html: str) -> int:
        """Reads the page; its zone: 2 where it has an article with text, 1 a main element, else 0."""
        self.feed(html)
        self.close()
        self.flush()
        zone = max((e.zone for e, _, _ in self.blocks if not e.noise), default=0)
        self.root.node = hashed(f"# {zone}")
        for e in self.made[1:]:
            e.node = hashed(f"{e.up.node} {e.key}")
        return zone


def staged_page(html: str) -> tuple:
    """digest, template, blocks, leaves, styles and features of a page (see ``_STAGED``)."""
    page = PageBlocks()
    zone = page.finish(html)
    leaves: dict[int, list] = {}
    features: Counter = Counter()
    for e, text, linked in page.blocks:
        if e.node not in leaves:
            chain, at = [], e
            while at is not None:
                chain.append(at.node)
                at = at.up
            leaves[e.node] = [chain, not e.noise and e.zone >= zone, e.plain, 0, 0]
        leaves[e.node][3] += linked
        leaves[e.node][4] += len(text) - text.count(" ")
        features[e.node, hashed(text)] += 1
    styles: dict[int, list[str]] = {}
    for e in page.made:
        styles.setdefault(e.node, []).append(" ".join(e.children))
    return (
        hashed("\n".join(t for _, t, _ in page.blocks)),
        hashed(" ".join(map(str, sorted(leaves)))),
        [(e.node, t) for e, t, _ in page.blocks],
        [(leaf, chain, allowed, plain, linked / max(chars, 1)) for leaf, (chain, allowed, plain, linked, chars) in leaves.items()],
        [(node, hashed("/".join(s))) for node, s in styles.items()],
        [(leaf, feature, n) for (leaf, feature), n in features.items()],
    )


def _structs(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.StructArray:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _lists(names: list[str], pages: list[list[tuple]], kinds: list[pa.DataType]) -> pa.ListArray:
    offsets = [0]
    for p in pages:
        offsets.append(offsets[-1] + len(p))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _structs(names, [x for p in pages for x in p], kinds))


def _stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long, string = pa.int64(), pa.string()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rid, page_id, url, html = schema_columns(part, "rid", "page_id", "url", "html")
            pages = [staged_page(h or "") for h in html.to_pylist()]
            columns = [rid, page_id, url, pa.array([host_of(u) for u in url.to_pylist()], string)]
            columns += [pa.array([p[k] for p in pages], long) for k in (0, 1)]
            columns.append(_lists(["leaf", "text"], [p[2] for p in pages], [long, string]))
            columns.append(_lists(["leaf", "chain", "allowed", "plain", "links"], [p[3] for p in pages], [long, pa.list_(long), pa.bool_(), pa.bool_(), pa.float64()]))
            columns.append(_lists(["node", "style"], [p[4] for p in pages], [long, long]))
            columns.append(_lists(["leaf", "feature", "n"], [p[5] for p in pages], [long, long, pa.int32()]))
            yield pa.RecordBatch.from_arrays(columns, ["rid", "page_id", "url", "host", "digest", "template", "blocks", "leaves", "styles", "features"])


def importances(ws: Workspace, staged: DataFrame) -> DataFrame:
    """host, leaf, importance of every leaf of the hosts' style trees."""
    # one page of each kind counts; pages without a host are no site
    single = staged.groupBy("host", "digest").agg(F.min("rid").alias("rid"))
    merged = ws.save(staged.select("rid", "host", "leaves", "styles", "features").join(single.select("rid"), "rid", "left_semi"), "merged")
    known = F.when((F.col("host") == "") | (F.col("m") < MIN_PAGES), False).otherwise(True)
    styles = merged.select("host", F.inline("styles")).groupBy("host", "node", "style").agg(F.count(F.lit(1)).alias("c"))
    nodes = styles.groupBy("host", "node").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.expr("c * ln(c)")).alias("e"))
    nodes = ws.save(nodes.select("host", "node", "m", "l", F.when(known, F.expr("1 - e / m / ln(m)")).otherwise(1.0).alias("presentation")), "nodes")
    texts = merged.select("host", F.inline("features")).groupBy("host", "leaf", "feature").agg(F.sum("n").alias("t"), F.sum(F.expr("n * ln(n)")).alias("e"))
    entropy = texts.groupBy("host", "leaf").agg(F.avg(F.expr("ln(t) - e / t")).alias("h"))
    # chain, allowed and plain are the path's own
    leaves = merged.select("host", F.inline("leaves")).groupBy("host", "leaf").agg(*[F.first(c).alias(c) for c in ("chain", "allowed", "plain")], F.avg("links").alias("links"))
    seen = nodes.select("host", F.col("node").alias("leaf"), "m")
    content = F.when(known, F.greatest(F.lit(0.0), 1 - F.col("h") / F.ln("m"))).otherwise(1.0) * (1 - F.when(known, F.col("links")).otherwise(0.0))
    leaves = ws.save(leaves.join(entropy, ["host", "leaf"]).join(seen, ["host", "leaf"]).select("host", "leaf", "chain", "allowed", "plain", content.alias("content")), "leaves")
    below = leaves.select("host", F.explode("chain").alias("node"), "content").groupBy("host", "node").agg(F.avg("content").alias("content"))
    mixed = F.expr(f"(1 - pow({GAMMA}, l)) * presentation + pow({GAMMA}, l) * content")
    branches = below.join(nodes, ["host", "node"]).select("host", "node", mixed.alias("importance"))
    least = leaves.select("host", "leaf", F.explode("chain").alias("node")).join(branches, ["host", "node"]).groupBy("host", "leaf").agg(F.min("importance").alias("least"))
    importance = F.when(~F.col("allowed"), 0.0).when(F.col("plain"), 1.0).otherwise(F.col("least"))
    return ws.save(leaves.join(least, ["host", "leaf"]).select("host", "leaf", importance.alias("importance")), "importances")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_id, url, blocks, gone = schema_columns(batch, "page_id", "url", "blocks", "gone")
        texts = []
        for page, low in zip(blocks, gone.to_pylist(), strict=True):
            low = frozenset(low or ())
            texts.append("\n".join(b["text"] for b in page.as_py() if b["leaf"] not in low))
        yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every one of ``pages`` (page_id, url, html)."""
    ws = Workspace(pages.sparkSession, "html")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    staged = ws.save(rows.mapInArrow(_stage, _STAGED), "staged")
    low = importances(ws, staged).filter(F.col("importance") < LEAST).select("host", "leaf")
    templates = staged.groupBy("host", "template").agg(F.first("leaves").alias("leaves"))
    gone = templates.select("host", "template", F.inline("leaves")).select("host", "template", "leaf").join(low, ["host", "leaf"]).groupBy("host", "template").agg(F.collect_set("leaf").alias("gone"))
    gone = ws.save(gone, "gone")  # a set for each kind of page: Spark sends it around where it is small
    return staged.select("page_id", "url", "host", "template", "blocks").join(gone, ["host", "template"], "left").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
