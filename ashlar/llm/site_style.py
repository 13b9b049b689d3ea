"""Main text of web pages by site style trees.

The pages of a host are laid over one another. A node of the merged tree is a path of elements;
it has an importance from two entropies: how differently pages lay out its children, and how
evenly its texts are spread over pages. What is laid out alike and says the same on every page
is furniture. Branches of low importance go. What an element says of itself comes first:
navigation, asides, forms and the like go on every page, and so does what a whole class, id or role
names so, but for headings. Being within an article or main element is
a prior only: such branches go as well, but below a lower limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import pieces, written

#: Branches below this importance go. 0: on every page alike, 1: nowhere twice.
IMPORTANCE = 0.3
#: The same within an article or main element, where a branch must be clearly alike to go.
MAIN_IMPORTANCE = 0.1
#: Hosts whose lists of furniture are broadcast; beyond, the join shuffles.
BROADCAST_HOSTS = 50_000
#: Fixed sets of element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("head title noscript template iframe object svg math canvas audio video select datalist button".split())
RAW = frozenset("script style textarea xmp noframes".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split()) | SILENT
MAIN = frozenset("article main".split())
#: Closing an open element by the start of another one.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
#: Fixed words of class, id and role: those that name furniture, and those that may stand beside them.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation"
    " breadcrumb breadcrumbs sidebar side footer cookie cookies consent notice notices alert popup modal newsletter subscribe"
    " signup login share sharing social related recommended comment comments reply replies disqus widget toolbar search skip"
    " masthead complementary contentinfo".split()
)
BESIDE = frozenset(
    "area bar bottom box button buttons container content div form global group header holder icon icons inner item items left"
    " link links list main mobile outer panel post posts primary right row secondary section site slot sticky thread top unit"
    " wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|[^<]+|<", re.S
)
#: Parts of class and id values that number pages, and ids that are made of a page's title.
_NUMBER, _SLUG = re.compile(r"[0-9]+"), re.compile(r"[^-_]+(?:[-_]+[^-_]+){2,}|.{25,}", re.S)
_NAMED = re.compile(r"(?<![\w.:-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _shared(name: str, value: str) -> str:
    """A class, id or role as it may stand on many pages: without what tells one page from another."""
    return "#" if name == "id" and _SLUG.fullmatch(value) else _NUMBER.sub("#", value)


def says(value: str) -> bool:
    """Whether a class, id or role names furniture: one of its names has a word for it and no word of
    another kind, so ``related-posts`` does and ``related-work`` does not."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words):
            return True
    return False


class _Open:
    __slots__ = ("name", "path", "furniture", "main", "children")

    def __init__(self, name, path, furniture, main):
        self.name, self.path, self.furniture, self.main, self.children = name, path, furniture, main, []


def parsed(page: str) -> tuple[list[tuple[str, int, str]], list[tuple[str, str]]]:
    """A page's blocks ``(path, sort, text)`` in order, and its nodes ``(path, children)``.

    Sort 2: in an article or main element; 1: elsewhere, undecided; 0: furniture by its own name.
    White space in a block is one blank. Unclosed and stray tags are taken as browsers do: what
    is left open ends with its parent, a stray end tag is ignored.
    """
    blocks, nodes, text = [], [], []
    stack = [_Open("", "", False, False)]
    skip = ""

    def flush():
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                top = stack[-1]
                blocks.append((top.path, 0 if top.furniture else 2 if top.main else 1, said))

    def close(depth: int):
        flush()
        while len(stack) > depth:
            done = stack.pop()
            nodes.append((done.path, ",".join(done.children)))

    for m in _TOKEN.finditer(page):
        name = m.group(2)
        if skip:
            if name and m.group(1) and name.lower() == skip:
                skip = ""
            continue
        if not name:
            piece = m.group()
            if not piece.startswith(("<!", "<?")):
                text.append(piece)
            continue
        name = name.lower()
        if m.group(1):
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if at:
                close(at)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            if not m.group(3).endswith("/"):
                skip = name
            continue
        if name in EMPTY:
            if name == "hr":
                flush()
            text.append(" ")
            continue
        if name not in BLOCKS and name not in SILENT:
            continue
        flush()
        if name in CLOSES:
            low = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ("ul", "ol", "dl", "table", "select")), 0)
            at = next((i for i in range(low + 1, len(stack)) if stack[i].name in CLOSES[name]), 0)
            if at:
                close(at)
        elif stack[-1].name == "p" and name not in SILENT:
            close(len(stack) - 1)  # a block ends an open paragraph
        parent = stack[-1]
        named = [(v[0].lower(), (v[1] or v[2] or v[3]).lower()) for v in _NAMED.findall(m.group(3))] if m.group(3) else []
        told = name not in HEADINGS and any(says(v) for _, v in named)
        furniture = parent.furniture or name in FURNITURE or told or (name == "header" and not parent.main)
        step = f"{name}[{' '.join(f'{k}={_shared(k, v)}' for k, v in named)}]" if named else name
        parent.children.append(step)
        stack.append(_Open(name, f"{parent.path}/{step}", furniture, parent.main or name in MAIN or ("role", "main") in named))
    close(1)
    flush()
    return blocks, nodes


def _number(*parts: str) -> int:
    value = xxhash.xxh64_intdigest("\x00".join(parts))
    return value - (1 << 64) if value >> 63 else value


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)


def trees(pages: DataFrame, keep: Sequence[str], url: str = "url", body: str = "html") -> DataFrame:
    """``row`` (the columns ``keep``), ``host``, ``blocks`` (node, sort, text) and ``nodes`` (node, style)."""
    inputs = pages.select(F.struct(*keep).alias("row"), host_of(F.col(url)).alias("host"), F.col(body).alias("body"))
    block = "array<struct<node:bigint,sort:int,text:string>>"
    schema = inputs.select(
        "row", "host", F.lit(None).cast(block).alias("blocks"),
        F.lit(None).cast("array<struct<node:bigint,style:bigint>>").alias("nodes"),
    ).schema
    kinds = (
        pa.list_(pa.struct([("node", pa.int64()), ("sort", pa.int32()), ("text", pa.string())])),
        pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())])),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                hosts = batch.column("host").slice(first, len(bodies))
                blocks, nodes = [], []
                for host, page in zip(hosts.to_pylist(), bodies, strict=True):
                    found, branches = parsed(page or "")
                    number = {p: _number(host, p) for p in {b[0] for b in found} | {n[0] for n in branches}}
                    blocks.append([{"node": number[p], "sort": s, "text": t} for p, s, t in found])
                    nodes.append([{"node": number[p], "style": _number(c)} for p, c in branches])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(bodies)), hosts, pa.array(blocks, kinds[0]), pa.array(nodes, kinds[1])],
                    names=["row", "host", "blocks", "nodes"],
                )

    return inputs.mapInArrow(run, schema)


def importance(parsed_pages: DataFrame) -> DataFrame:
    """``host, node, pages, layout, content, importance`` of every node of the merged trees.

    Only distinct pages are merged: of pages of a host with equal blocks one counts. ``pages`` are
    the distinct ones with the node; a node on one of them has importance 1, however often it is
    there. Of a node met m times: ``layout`` is the entropy of its styles (children) to the base m;
    ``content`` is 1 less the mean, over its texts, of log(pages with the text) / log m, so 0 where
    every text is on every page. ``importance`` is the larger of the two.
    Everything is counted per (node, text or style), pre-aggregated before it moves. ``page`` tells
    rows apart; groups of copies are found on (host, digest, page) alone.
    """
    pages = parsed_pages.select("host", "page", "blocks", "nodes", F.xxhash64("blocks").alias("digest"))
    copies = pages.groupBy("host", "digest").agg(F.min("page").alias("one"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = written(copies.select(F.col("host").alias("h"), F.col("digest").alias("d"), "one"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_HOSTS else copies
    again = (F.col("host") == F.col("h")) & (F.col("digest") == F.col("d")) & (F.col("page") != F.col("one"))
    parsed_pages = pages.join(copies, again, "left_anti")
    said = parsed_pages.select("host", F.explode("blocks").alias("b")).select(
        "host", F.col("b.node").alias("node"), F.lit(0).alias("kind"), F.xxhash64("b.text").alias("what")
    )
    laid = parsed_pages.select("host", F.explode("nodes").alias("n")).select(
        "host", F.col("n.node").alias("node"), F.lit(1).alias("kind"), F.col("n.style").alias("what")
    )
    there = parsed_pages.select("host", F.explode(F.array_distinct("nodes.node")).alias("node")).select(
        "host", "node", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("what")
    )
    counts = said.unionAll(laid).unionAll(there).groupBy("host", "node", "kind", "what").agg(F.count(F.lit(1)).cast("double").alias("n"))
    x = F.col("n")
    sums = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 2, x)).cast("long").alias("pages"),
        F.sum(F.when(F.col("kind") == 1, x)).alias("m"),
        F.sum(F.when(F.col("kind") == 1, x * F.log(x))).alias("laid"),
        F.sum(F.when(F.col("kind") == 0, x)).alias("said"),
        F.sum(F.when(F.col("kind") == 0, x * F.log(x))).alias("spread"),
    )
    base = F.log("m")
    layout = F.when(F.col("m") > 1, (base - F.col("laid") / F.col("m")) / base).otherwise(1.0)
    content = F.when((F.col("m") > 1) & (F.col("said") > 0), 1 - F.col("spread") / F.col("said") / base)
    return sums.select("host", "node", "pages", layout.alias("layout"), content.alias("content")).withColumn(
        "importance", F.when(F.col("pages") > 1, F.greatest("layout", F.coalesce("content", F.lit(0.0)))).otherwise(1.0)
    )


def main_text(pages: DataFrame, keep: Sequence[str], url: str = "url", body: str = "html") -> DataFrame:
    """``keep``, ``text`` (blocks in page order joined by a blank line) and ``n_chars``, per row.

    All blocks stay but furniture by its own name and blocks whose node is too unimportant on this
    host; within an article or main element the limit is lower. NULL and empty
    pages, and pages of nothing but furniture, have an empty text. A NULL address is a host of
    its own; of repeated pages each gets the same text, which their number does not change; an empty table gives no rows.

    Pages are parsed once and written to the shared folder. Per host only its unimportant nodes
    come back, as one list; the lists are broadcast while hosts are few, else joined by host.
    """
    rows = written(trees(pages, keep, url, body).withColumn("page", F.monotonically_increasing_id()), "trees")
    low = importance(rows).filter(F.col("content").isNotNull() & (F.col("importance") < IMPORTANCE))
    least = F.when(F.col("importance") < MAIN_IMPORTANCE, F.col("node"))
    lists = low.groupBy(F.col("host").alias("h")).agg(F.collect_list("node").alias("low"), F.collect_list(least).alias("least"))
    lists = written(lists, "furniture")
    lists = F.broadcast(lists) if lists.count() <= BROADCAST_HOSTS else lists
    joined = rows.select("row", "host", "blocks").join(lists, F.col("host") == F.col("h"), "left")
    within = lambda nodes, b: F.coalesce(F.array_contains(nodes, b["node"]), F.lit(False))
    chosen = F.filter("blocks", lambda b: (b["sort"] > 0) & ~F.when(b["sort"] == 2, within("least", b)).otherwise(within("low", b)))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n")
    return joined.select("row.*", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
