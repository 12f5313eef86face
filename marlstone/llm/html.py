"""HTML extraction with site template removal.

Pass 1 parses every page, hashes its element subtrees and counts, in Spark, on
how many pages of different content each subtree occurs per host.  Pass 2 parses
again and deletes the subtrees that recur on much of their host.  What templates
can't tell, as it differs from page to page, goes by the role that the markup
states: elements such as nav and footer, ARIA roles, and containers (never
running text) whose class or id names such a role.  The blocks that are left in
the page's articles, or in the page if it marks none, are the text.

Inside an article, running text (paragraphs, headings, list items, ...) is never
deleted for recurring, as copies and quotes recur too; only containers are.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Set
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .urls import split_url

#: A subtree is a template part from this many pages of different content, and this share of its host's, on.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: On hosts of more pages, the share falls with the root of their number, as sections and rotating notices are on few of many.
FULL_SHARE_PAGES = 100
#: Most hashes and hosts of a template table that is broadcast (8 bytes, and some 200); beyond, pages are dealt to cells behind their host's templates.
BROADCAST_TREES, BROADCAST_HOSTS = 1 << 20, 1 << 17
#: Pages of a host that meet in one cell, and hashes a worker holds as sets.
DEALT_PAGES, KNOWN_TREES = 20_000, 100_000

#: Implied and stray ends reach over so many open elements at most (browsers nest no deeper than that).
REACH = 512

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
DROP = RAW | frozenset("head nav header footer aside form button select option menu dialog object canvas audio video label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th tr caption".split())
MAIN = frozenset("article main".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: Words of class and id names that mark containers of what isn't article text.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead notice cookie cookies consent gdpr comment comments reply replies respond discussion share sharing social related recommended "
    "newsletter subscribe signup login popup modal overlay widget pagination pager toolbar toc".split()
)
#: Which open elements an opening tag ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What such an implied end can't reach beyond.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# Possessive, and a tag ends at the next "<" outside quotes, so that no part of a page is scanned again and again.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.S)
_SPACE = re.compile(r"\s+")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Node:
    name: str
    drop: bool = False
    children: list = field(default_factory=list)  # nodes and strings


def _unwanted(name: str, attributes: str) -> bool:
    if name in DROP:
        return True
    if not attributes or name in ("body", "html") or name in MAIN:
        return False
    for key, *values in _ATTR.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "role" and value.strip().lower() in DROP_ROLES:
            return True
        if key in ("class", "id") and name not in FLOW and name not in INLINE and not DROP_WORDS.isdisjoint(w.lower() for w in _NAME_WORD.findall(value)):
            return True
        if key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def parse(page: str) -> Node:
    """A tree of the page, however it is nested; unclosed elements end with their parents."""
    root = Node("#root")
    stack = [root]
    open_: Counter[str] = Counter()
    at = 0

    def close(i: int) -> None:
        open_.subtract(n.name for n in stack[i:])
        del stack[i:]

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1) if open_[name] > 0 else ():
                if stack[i].name == name:
                    close(i)
                    break
                if stack[i].name in MAIN | {"body"} and name in INLINE | FLOW:
                    break  # a stray end tag doesn't reach out of the article
            continue
        if name not in INLINE and (i := _implied_end(stack, open_, name)):
            close(i)
        node = Node(name, _unwanted(name, m[3]))
        stack[-1].children.append(node)
        if name in RAW and not (name in ("svg", "math") and m[3].rstrip().endswith("/")):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not (m[3].rstrip().endswith("/") and name not in FLOW | INLINE | MAIN | {"div", "section"}):
            stack.append(node)
            open_[name] += 1


def _implied_end(stack: list[Node], open_: Counter[str], name: str) -> int:
    """The place of the open element that an opening tag ends, or 0."""
    ends, fence = CLOSES.get(name), FENCE.get(name, ())
    if not any(open_[x] > 0 for x in ends or ("p",)):
        return 0
    for i in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1):
        n = stack[i].name
        if ends and n in ends or n == "p" and not ends:
            return i
        if n in fence or n not in INLINE and n not in FLOW and not ends:
            return 0
    return 0


def _hashes(node: Node, into: list[tuple[Node, bytes]], inside: bool) -> tuple[bytes, bool]:
    """Collects (node, hash) of the containers with text, or outside an article of all elements; returns the node's (hash, has text)."""
    order = [(node, inside)]
    for n, i in order:  # parents before children
        order += [(c, i or n.name in MAIN) for c in n.children if isinstance(c, Node)]
    known: dict[int, tuple[bytes, bool]] = {}
    for n, i in reversed(order):
        h, some = hashlib.blake2b(n.name.encode(), digest_size=8), False
        for c in n.children:
            if isinstance(c, Node):
                d, t = known.pop(id(c))
            else:
                c = _SPACE.sub(" ", c).strip()
                d, t = c.encode("utf-8", "surrogatepass"), bool(c)
                if not t:
                    continue
            h.update(len(d).to_bytes(4, "big") + d)
            some |= t
        known[id(n)] = h.digest(), some
        if some and not n.drop and n.name not in MAIN and n.name not in ("#root", "html", "body") and (not i or n.name not in FLOW and n.name not in INLINE):
            into.append((n, h.digest()))
    return known[id(node)]


def subtrees(page: str) -> tuple[int, list[int]]:
    """(hash of the page's content, distinct hashes of its subtrees that may be template parts)."""
    own: list[tuple[Node, bytes]] = []
    digest, _ = _hashes(parse(page), own, False)
    number = lambda d: int.from_bytes(d, "big", signed=True)
    return number(digest), sorted({number(d) for _, d in own})


def main_text(page: str | None, templates: Set[int] = frozenset()) -> str:
    """The article's blocks, joined by blank lines."""
    return extracted(page, templates)[0]


def extracted(page: str | None, templates: Set[int] = frozenset()) -> tuple[str, int]:
    """(main text, number of subtrees deleted as templates)."""
    root = parse(page or "")
    n_templates = 0
    if templates:
        own: list[tuple[Node, bytes]] = []
        _hashes(root, own, False)
        for node, d in own:
            if int.from_bytes(d, "big", signed=True) in templates:
                node.drop = True
                n_templates += 1
    tops, queue = [], [root]
    while queue:  # the outermost articles, in page order
        n = queue.pop()
        if n.name in MAIN and not n.drop:
            tops.append(n)
        else:
            queue += [c for c in reversed(n.children) if isinstance(c, Node) and not n.drop]
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if t := _SPACE.sub(" ", "".join(run)).strip():
            blocks.append(t)
        run.clear()

    for top in tops or [root]:
        work: list = [top]
        while work:
            n = work.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                run.append(n)
            elif n.drop:
                if n.name not in INLINE:
                    flush()
            elif n.name == "br":
                run.append(" ")
            elif n.name in INLINE:
                work += reversed(n.children)
            else:
                flush()
                work.append(None)
                work += reversed(n.children)
        flush()
    return "\n\n".join(blocks), n_templates


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_trees: int = BROADCAST_TREES, dealt_pages: int = DEALT_PAGES) -> DataFrame:
    """key, url, text, n_chars and n_templates (subtrees deleted for recurring) of every page.

    Null html gives empty text.  Pages with a null or malformed url make up one
    host "".  Pages of equal content count once, so copies don't turn articles
    into templates.  Repeated rows get a row each; empty tables none.  Pages of
    any length are read whole, in time that grows with it; a null key is kept;
    other columns are left out, whatever their names.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("x"), split_url(F.col(url))[0].alias("host"))

    def hashed(batches):
        for b in batches:
            found = [subtrees(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["host", "page", "trees"])

    seen = rows.select("host", "x").mapInArrow(hashed, "host string, page long, trees array<long>").groupBy("host", "page").agg(F.first("trees").alias("trees"), F.count(F.lit(1)).alias("copies"))
    parts = seen.select("host", "copies", F.explode(F.concat(F.array(F.lit(None).cast("long")), "trees")).alias("tree")).groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("pages"))
    # A null tree stands for the page itself, so that sizes of hosts come from the same aggregation.  Materialised, as both are read of it.
    counted = checkpointed(parts.where(F.col("tree").isNull() | (F.col("n") >= min_pages)))
    hosts = counted.where("tree is null").select("host", F.col("n").alias("of"), "pages")
    many = counted.where("tree is not null").select("host", "tree", "n")
    # At most (subtrees a page) / share hashes a host can reach the share: they grow with the root of its pages.
    # Materialised: its size decides how pages meet it.
    templates = checkpointed(many.join(hosts, "host").where(F.col("n") >= min_share * F.least(F.col("of"), F.sqrt(F.col("of") * FULL_SHARE_PAGES))).select("host", "tree", "pages"))
    kind = dict(pages.dtypes)
    schema = f"k {kind[key]}, u string, text string, n_chars long, n_templates long"
    size = templates.agg(F.count(F.lit(1)).alias("trees"), F.countDistinct("host").alias("hosts")).head()
    if size.hosts <= BROADCAST_HOSTS and size.trees <= broadcast_trees:
        out = rows.mapInArrow(_with_table(spark.sparkContext.broadcast(_by_host(templates.select("host", "tree").toArrow()))), schema)
    else:
        out = _dealt(rows, templates, dealt_pages).mapInArrow(_behind_templates, schema)
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars", "n_templates")


def _by_host(table: pa.Table) -> dict[str, np.ndarray]:
    """The hashes of each host, from rows (host, hash)."""
    names, at = np.unique(table.column(0).to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(1, len(names)))
    return dict(zip(names.tolist(), np.split(table.column(1).to_numpy()[order], ends), strict=True)) if len(names) else {}


def _read(k: pa.Array, u: pa.Array, out: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([k, u, pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["k", "u", "text", "n_chars", "n_templates"])


def _with_table(shared):
    """Reads (k, u, x, host) with a broadcast table of templates."""

    def read(batches):
        known: dict[str, frozenset] = {}
        held = 0
        for b in batches:
            out = []
            for x, host in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if host not in known:
                    if held > KNOWN_TREES:
                        known, held = {}, 0
                    known[host] = frozenset(shared.value[host].tolist()) if host in shared.value else frozenset()
                    held += len(known[host]) + 1
                out.append(extracted(x, known[host]))
            yield _read(b.column(0), b.column(1), out)

    return read


def _dealt(rows: DataFrame, templates: DataFrame, dealt_pages: int) -> DataFrame:
    """(host, cell, tree, k, u, x): a host's pages are dealt to cells of some ``dealt_pages``, and stand behind its templates in each."""
    cells = F.ceil(F.col("pages") / dealt_pages).alias("cells")
    large = checkpointed(templates.where(F.col("pages") > dealt_pages).groupBy("host").agg(F.max("pages").alias("pages")).select("host", cells))
    large = large.hint("broadcast" if large.count() <= BROADCAST_HOSTS else "merge")
    # By place in the table, as copies of one page may be many.
    placed = rows.withColumn("place", F.monotonically_increasing_id()).join(large, "host", "left")
    placed = placed.select("host", F.pmod(F.xxhash64("place"), F.coalesce("cells", F.lit(1)).cast("long")).alias("cell"), F.lit(None).cast("long").alias("tree"), F.lit(1).alias("turn"), "k", "u", "x")
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "host"]
    ahead = templates.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("pages") / dealt_pages) - 1)).alias("cell"), "tree", F.lit(0).alias("turn"), *none)
    return ahead.unionByName(placed).repartition("host", "cell").sortWithinPartitions("host", "cell", "turn").drop("turn")


def _behind_templates(batches):
    """Reads what ``_dealt`` gives."""
    cell, own = None, set()
    for b in batches:
        pages, out = [], []
        for i, (host, n, tree, x) in enumerate(zip(*(b.column(c).to_pylist() for c in ("host", "cell", "tree", "x")), strict=True)):
            if (host, n) != cell:
                cell, own = (host, n), set()
            if tree is None:
                pages.append(i)
                out.append(extracted(x, own))
            else:
                own.add(tree)
        part = b.take(pa.array(pages, pa.int64()))
        yield _read(part.column("k"), part.column("u"), out)
