"""Main text of web pages: site style trees tell a host's noise from its articles."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .arrow import slices
from .common import whole

#: Branches below this importance are noise, if so many distinct pages of the host have them.
MIN_IMPORTANCE = 0.4
MIN_PAGES = 8
#: Inside the article itself the evidence must be stronger.
ARTICLE_IMPORTANCE = 0.15
ARTICLE_PAGES = 20
#: The share of presentation (the variety of a node's children) in a node's importance.
PRESENTATION = 0.1
#: Elements nested deeper belong to the branch of their ancestor at this depth.
DEPTH = 64
#: Tags remembered in a task; templates say the same again and again.
LOOKS = 4096
#: Marked regions (articles, main parts, containers named as content) count from this share of the longest one's text
#: on; if they hold less than ``REGION_SHARE`` of the page's text, all of the page that is no furniture counts.
LESSER_REGION = 0.5
REGION_SHARE = 0.25
#: Up to so many noise branches are broadcast (16 bytes each and a host number); more are joined by host.
BROADCAST_BRANCHES = 500_000
#: Up to so many pages whose texts come again are broadcast (16 bytes each); more are joined by their hash.
BROADCAST_COPIES = 500_000

# Elements whose text never belongs to a page's article, elements that end a block,
# elements without an end, and words in class, id or role that name page furniture.
SILENT = frozenset("script style noscript template iframe object embed svg math canvas audio video select option textarea button head title".split())
FURNITURE = frozenset("nav footer aside form menu dialog search fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody "
    "td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot adbox banner sponsor sponsored promo promotion promoted sidebar sidenav "
    "menu menubar navbar navigation nav navi topnav breadcrumb breadcrumbs crumbs pagination pager toc cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login comment comments discussion disqus replies "
    "respond share sharing social related recommended recommendations footer masthead topbar toolbar skip legal copyright widget "
    "contentinfo complementary".split()
)
#: Words that may stand beside a word of ``NAMES`` without making the name one of content.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons col column container content entry form group inline inner item "
    "items left link links list main outer page panel post posts right row section site slot top unit wrap wrapper zone".split()
)
#: Class, id and role words that name the container of a page's main text.
CONTENT = frozenset(
    "content main maincontent main-content article article-body article-content post post-body post-content entry entry-content "
    "story story-body page-content".split()
)
#: Elements of running text: within an article their ids name places in it.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote".split())
#: Elements that an opening tag of the given kind closes when they are still open.
CLOSES = {
    "p": {"p"},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
}
CLOSES |= {t: {"p"} for t in BLOCKS - set(CLOSES) - {"br", "html", "body", "head", "title", "select", "caption", "tbody", "thead", "tfoot"}}
#: An element's implied end does not reach beyond these.
SCOPES = frozenset("table ul ol dl article section main aside nav header footer body html div td th form".split())
BOUNDS = {tag: tuple(SCOPES - closed) for tag, closed in CLOSES.items()}

# No alternative fails once it has taken more than its first characters, so a page is read in one pass. A quote that
# never closes is an ordinary character.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*"|'[^']*'|["'])*+)>?"""
    r"|<",
    re.S,
)
WANTED = re.compile("class|id|role|hidden|style", re.I)
NAMED = re.compile(r"""([^\s"'/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    chain: tuple[int, ...]  # paths from the root down, shared by all blocks within
    noisy: bool
    weak: bool = False  # named like furniture, by a part of the name
    article: bool = False
    region: int = 0
    linked: bool = False
    skipped: bool = False  # within an inline element that is no part of the text around it
    children: int = 0  # a rolling hash of their tags


@dataclass(slots=True)
class Block:
    """Text between two block bounds: its pieces, the marks of the innermost element and its chain of paths."""

    text: str
    noisy: bool
    weak: bool
    article: bool
    region: int
    links: bool  # more than half of it is text of links
    paths: tuple[int, ...]


@dataclass(slots=True)
class Look:
    """What an opening tag says: its name in the style tree, and what its own names make of it."""

    name: str
    noisy: bool
    weak: bool = False
    content: bool = False


def _look(tag: str, attributes: str, article: bool) -> Look:
    """Within an article a name marks furniture only if no word of it says anything else; elsewhere one word is enough."""
    look = Look(tag, tag in SILENT or tag in FURNITURE)
    if not WANTED.search(attributes):
        return look
    words: set[str] = set()
    for m in NAMED.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("class", "id"):
            value = html.unescape(value).lower()
            parts = value.split()
            look.name += "".join(f".{p}" for p in parts) if kind == "class" else f"#{re.sub('[0-9]+', '0', value)}"
            look.content |= tag not in FLOW and not CONTENT.isdisjoint(parts)
            if kind == "class" or not (article and tag in FLOW):
                words.update(w for p in parts for w in re.split("[^a-z]+", p) if w)
        elif kind == "role":
            value = html.unescape(value).lower()
            look.content |= value in ("main", "article")
            look.noisy |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
        elif kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and HIDDEN.search(html.unescape(value))):
            look.noisy = True
    if tag not in ("html", "body", "main", "article") and not words.isdisjoint(NAMES):
        whole_name = words <= NAMES | NEUTRAL
        look.noisy |= whole_name or not (article or tag in FLOW)
        look.weak = True
    return look


def read_page(page: str, looks: dict[tuple, Look] | None = None) -> tuple[list[Block], Counter]:
    """Blocks of text in page order, and for each path how its children look (a count by their signature).

    Time and memory grow with the page, whatever it holds: open elements are found by their tag, and a block refers
    to the chain of paths that its innermost element keeps, of ``DEPTH`` at most. ``looks`` remembers short tags
    from page to page (``LOOKS`` of them).
    """
    looks = {} if looks is None else looks
    stack = [Node("", 0, (), False)]
    opened: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
    blocks: list[Block] = []
    shapes: Counter = Counter()
    pieces: list[str] = []
    link_chars = regions = 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                blocks.append(Block(text, top.noisy, top.weak, top.article, top.region, 2 * link_chars > len(text), top.chain))
            pieces.clear()
        link_chars = 0

    def take(text: str) -> None:
        nonlocal link_chars
        if not stack[-1].skipped:
            pieces.append(text)
            if stack[-1].linked:
                link_chars += len(" ".join(text.split()))

    def innermost(tags: Iterable[str]) -> int:
        found = 0
        for t in tags:
            if t in opened and (depths := opened[t]) and depths[-1] > found:
                found = depths[-1]
        return found

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].tag in BLOCKS:
                flush()
            node = stack.pop()
            opened[node.tag].pop()
            shapes[node.path, node.children >> 1] += 1

    at, end = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            take(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            depth = opened[tag][-1] if tag in opened and opened[tag] else 0
            if tag == "br" or tag == "p" and not depth:
                flush()
            elif depth and (depth == len(stack) - 1 or tag in ("body", "html") or depth >= innermost(("article", "main", "body"))):
                close(depth)
        elif m[2]:
            tag = m[2].lower()
            if tag in CLOSES:
                depth = innermost(CLOSES[tag])
                if depth and depth > innermost(BOUNDS[tag]):
                    close(depth)
            if tag in BLOCKS:
                flush()
            parent = stack[-1]
            parent.children = xxhash.xxh3_64_intdigest(tag, parent.children)
            if tag in VOID:
                continue
            said = tag, m[3], parent.article
            look = looks.get(said) or _look(*said)
            if len(m[3]) < 200 and len(looks) < LOOKS:
                looks[said] = look
            noisy, marked = look.noisy, tag in ("article", "main")
            if tag == "header":
                noisy |= not parent.article
            region = parent.region
            if marked and not parent.article or look.content and not region:
                regions += 1
                region = regions
            deep = len(stack) > DEPTH
            path = parent.path if deep else xxhash.xxh3_64_intdigest(look.name, parent.path) >> 1
            inline = tag not in BLOCKS and not parent.noisy
            opened[tag].append(len(stack))
            stack.append(
                Node(
                    tag, path, parent.chain if deep else (*parent.chain, path), parent.noisy or noisy, parent.weak or look.weak,
                    parent.article or marked, region, parent.linked or tag == "a", parent.skipped or (noisy and inline),
                )
            )
            if tag in RAW:
                found = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                if tag not in SILENT:
                    take(html.unescape(page[at : found.start() if found else end]))
                at = found.end() if found else end
                close(len(stack) - 1)
        elif m.group() == "<":
            take("<")
        elif m.group().startswith("<![CDATA["):
            take(m.group()[9:].removesuffix("]]>"))
    if at < end:
        take(html.unescape(page[at:]))
    flush()
    close(1)
    return blocks, shapes


def _is_noise(block: Block, noise: dict[int, bool]) -> bool:
    """Within an article a branch of low importance needs a second sign: furniture in its names, or links for text."""
    if not block.article:
        return any(p in noise for p in block.paths)
    return (block.weak or block.links) and any(noise.get(p, False) for p in block.paths)


def main_text(blocks: list[Block], noise: dict[int, bool] | None = None) -> str:
    """Blocks of the page's main region, or of the page without furniture where none is marked or those marked hold little.

    Regions are articles, main parts, and text outside of them in containers named as content; the longest counts, with
    others that are not much shorter. ``noise`` has branches of low importance; its value tells whether that holds
    within articles too.
    """
    kept = [b for b in blocks if not (b.noisy or b.weak and b.links)]
    if noise:
        kept = [b for b in kept if not _is_noise(b, noise)] or kept
    mass: Counter = Counter()
    for b in kept:
        mass[b.region] += len(b.text)
    marked = {r: n for r, n in mass.items() if r}
    main = {r for r, n in marked.items() if n >= LESSER_REGION * max(marked.values())}
    if sum(mass[r] for r in main) >= REGION_SHARE * mass.total():
        kept = [b for b in kept if b.region in main] or kept
    return " ".join(b.text for b in kept)


def host_of(url):
    """The host in lower case without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(whole(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), r"^.*@|:[0-9]*$", ""))


PRINTS = "host string, key long, print long, n long"
TREE = "host string, path long, kind int, feature long, n double"


def _print(blocks: list[Block]) -> tuple[int, list[int]]:
    """The print of a page's texts, and the hash of each."""
    texts = [xxhash.xxh3_64_intdigest(b.text) >> 1 for b in blocks]
    return xxhash.xxh3_64_intdigest(np.array(texts, np.uint64).tobytes()) >> 1, texts


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each host and page (``key``), with the print of the page's texts; copies within a slice are one row."""
    looks: dict = {}
    for batch in batches:
        for part in slices(batch, "html"):
            found: dict[int, list] = {}
            for k, (host, key) in enumerate(zip(part.column("host").to_pylist(), part.column("key").to_pylist())):
                if key not in found:
                    found[key] = [host, key, _print(read_page(part.column("html")[k].as_py(), looks)[0])[0], 0]
                found[key][3] += 1
            hosts, keys, prints, counts = zip(*found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(counts, pa.int64())],
                names=["host", "key", "print", "n"],
            )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and path, counts of features over pages: 0 text of blocks, 1 looks. A page in ``copies`` rows adds its part in each."""
    looks: dict = {}
    for batch in batches:
        counts: Counter = Counter()
        for part in slices(batch, "html"):
            seen: dict[int, tuple[str, int, float]] = {}
            for k, (host, key, copies) in enumerate(zip(*(part.column(c).to_pylist() for c in ("host", "key", "copies")))):
                _, first, rows = seen.get(key, (host, k, 0))
                seen[key] = host, first, rows + 1 / copies
            for host, k, weight in seen.values():
                blocks, shapes = read_page(part.column("html")[k].as_py(), looks)
                for path, feature in {(p, t) for b, t in zip(blocks, _print(blocks)[1]) for p in b.paths}:
                    counts[host, path, 0, feature] += weight
                for path, shape in shapes:
                    counts[host, path, 1, shape] += weight
        if counts:
            hosts, paths, kinds, features = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()), pa.array(features, pa.int64()), pa.array(list(counts.values()), pa.float64())],
                names=["host", "path", "kind", "feature", "n"],
            )


def _distinct_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages (host, html, key, copies) that stand for all of their print, and each host's number of prints.

    Of the pages of one host with the same texts the one of least key stands for all; it is in ``copies`` rows. Only
    keys of prints that come more than once are joined back, so no page moves for it unless these are very many.
    """
    keyed = pages.withColumn("key", F.xxhash64("host", "html"))
    prints = keyed.mapInArrow(_prints, PRINTS).groupBy("host", "print", "key").agg(F.sum("n").alias("n"))
    prints = write_through(prints, "prints")
    picks = prints.groupBy("host", "print").agg(F.min("key").alias("pick"), F.sum("n").alias("rows"))
    sizes = picks.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    again = picks.where("rows > 1").select(F.col("host").alias("of_host"), F.col("print").alias("of_print"), "pick")
    repeated = (
        prints.join(again, (F.col("host") == F.col("of_host")) & (F.col("print") == F.col("of_print")))
        .groupBy(F.col("key").alias("of_key"))
        .agg(F.sum(F.when(F.col("key") == F.col("pick"), F.col("n")).otherwise(0)).alias("copies"))
    )
    repeated = write_through(repeated, "repeated")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_COPIES else repeated
    chosen = keyed.join(repeated, F.col("key") == F.col("of_key"), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return chosen.where("copies > 0").select("host", "html", "key", "copies"), sizes


def noise_branches(pages: DataFrame) -> DataFrame:
    """Branches (host, path, inside) of low importance in the hosts' style trees, from rows of (host, html).

    The trees of a host's pages are merged by path: the chain of element names with classes. A branch's
    content importance is the mean over its texts of one minus the text's entropy over the
    pages, log(pages with it) / log(pages): 1 if no text comes twice, 0 if every page has the same. Its
    presentation importance is the entropy of how its children look. ``inside`` marks the
    branches that are noise even within articles. Pages of a host with the same texts are one page, however they lie
    in the table. Features are summed before they move, so a hot host is many small sums.
    """
    chosen, sizes = _distinct_pages(pages)
    # parts of a page's copies add up to whole numbers
    tree = chosen.mapInArrow(_features, TREE).groupBy("host", "path", "kind", "feature").agg(F.round(F.sum("n")).alias("n"))
    sizes = sizes.where(F.col("pages") >= MIN_PAGES)
    by_path = (
        tree.groupBy("host", "path")
        .agg(
            F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("texts"),
            F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("repeats"),
            F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("looks"),
            F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("alike"),
        )
        .where("texts > 0")
    )
    other = sizes.withColumnRenamed("host", "of_host")
    content = 1 - F.col("repeats") / F.col("texts") / F.log("pages")
    variety = F.coalesce((F.log("looks") - F.col("alike") / F.col("looks")) / F.log(F.greatest("looks", F.lit(2))), F.lit(0.0))
    rated = by_path.join(other, F.col("host") == F.col("of_host")).withColumn("importance", (1 - PRESENTATION) * content + PRESENTATION * variety)
    return rated.where((F.col("importance") < MIN_IMPORTANCE) & (F.col("looks") >= MIN_PAGES)).select(
        "host", "path", ((F.col("importance") < ARTICLE_IMPORTANCE) & (F.col("looks") >= ARTICLE_PAGES)).alias("inside")
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    Silent elements, furniture by element or by the words of class, id and role, and branches that the host's style
    tree rates low are left out; of the rest the longest marked region counts (see ``main_text``). Within an article
    repetition alone drops nothing, and neither does a name in which other words stand beside those of furniture.
    Character references are decoded, white space within a block becomes one blank, and blocks are joined by one.
    A null html is empty, a page without text gives the empty text, a null or odd url has the
    empty host; repeated rows get a row each, and an empty table gives an empty table.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), whole(html_col).alias("html"), host_of(url_col).alias("host"))
    branches = noise_branches(rows.select("host", "html"))
    packed = branches.groupBy("host").agg(
        F.collect_list(F.struct("path", "inside")).alias("noise")  # branches of one host that at least MIN_PAGES pages share
    )

    packed = write_through(packed, "noise")
    count = packed.agg(F.coalesce(F.sum(F.size("noise")), F.lit(0))).first()[0]
    packed = packed.withColumnRenamed("host", "of_host")
    packed = F.broadcast(packed) if count <= BROADCAST_BRANCHES else packed
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks: dict = {}
        for batch in batches:
            for part in slices(batch, "html"):
                known: dict[str, dict[int, bool]] = {}
                texts = []
                for k, (host, page) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist())):
                    if host not in known:
                        known[host] = {x["path"]: x["inside"] for x in part.column("noise")[k].as_py() or []}
                    texts.append(main_text(read_page(page, looks)[0], known[host]))
                out = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), out, pc.utf8_length(out).cast(pa.int64())], names=["id", "url", "text", "n_chars"])

    joined = rows.join(packed, F.col("host") == F.col("of_host"), "left").select("id", "url", "host", "html", "noise")
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
