"""Main text of web pages by consensus of a host's container paths.

Every page scores its containers by the text that isn't in links, each against
the sum of its parts, and names the best by its path of tags and generalised classes. Spark counts the votes of
each host, and pages are read again with the winning path of their host; a
page without an element there is read by its own best container. The vote is
for an inner container, the text is taken from around it: whole article elements,
and what runs on beside the container without one of its own. What most of a host's different articles
repeat word for word isn't part of any of them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, materialize, slices, unused

SLICE_BYTES = 4 << 20
MIN_VOTES = 2
#: Of a container's text outside links, what may stay behind if a part of it is taken instead; a headline may not.
REST_PERCENT = 3
REST_CHARS = 20
#: Of a page's text, what the largest article or main element holds at least to be taken for the main text; and what others of its path hold of the largest's.
MAIN_PERCENT = 25
#: A block on more than half of a host's different articles, and REPEATED of them, is boilerplate.
REPEATED = 5
REPEATED_PERCENT = 50
#: An element with a weak name that holds so many characters outside links, and less text in links than that, is text like any other.
LONG_CHARS = 400
PATH_CHARS = 1000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
_WORD = re.compile(r"[a-z]+(?:[0-9]+)?|[0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_DIGITS = re.compile(r"[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article section main div body td center details blockquote".split())
#: Elements that are never part of the main text.
DROPPED_TAGS = frozenset(
    "script style noscript template iframe svg canvas audio video nav footer aside button select option textarea input dialog menu head title datalist progress meter".split()
)
#: Forms go, unless they are a wrapper around the page's text.
FORM_TAGS = frozenset("form fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
#: Words of classes and ids that name what isn't part of the main text. Within the main text they must be the whole name, but for PART_WORDS.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adsbygoogle adslot sponsor sponsored sponsors promo promos promotion promoted "
    "comment comments commentlist disqus respond replies discussion livefyre related recommended recommendations trending "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal lightbox paywall noprint "
    "share sharing social socials sharebar breadcrumb breadcrumbs pagination pager copyright colophon "
    "kommentar kommentare kommentarbereich werbung anzeige anzeigen teilen verwandt verwandte commentaire commentaires publicite publicites partager "
    "comentario comentarios publicidad anuncio anuncios compartir relacionados boletin".split()
)
#: Of these, the ones that also name parts of articles: they count for short or linked text only.
LOOSE_WORDS = frozenset("notice notices promo promos promotion promoted social socials discussion respond replies sponsor sponsors related copyright paywall anzeige anzeigen verwandt verwandte teilen".split())
REMARK_WORDS = frozenset("comment comments commentlist disqus respond replies discussion kommentar kommentare kommentarbereich commentaire commentaires comentario comentarios".split())
PART_WORDS = frozenset(
    "box block section container wrapper wrap list area bar unit slot item items inner outer widget panel module group row col column top bottom left right "
    "header title footer form button buttons link links post posts article articles story stories content text page site main count thread reply area js google dfp block banner".split()
)
#: Elements of running text and data, which inside an article aren't dropped for a name.
TEXT_TAGS = frozenset("p table tbody thead tr td th caption figure figcaption blockquote pre li dt dd h1 h2 h3 h4 h5 h6 span a b i em strong code math label".split())
#: Words that may also name a wrapper around everything: what holds an article or main element or a headline, or half of the page, isn't dropped for them.
WEAK_WORDS = frozenset(
    "nav navbar navigation navi menu menus submenu toolbar topbar sidebar sidebars sidecol rail aside widget widgets banner overlay alert "
    "footer footnav masthead siteheader sitefooter header form search searchform".split()
)
CONTENT_WORDS = frozenset("article articlebody content contents entry main maincontent post postbody story storybody text body bodytext prose".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_LIMITS = CONTAINERS | {"th", "li", "table"}
FOREIGN = frozenset("svg path math circle rect line g use polygon".split())
#: Opening one of these ends an open one of the same group, up to the nearest list or table.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    parent: int
    boost: int
    main: bool  # an article or main element
    drop: int  # one of the kinds below
    dropped: bool = False
    doubtful: bool = False  # not main text, unless the main text is around it
    loose: bool = False  # named by words that name parts of articles too
    remark: bool = False  # named as what readers say


#: Why an element may not be main text: its tag, a whole name, one word of a name, a word that may name a wrapper, a form, a header.
KEPT, NEVER, NAMED, WORD, WEAK, FORM, HEADER = range(7)


@dataclass(slots=True)
class Block:
    node: int
    text: str
    link_chars: int


def _names(attrs: dict[str, str]) -> list[set[str]]:
    """The words of each class and of the id."""
    names = [*attrs.get("class", "").split(), attrs.get("id", "")]
    return [{w.rstrip("0123456789") for w in _WORD.findall(_CAMEL.sub(r"\1 \2", x).lower())} for x in names]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip() else {}


def _label(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("#", c.lower()) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


def _node(tag: str, attr_text: str, parent: int, above: str) -> Node:
    attrs = _attributes(attr_text)
    names = _names(attrs) if attrs else []
    words = set().union(*names)
    role, style = attrs.get("role", "").lower(), attrs.get("style", "").replace(" ", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
    content = bool(words & CONTENT_WORDS)
    drop = KEPT
    if tag in DROPPED_TAGS or role in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or attrs.get("class", "").strip() == "hidden":
        drop = NEVER
    elif tag in ("body", "html") or main and not words & {"comment", "comments"}:
        drop = KEPT
    elif words & DROPPED_WORDS:
        drop = NAMED if any(n & DROPPED_WORDS and n <= DROPPED_WORDS | PART_WORDS for n in names) and tag not in TEXT_TAGS else WORD
    elif tag in FORM_TAGS:
        drop = FORM
    elif tag == "header" or words & {"header"} and tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
        drop = NEVER if words & {"page", "site", "top"} else HEADER
    elif words & WEAK_WORDS and not content:
        drop = WEAK
    path = f"{above}>{_label(tag, attrs)}" if above else _label(tag, attrs)
    if len(path) > PATH_CHARS:
        path = "#" + xxhash.xxh3_128_hexdigest(path.encode("utf-8", "surrogatepass"))
    named = words & DROPPED_WORDS
    return Node(tag, path, parent, 3 if main else 2 if content else 1, main, drop, loose=named <= LOOSE_WORDS, remark=bool(named & REMARK_WORDS))


def _mark_dropped(nodes: list[Node], chars: list[int], linked: list[int]) -> None:
    """``chars``, ``linked``: the characters outside and inside links directly in each node."""
    n = len(nodes)
    holds_main, headline, total, links = [False] * n, [node.tag == "h1" for node in nodes], list(chars), list(linked)
    for i in range(n - 1, 0, -1):
        node, up = nodes[i], nodes[i].parent
        if node.drop != NEVER:
            holds_main[up] |= node.main or holds_main[i]
            headline[up] |= headline[i] and node.drop != HEADER
            total[up] += total[i]
            links[up] += links[i]
    content = [False] * n  # inside something that names the main text
    for i in range(1, n):
        node, up = nodes[i], nodes[i].parent
        content[i] = content[up] or (node.boost > 1 and node.tag != "body")
        around = holds_main[i] or headline[i]
        if node.drop == NAMED:
            # A name alone doesn't outweigh most of the page's text, nor a loose name a long text.
            most = total[i] * 5 > total[0] * 4 if node.remark else total[i] * 2 > total[0]
            long = node.loose and content[up] and total[i] >= LONG_CHARS and links[i] < total[i]
            own = not headline[i] and not most and not long
        elif node.drop == WORD:
            own = False
            node.doubtful = not around and not content[up]
        elif node.drop in (WEAK, FORM):
            own = not around and (content[up] or 2 * total[i] <= total[0])
        else:
            own = node.drop == NEVER or node.drop == HEADER and not content[up] and not holds_main[i]
        node.dropped = nodes[up].dropped or own
        node.doubtful |= nodes[up].doubtful


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """Elements, and the text blocks outside dropped elements in page order. Forgives unclosed and stray tags."""
    nodes = [Node("", "", -1, 1, False, KEPT)]
    stack, owner, open_tags = [0], 0, Counter()
    pieces: list[tuple[int, str, bool]] = []
    found: list[tuple[int, list[tuple[int, str, bool]]]] = []

    def flush():
        nonlocal pieces
        if pieces:
            found.append((owner, pieces))
            pieces = []

    def close_to(depth: int):
        """Close the elements from depth on."""
        nonlocal owner
        if any(nodes[i].tag in BLOCK for i in stack[depth:]):
            flush()
        open_tags.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:]
        owner = next((i for i in reversed(stack) if nodes[i].tag in BLOCK), 0)

    def add(text: str):
        if text:
            pieces.append((stack[-1], entities.unescape(text) if "&" in text else text, open_tags["a"] > 0))

    def deepest(tags, limit=frozenset()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if nodes[stack[k]].tag in tags:
                return k
            if nodes[stack[k]].tag in limit:
                return 0
        return 0

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        m = _TOKEN.search(html, at) if at <= last or html.find("<!", at) >= 0 else None
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"].replace("&", "&amp;"))
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if open_tags[tag] > 0:
                close_to(deepest({tag}))
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            if tag in CLOSES_P and open_tags["p"] > 0 and (depth := deepest({"p"}, P_LIMITS)):
                close_to(depth)
            if tag in SIBLINGS and any(open_tags[t] > 0 for t in SIBLINGS[tag][0]):
                same, limit = SIBLINGS[tag]
                if depth := deepest(same, limit):
                    close_to(depth)
                    if tag == "tr" and (depth := deepest({"tr"}, limit)):
                        close_to(depth)
            flush()
        if tag in VOID:
            continue
        attrs = (m["attrs"] if m["tag"] else m["attrs2"]) or ""
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
            continue
        nodes.append(_node(tag, attrs, stack[-1], nodes[stack[-1]].path))
        if tag in FOREIGN and attrs.rstrip().endswith("/"):
            continue
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
        if tag in BLOCK:
            owner = stack[-1]
    flush()
    chars, links = [0] * len(nodes), [0] * len(nodes)
    for _, parts in found:
        for i, t, linked in parts:
            (links if linked else chars)[i] += len(t.strip())
    _mark_dropped(nodes, chars, links)
    blocks = []
    for node, parts in found:
        text = " ".join("".join(t for i, t, _ in parts if not nodes[i].dropped).split())
        if text:
            blocks.append(Block(node, text, min(len(text), sum(len(t.strip()) for i, t, linked in parts if linked and not nodes[i].dropped))))
    return nodes, blocks


def _masses(nodes: list[Node], blocks: list[Block]) -> tuple[list[int], list[bool]]:
    """Characters outside links that each element holds, and whether it holds a headline."""
    mass, headline = [0] * len(nodes), [False] * len(nodes)
    for b in blocks:
        if nodes[b.node].doubtful:
            continue
        mass[b.node] += max(0, len(b.text) - 2 * b.link_chars)
        headline[b.node] |= nodes[b.node].tag in ("h1", "h2")
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        mass[nodes[i].parent] += mass[i]
        headline[nodes[i].parent] |= headline[i]
    return mass, headline


def _mains(nodes: list[Node], mass: list[int]) -> list[int]:
    """The article or main element with the most text, and the others at its path that hold a share of that; none inside another."""
    some = [i for i in range(1, len(nodes)) if nodes[i].main and not nodes[i].dropped and mass[i] * 100 >= MAIN_PERCENT * mass[0]]
    if not some:
        return []
    best = max(some, key=lambda i: (mass[i], i))
    return [i for i in range(1, len(nodes)) if i == best or nodes[i].path == nodes[best].path and not nodes[i].dropped and mass[i] * 100 >= MAIN_PERCENT * mass[best]]


def best_container(nodes: list[Node], blocks: list[Block]) -> tuple[int, int] | None:
    """(node, score): the container that a page votes for, and the text that it holds outside links.

    The search goes down from the root, or from the article or main element
    with the most text, to the container that holds all but ``REST_PERCENT`` of
    the text (or ``REST_CHARS``) and leaves no headline behind: a container is measured against the
    sum of its parts, so that the parts of one article stay together.
    """
    mass, headline = _masses(nodes, blocks)
    if not mass[0]:
        return None
    children: list[list[int]] = [[] for _ in nodes]
    for i in range(1, len(nodes)):
        if mass[i] and not nodes[i].dropped:
            children[nodes[i].parent].append(i)
    at = max(_mains(nodes, mass), key=lambda i: (mass[i], i), default=0)
    best = at
    while children[at]:
        k = max(children[at], key=lambda i: (mass[i], -i))
        left = headline[at] and not headline[k]
        if left or mass[at] - mass[k] > max(REST_CHARS, mass[at] * REST_PERCENT // 100):
            break
        at = k
        if nodes[at].tag in CONTAINERS:
            best = at
    return best, mass[best]


def _whole(nodes: list[Node], chosen: set[int]) -> set[int]:
    """The chosen containers, or the article or main elements around them."""
    out = set()
    for i in chosen:
        up, main = i, None
        while up > 0:
            main = up if nodes[up].main and not nodes[up].dropped else main
            up = nodes[up].parent
        out.add(i if main is None else main)
    return out


def _beside(nodes: list[Node], inside: list[bool], around: list[bool], block: Block) -> bool:
    """Whether a block stands beside a chosen container, in an element that is around it, without a container of its own."""
    at = block.node
    while at > 0 and not around[at]:
        if inside[at] or nodes[at].tag not in TEXT_TAGS and nodes[at].tag not in ("ul", "ol", "dl"):
            return False
        at = nodes[at].parent
    return at > 0 and nodes[at].tag not in ("html", "head")


def main_blocks(html: str | None, path: str | None = None) -> list[str]:
    """The blocks of the elements at ``path``, or else of the page's own best containers, with what is around and beside; or else of the whole page."""
    return _main_blocks(*parse(html or ""), path)


def _main_blocks(nodes: list[Node], blocks: list[Block], path: str | None = None) -> list[str]:
    chosen = {i for i, n in enumerate(nodes) if n.path == path and not n.dropped} if path else set()

    def taken(chosen: set[int]) -> list[str]:
        if not any(nodes[i].tag in ("", "html", "body") for i in chosen):
            chosen = _whole(nodes, chosen)
        inside, around = [False] * len(nodes), [False] * len(nodes)
        for i in chosen:
            up = nodes[i].parent
            while up > 0:
                around[up] = True
                up = nodes[up].parent
        inside[0] = 0 in chosen
        for i in range(1, len(nodes)):
            inside[i] = i in chosen or inside[nodes[i].parent]
        whole = any(nodes[i].tag in ("", "html", "body") for i in chosen)

        def kept(b: Block) -> bool:
            plain = 2 * b.link_chars < len(b.text)
            if inside[b.node]:
                return not nodes[b.node].doubtful or not whole and plain
            return plain and not nodes[b.node].doubtful and _beside(nodes, inside, around, b)

        return [b.text for b in blocks if kept(b)] if any(inside[b.node] for b in blocks) else []

    found = taken(chosen) if chosen else []
    if not found:
        best = best_container(nodes, blocks)
        if best:
            mass, _ = _masses(nodes, blocks)
            found = taken(set(_mains(nodes, mass)) or {best[0]})
        else:
            found = [b.text for b in blocks if not nodes[b.node].doubtful]
    return found


def main_text(html: str | None, path: str | None = None, repeated: frozenset[int] = frozenset()) -> str:
    """The main blocks, less those whose hash is in ``repeated``."""
    return "\n".join(b for b in main_blocks(html, path) if not repeated or block_hash(b) not in repeated)


def block_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; empty for a null or odd one."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def page_votes(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, score, article, blocks) of each page with a host: its best container, the hash of its longest main block, and those of all of them."""

    def run(batches):
        for part in slices(batches, "html", SLICE_BYTES):
            rows = []
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                nodes, blocks = parse(html)
                if best := best_container(nodes, blocks):
                    found = _main_blocks(nodes, blocks)
                    longest = max(found, key=lambda t: (len(t), t), default="")
                    rows.append((host, nodes[best[0]].path, best[1], block_hash(longest), list({block_hash(t) for t in found})))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["host", "path", "score", "article", "blocks"])

    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).where("host <> '' and html is not null")
    return rows.mapInArrow(run, "host string, path string, score bigint, article bigint, blocks array<bigint>")


def consensus_paths(votes: DataFrame, *, min_votes: int = MIN_VOTES) -> DataFrame:
    """(host, path): the path that most pages of a host vote for (ties: more text, then the larger path), with ``min_votes`` at least."""
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.col("score").cast("decimal(38,0)")).alias("score"))
    best = counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best"))
    return best.where(F.col("best.votes") >= min_votes).select("host", F.col("best.path").alias("path"))


def repeated_blocks(votes: DataFrame) -> DataFrame:
    """(host, repeated): hashes of blocks on more than REPEATED_PERCENT of a host's different articles, and on REPEATED of them.

    Pages with the same longest block are one article, so that copies of a page
    don't make its text boilerplate; the longest block itself is on one article.
    A page has so many such blocks at most as twice its own, and so has a host.
    """
    on = votes.select("host", "article", F.explode("blocks").alias("block")).distinct().groupBy("host", "block").agg(F.count("*").alias("n"))
    total = votes.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles")).where(F.col("articles") >= REPEATED)
    often = on.where(F.col("n") >= REPEATED).join(total, "host").where(F.col("n") * 100 > F.col("articles") * REPEATED_PERCENT)
    return often.groupBy("host").agg(F.collect_list("block").alias("repeated"))


def extract_main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", as_col: str = "text", min_votes: int = MIN_VOTES) -> DataFrame:
    """Add the main text of every page; a column of that name is replaced.

    Character references are decoded, white space within a block becomes one
    space, blocks are joined by line feeds in page order. A null or empty page
    has an empty text. Pages without a host, or of hosts without
    ``min_votes`` for one path, are read by their own best container. Repeated
    rows vote each and stay. Pages of any length are read whole; time grows with
    the page's length and its depth. A hot host's votes are counted in parts
    first, and its pages needn't meet.
    """
    votes = materialize(page_votes(pages, url_col=url_col, html_col=html_col), "votes")
    hosts = materialize(consensus_paths(votes, min_votes=min_votes).join(repeated_blocks(votes), "host", "full"), "host-paths")
    discard(votes)
    host, path, repeated, key, text = unused(pages.columns, "host", "path", "repeated", "key", "text_")
    hosts = hosts.select(F.col("host").alias(host), F.col("path").alias(path), F.col("repeated").alias(repeated))

    @F.arrow_udf("string")
    def extract(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, paths, blocks in rows:
            for part in slices([pa.RecordBatch.from_arrays([htmls, paths, blocks], ["html", "path", "blocks"])], "html", SLICE_BYTES):
                columns = [part.column(k).to_pylist() for k in range(3)]
                yield pa.array([main_text(h, p, frozenset(r or ())) for h, p, r in zip(*columns)], pa.string())

    joined = pages.withColumn(key, host_of(F.col(f"`{url_col}`"))).join(hosts, F.col(key) == F.col(host), "left")
    found = joined.withColumn(text, extract.asNondeterministic()(F.col(f"`{html_col}`"), F.col(path), F.col(repeated)))
    return found.select(*[F.col(f"`{c}`") for c in pages.columns if c != as_col], F.col(text).alias(as_col))
