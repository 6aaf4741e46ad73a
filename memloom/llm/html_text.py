"""Main text of web pages by consensus of a host's pages.

Every page's containers are scored by the text they hold outside of links and page furniture; the
page votes for the generalised tag-class path of the smallest that has nearly all of it. The votes
are summed per host in Spark, and each page is read again with its host's winning path. A page that
has no such container is read with its own, and so is one of another template: its winning containers
hold less than SHARE of what its own main container does, and the path of that is the main one on
most of the host's pages that have it. (A path that more pages have beside their story is a sidebar,
however long it is on one page.)

Blocks are the texts between block-level tags; a line break tag counts as white space. Furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments) goes by tag, role or words
in class and id. Lists, paragraphs, divisions and tables that are links only go as menus, outside of
articles and of the chosen container only. Formulas keep their text. Work grows in proportion to a
page's length, however deep its elements are nested.

Defined results: a null or empty html gives an empty text; a null url is a host of its own;
repeated rows and null ids are answered row by row; equal votes go to the greater path; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks

#: Hosts' paths that may be broadcast (about 100 bytes each, one a host and its side paths); beyond, a salted join is used.
BROADCAST_HOSTS = 20_000
SALTS = 32
#: Share of a container's text from which a container below it stands for it.
SHARE = 0.8
#: Tags that go as menus if they hold links only.
LINK_BLOCKS = frozenset("div dl ol p table ul".split())
#: Depth from which containers share their parent's path.
MAX_DEPTH = 64

#: Tag names by their role.
RAW = frozenset("script style noscript template iframe svg textarea title object canvas noembed noframes xmp annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center dd div html li main section table tbody td tr".split())
FURNITURE = frozenset("aside button dialog footer form head header menu nav search select option".split())
WRAPPED_FURNITURE = FURNITURE - {"form"}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: A start tag ends these open elements (up to the nearest of the second set).
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("button option optgroup caption legend summary td th tr tbody thead tfoot".split())
#: Words in class or id that mark page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist respond reply replies disqus sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar toolbar widget pagination pager skip search form copyright legal teaser outbrain "
    "taboola adsense adsbox".split()
)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|$)")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "path", "parent", "furniture", "holds", "order", "text", "links", "junk", "n_links", "depth", "in_article", "menu", "headed", "end")

    def __init__(self, tag: str, path: str, parent: Node | None, furniture: bool, order: int, in_article: bool = False):
        self.tag, self.path, self.parent, self.furniture, self.order = tag, path, parent, furniture, order
        self.in_article, self.menu, self.headed = in_article, False, False
        self.end = order  # of the last element below
        self.holds: list = []  # texts, nodes and None for a block's edge
        self.text = self.links = self.junk = self.n_links = 0
        self.depth = parent.depth + 1 if parent else 0


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def generalised(classes: str) -> str:
    """Class words with numbers as N; words that are mostly numbers or very long are left out."""
    kept = [_DIGITS.sub("N", w.lower()) for w in classes.split() if len(w) <= 32 and sum(c.isdigit() for c in w) * 2 <= len(w)]
    return ".".join(sorted(set(kept))[:4])


def is_furniture(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and inside_article):
        return True
    if attrs:
        if attrs.get("role", "").lower() in FURNITURE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
            return True
        if _HIDDEN.search(attrs.get("style", "")):
            return True
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        words = {w.lower() for w in _WORDS.findall(named)} - ({"header"} if inside_article else set())
        if tag not in ("html", "body", "article", "main") and words & FURNITURE_WORDS:
            return True
    return False


def parse(source: str) -> list[Node]:
    """All block-level elements in page order; the first is the root."""
    root = Node("html", "", None, False, 0)
    nodes, stack = [root], [root]
    opened: Counter[str] = Counter()  # open elements by tag, the root left out
    link = 0
    at, n = 0, len(source)

    def close(to: int) -> None:
        nonlocal link
        while len(stack) > to:
            opened[stack.pop().tag] -= 1
            stack[-1].holds.append(None)
            link = 0

    while at < n:
        i = source.find("<", at)
        if i < 0:
            i = n
        if i > at:
            stack[-1].holds.append((source[at:i], link > 0))
        if i >= n:
            break
        if source.startswith("<!--", i):
            j = source.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        m = _TAG.match(source, i) or _LOOSE.match(source, i)
        if not m:
            if source.startswith(("<!", "<?", "</"), i):
                j = source.find(">", i)
                at = n if j < 0 else j + 1
            else:
                stack[-1].holds.append(("<", link > 0))
                at = i + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                j = _end_of(source, tag, at)
                at = n if j < 0 else j
            continue
        if tag == "br":
            stack[-1].holds.append((" ", False))
            continue
        if tag == "a":
            link = 1
            stack[-1].n_links += 1
            continue
        if tag not in BLOCK:
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in CONTAINER or stack[k].tag in FURNITURE:
                    break
        if tag in ENDS:
            ended, until = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ended) else ():
                if stack[k].tag in ended:
                    close(k)
                    break
                if stack[k].tag in until:
                    break
        up = stack[-1]
        if tag == "hr":
            up.holds.append(None)
            continue
        attrs = attributes(m[3]) if m[3] and not m[3].isspace() else {}
        step = tag + ("." + g if (g := generalised(attrs.get("class", ""))) else "")
        path = f"{up.path}/{step}" if up.depth < MAX_DEPTH else up.path
        inside = bool(opened["article"] or opened["main"])
        node = Node(tag, path, up, is_furniture(tag, attrs, inside), len(nodes), inside)
        up.holds.append(None)
        up.holds.append(node)
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
        if tag in ("article", "main"):
            for k in range(len(stack) - 2, 0, -1):  # a layout's name or form does not make its story furniture
                if stack[k].tag not in WRAPPED_FURNITURE:
                    stack[k].furniture = False
                if stack[k].tag in ("article", "main"):
                    break  # those around it are done
        link = 0
    return nodes


def _end_of(source: str, tag: str, at: int) -> int:
    """Behind the end tag of a raw element, or -1."""
    while True:
        j = source.find("</", at)
        if j < 0:
            return -1
        if source[j + 2 : j + 2 + len(tag)].lower() == tag:
            k = source.find(">", j)
            return -1 if k < 0 else k + 1
        at = j + 2


def measure(nodes: list[Node]) -> None:
    """Text, link text and furniture under each element, in characters, and whether a main heading stands
    in it, not in a container below; menus become furniture."""
    for node in reversed(nodes):
        for held in node.holds:
            if isinstance(held, tuple):
                size = len(held[0]) - held[0].count(" ")
                node.text += size
                if held[1]:
                    node.links += size
            elif held is not None:
                node.n_links += held.n_links
                node.end = max(node.end, held.end)
                if held.furniture:
                    node.junk += held.text + held.junk
                else:
                    node.text += held.text
                    node.links += held.links
                    node.junk += held.junk
                    node.headed |= held.tag in ("h1", "h2") or (held.headed and held.tag not in CONTAINER)
        if not node.furniture and not node.in_article and node.tag in LINK_BLOCKS and node.n_links >= 3 and node.links >= 0.9 * node.text:
            node.menu = node.furniture = True


def score(node: Node) -> float:
    return node.text - node.links - 0.5 * node.junk


def candidates(nodes: list[Node]) -> list[Node]:
    """Containers by falling score; of equal ones the deepest first. Parts of furniture do not count."""
    hidden: set[int] = set()
    found = []
    for node in nodes:
        if node.furniture or (node.parent is not None and node.parent.order in hidden):
            hidden.add(node.order)
        elif node.tag in CONTAINER and score(node) > 0:
            found.append(node)
    return sorted(found, key=lambda x: (-score(x), -x.depth, x.order))


def main_container(found: list[Node]) -> Node | None:
    """From the container with the most text down to one that still has nearly all of it; articles
    and containers with a heading of their own are not left."""
    node, at = found[0] if found else None, 1
    while node is not None and node.tag not in ("article", "main") and not node.headed:
        # what is not within a container is not within those below it, so none is looked at twice
        while at < len(found) and score(found[at]) >= SHARE * score(node) and not node.order < found[at].order <= node.end:
            at += 1
        if at == len(found) or score(found[at]) < SHARE * score(node):
            break
        node, at = found[at], at + 1
    return node


def votes(source: str) -> list[tuple[str, float, int, int]]:
    """Rows path, vote, main, seen: the path of the page's main container, with half the vote that of
    the one around it, and the paths of all its containers."""
    nodes = parse(source)
    measure(nodes)
    found = candidates(nodes)
    best = main_container(found)
    if best is None or not best.path:
        return []
    around = best.parent.path if best.parent is not None else ""
    paths = {x.path for x in found if x.path} | {best.path, *([around] if around else [])}
    rows = ((p, 1.0 if p == best.path else 0.5 if p == around else 0.0, int(p == best.path), 1) for p in paths)
    return sorted(rows, key=lambda x: -x[1])


def block_texts(node: Node) -> Iterator[str]:
    """Texts of the blocks under a container, furniture left out; below the page's body, blocks of
    links stay."""
    whole = node.tag not in ("html", "body")
    parts: list[str] = []
    todo = [iter(node.holds)]
    while todo:
        for held in todo[-1]:
            if isinstance(held, tuple):
                parts.append(held[0])
            elif held is None:
                if parts:
                    yield "".join(parts)
                    parts = []
            elif not held.furniture or (whole and held.menu):
                todo.append(iter(held.holds))
                break
        else:
            todo.pop()
            if parts:
                yield "".join(parts)
                parts = []


def extract(source: str | None, path: str | None = None, sides: Iterable[str] = ()) -> str:
    """Main text of a page, from the containers of that path or else the page's own best one.

    `sides` are the paths that are not the main one on most pages that have them.
    """
    if not source:
        return ""
    nodes = parse(source)
    measure(nodes)
    found = candidates(nodes)
    own = main_container(found) or nodes[0]
    chosen: list[Node] = []
    for x in sorted((x for x in found if x.path == path), key=lambda x: x.order) if path else ():
        if not chosen or x.order > chosen[-1].end:
            chosen.append(x)
    if chosen:
        covered = any(x.order <= own.order <= x.end for x in chosen)
        if not covered and own.path not in sides and sum(map(score, chosen)) < SHARE * score(own):
            chosen = [own]
    else:
        chosen = [own]
    lines = []
    for node in chosen:
        for text in block_texts(node):
            if line := " ".join(entities.unescape(text).split()):
                lines.append(line)
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """Rows (host, path, sides): the path with the most votes of each host, and the paths that are
    the main one on some of the pages that have them, but not on most."""

    def run(batches):
        held: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0, 0])

        def flush():
            hosts, paths = zip(*held, strict=True)
            weight, main, seen = zip(*held.values(), strict=True)
            columns = {"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "votes": pa.array(weight, pa.float64()), "main": pa.array(main, pa.int64()), "seen": pa.array(seen, pa.int64())}
            held.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in blocks(batches, "html"):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, weight, main, seen in votes(source) if source else ():
                    sums = held[host, path]
                    sums[0] += round(weight * 1000)  # whole numbers: sums do not depend on order
                    sums[1] += main
                    sums[2] += seen
            if len(held) > 50_000:
                yield flush()
        if held:
            yield flush()

    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(run, "host string, path string, votes double, main long, seen long")
    summed = cast.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("votes", "main", "seen"))).where("votes > 0")
    side = F.when((F.col("main") > 0) & (2 * F.col("main") <= F.col("seen")), F.col("path"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best"), F.collect_list(side).alias("sides")).select("host", F.col("best.path").alias("path"), "sides")


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    scratch = Scratch(spark, "hosts")
    paths = scratch.put(host_paths(pages), "paths")
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    if (paths.agg(F.sum(F.size("sides") + 1)).first()[0] or 0) <= BROADCAST_HOSTS:
        joined = source.join(F.broadcast(paths), "host", "left")
    else:  # a hot host's pages spread over SALTS keys
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, ["host", "salt"], "left")

    def run(batches):
        for batch in blocks(batches, "html"):
            texts = [extract(*row) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = source.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path", F.coalesce("sides", F.array().cast("array<string>")).alias("sides")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
