"""Main text of web pages by wrapper induction.

Pages of a host are folded into a template tree by simple tree matching: nodes
that align are merged, others are added. A node whose own text is the same on all
pages that have it is constant. Over all pages of the host, the own texts of every
path of the tree are counted: where few texts serve many pages, or most characters
are links, the path is template; where texts are a page's own, it varies. The
content slot is found from the root down, by the subtree that holds the most varying
text a page. A page is aligned with its host's template, and the blocks of its slot
that are not template are its text.

Roles and names of elements decide only where a host has too few pages, where a page
has none of its host's slots, between subtrees of like weight, and about what varies
as the content does, such as readers' comments.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import discard, materialise, worker_path

#: Distinct pages that have to agree on a text before it counts as constant.
SUPPORT = 5
#: Hosts with more than this share of all pages are dealt to several copies of their template: so there are at most 1 000 such hosts.
SHARE = 1000
#: Pages of one copy, at least.
COPY_PAGES = 2000
#: Partial trees of a host that are folded at once.
FAN_IN = 16
#: Open elements beyond which nesting is flattened, as browsers do: deeper ones become children of this one.
LEVELS = 150

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Elements of HTML by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption summary address".split())
_SCOPES = frozenset("html body article section main div table td th ul ol nav aside header footer form blockquote".split())
# Elements and names that mark furniture.
_FURNITURE = frozenset("nav footer aside form script style noscript template iframe button select textarea svg dialog menu head object canvas audio video".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer foot sidebar aside rail comment comments commentlist respond replies reply disqus discussion share sharing social related recommended "
    "recommendations widget widgets pagination pager login search toolbar copyright navigationbar complementary contentinfo".split()
)


class Node:
    """An element: tag, key (tag and names), and children: block elements and runs of inline text.

    A run of text is [text, characters of it inside links].
    """

    __slots__ = ("tag", "names", "children", "made")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.names, self.children, self.made = tag, names, [], None

    @property
    def key(self) -> str:
        return ".".join((self.tag, *self.names))

    def furniture(self) -> bool:
        return _furniture(self.key)


@lru_cache(maxsize=100_000)
def _furniture(key: str) -> bool:
    """Whether a key's tag or names mark furniture."""
    tag, *names = key.split(".")
    return tag in _FURNITURE or any(part in _NAMES for name in names for part in re.split(r"[^a-z]+", name))


def parse(page: str) -> Node:
    """The tree of block elements of a page, however malformed."""
    root = Node("html")
    stack, inline, at = [root], 0, 0

    def text(raw: str) -> None:
        if not raw:
            return
        if len(stack) > LEVELS and stack[LEVELS - 1].children[-1] is not stack[-1]:  # goes on behind a flattened element
            stack[-1] = Node(stack[-1].tag, stack[-1].names)
            stack[LEVELS - 1].children.append(stack[-1])
        kids = stack[-1].children
        if not kids or isinstance(kids[-1], Node):
            kids.append(["", 0])
        raw = entities.unescape(raw) if "&" in raw else raw
        kids[-1][0] += raw
        if inline:
            kids[-1][1] += len(raw)

    while found := _TOKEN.search(page, at):
        text(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in _INLINE:
                inline -= tag == "a" and inline > 0
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        inline = 0
                        break
                    if stack[depth].tag in _SCOPES and tag not in _SCOPES:
                        break
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _INLINE:
            if tag == "a":
                inline = 1
            if tag == "br":
                text(" ")
            continue
        if tag in ("html", "body") and (tag == "html" or any(n.tag == "body" for n in stack)):
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        if tag in _CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in _CLOSES[tag]:
                    del stack[depth:]
                    break
                if stack[depth].tag in _SCOPES and stack[depth].tag not in ("td", "th"):
                    break
        inline = 0
        names = ()
        if found[3] and "=" in found[3]:
            values = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(found[3])).lower().split()
            names = tuple(sorted({re.sub(r"\d\d+", "0", v) for v in values}))
        node = Node(tag, names)
        stack[min(len(stack), LEVELS) - 1].children.append(node)
        if tag not in _VOID and not found[0].endswith("/>"):
            stack.append(node)
    text(page[at:])
    return root


def squeeze(text: str) -> str:
    return " ".join(text.split())


# A template node is [key, support, text hash, varied, children, verdict]: support holds up to
# SUPPORT hashes of pages that have the node, text hash is that of its own text. The
# verdict is None until decide() gives it.

#: Verdicts: neither, the root of a content slot, and template text.
OUTSIDE, SLOT, BOILERPLATE = 0, 1, 2


def shape(node: Node, page: int) -> list:
    """The template of one page. Neighbours of one key become one node."""
    if node.made is None:
        own = squeeze(" ".join(run[0] for run in node.children if not isinstance(run, Node)))
        out = node.made = [node.key, [page], zlib.crc32(own.encode()) if own else 0, False, [], None]
        for kid in node.children:
            if isinstance(kid, Node):
                made = shape(kid, page)
                if out[4] and out[4][-1][0] == made[0]:
                    out[4][-1] = fold(out[4][-1], made)
                else:
                    out[4].append(made)
    return node.made


def align(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes of one key: size of the largest match, and the children that match."""
    keys = {k[0] for k in b[4]}
    rows = [i for i, k in enumerate(a[4]) if k[0] in keys]  # others match nothing
    m, n = len(rows), len(b[4])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    gain = {}
    for i in range(1, m + 1):
        kid = a[4][rows[i - 1]]
        for j in range(1, n + 1):
            w = 0
            if kid[0] == b[4][j - 1][0]:
                w = gain[i, j] = align(kid, b[4][j - 1])[0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    pairs, i, j = [], m, n
    while i and j:
        if (i, j) in gain and best[i][j] == best[i - 1][j - 1] + gain[i, j]:
            pairs.append((rows[i - 1], j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs[::-1]


def fold(a: list, b: list) -> list:
    """One template of two nodes of one key."""
    _, pairs = align(a, b)
    kids, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[4]), len(b[4]))]:
        kids += a[4][i:p] + b[4][j:q]
        if p < len(a[4]):
            kids.append(fold(a[4][p], b[4][q]))
        i, j = p + 1, q + 1
    return [a[0], sorted({*a[1], *b[1]})[:SUPPORT], a[2], a[3] or b[3] or a[2] != b[2], kids, None]


def _below(path: int, key: str) -> int:
    """Path of a child, as a signed long."""
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def paths(t: list, path: int = 0, found: dict[int, set] | None = None) -> dict[int, set]:
    """Path of keys below a root -> pages that have it; up to SUPPORT of them are known, or more."""
    found = {} if found is None else found
    for kid in t[4]:
        at = _below(path, kid[0])
        found.setdefault(at, set()).update(kid[1])
        paths(kid, at, found)
    return found


def prune(t: list, keep: set[int], path: int = 0) -> list:
    """A template without the nodes whose path isn't kept."""
    kids = [(k, at) for k in t[4] if (at := _below(path, k[0])) in keep]
    return [*t[:4], [prune(k, keep, at) for k, at in kids], None]


def _constant(t: list | None) -> bool:
    return t is not None and not t[3] and t[2] != 0 and len(t[1]) >= SUPPORT


def own_texts(root: Node) -> dict[int, tuple[int, int, int]]:
    """Path of keys -> hash of a page's own text there, its characters, and those of them in links; paths without text left out."""
    runs: dict[int, list[list]] = {}
    todo = [(root, 0)]
    while todo:
        node, path = todo.pop()
        for kid in reversed(node.children):
            if isinstance(kid, Node):
                todo.append((kid, _below(path, kid.key)))
            elif not kid[0].isspace():
                runs.setdefault(path, []).append(kid)
    found = {}
    for path, of in runs.items():
        text = squeeze(" ".join(r[0] for r in of))
        if text:
            found[path] = (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), len(text), min(len(text), sum(r[1] for r in of)))
    return found


def decide(t: list, counts: dict[int, tuple[int, int, int, int]]) -> list:
    """A template with verdicts, from counts by path: pages, distinct texts, characters, characters in links.

    Only paths of SUPPORT pages or more are in counts. n pages with at most the
    root of n texts share these: template, as what is mostly links. Otherwise
    texts are the pages' own, and weigh by their characters outside links a page.
    """

    def weigh(node: list, path: int) -> tuple[list, float, float, list]:
        """Verdict copy, own weight, weight with all below, and the kids alike."""
        pages, texts, chars, links = counts.get(path, (0, 0, 0, 0))
        shared = pages > 0 and (texts * texts <= pages or 2 * links > chars)
        own = 0.0 if shared or not pages else (chars - links) / pages
        kids = [weigh(k, _below(path, k[0])) for k in node[4]]
        out = [*node[:4], [k[0] for k in kids], BOILERPLATE if shared or _constant(node) else OUTSIDE]
        return out, own, own + sum(k[2] for k in kids), kids

    def choose(node: tuple) -> None:
        out, own, _, kids = node
        tag = lambda k: k[0][0].split(".")[0]
        live = [k for k in kids if k[2] > 0]
        boxes = [k for k in live if tag(k) not in _FLOW]
        flow = own + sum(k[2] for k in live if tag(k) in _FLOW)
        best = max((k[2] for k in boxes), default=0.0)
        heading = any(tag(k)[:1] == "h" and tag(k) in _FLOW for k in live)
        if heading or flow and 4 * flow >= best:
            out[5] = SLOT
            return
        heavy = [k for k in boxes if 4 * k[2] >= best]
        if len(heavy) > 1:
            heavy = [k for k in heavy if not _furniture(k[0][0])] or heavy
        for k in heavy:
            choose(k)

    top = weigh(t, 0)
    choose(top)
    return top[0]


def matched(node: Node, fits: list | None) -> Iterator[tuple[Node | list, list | None]]:
    """Children of a node in page order: runs of text, and elements with the template node they align with."""
    of: dict[int, list] = {}
    kids = [k for k in node.children if isinstance(k, Node)]
    if fits and kids:
        group, at = [], -1
        for n, k in enumerate(kids):
            at += not n or kids[n - 1].key != k.key
            group.append(at)
        pairs = dict(align(shape(node, 0), fits)[1])
        of = {id(k): fits[4][pairs[g]] for k, g in zip(kids, group) if g in pairs}
    for kid in node.children:
        yield kid, of.get(id(kid))


def blocks(node: Node, template: list | None, within: bool = False) -> Iterator[tuple[str, int, bool]]:
    """Texts of blocks in page order, their characters in links, and whether they are template; no furniture."""
    fits = template if template is not None and template[0] == node.key else None
    for kid, inside in matched(node, fits):
        if not isinstance(kid, Node):
            if text := squeeze(kid[0]):
                yield text, kid[1], _constant(fits) or fits is not None and fits[5] == BOILERPLATE
            continue
        if kid.furniture():
            continue
        if kid.tag == "header":
            if within:
                for heading in (k for k in kid.children if isinstance(k, Node) and re.fullmatch("h[1-6]|hgroup", k.tag)):
                    yield from blocks(heading, None, True)
            continue
        yield from blocks(kid, inside, within or kid.tag in ("article", "main"))


def slots(node: Node, template: list) -> Iterator[tuple[Node, list]]:
    """The elements of a page that align with content slots of its template."""
    if template[5] == SLOT:
        yield node, template
        return
    for kid, inside in matched(node, template):
        if inside is not None:
            yield from slots(kid, inside)


def _regions(node: Node, template: list | None) -> Iterator[tuple[Node, list | None]]:
    """Outermost articles, or main elements without one, with their template nodes."""
    kids = [k for k in node.children if isinstance(k, Node) and not k.furniture()]
    for kid in kids:
        inside = next((t for t in template[4] if t[0] == kid.key), None) if template else None
        if kid.tag == "article" or "main" in kid.names and kid.tag == "div":
            yield kid, inside
            continue
        inner = list(_regions(kid, inside))
        if inner:
            yield from inner
        elif kid.tag == "main":
            yield kid, inside


def by_roles(root: Node, template: list | None) -> str:
    """Main text by roles and names: the largest article's blocks, or without one all blocks that aren't mostly links."""
    best = ""
    for region, inside in _regions(root, template):
        text = " ".join(t for t, _, constant in blocks(region, inside, True) if not constant)
        best = max(best, text, key=len)
    return best or " ".join(t for t, links, constant in blocks(root, template) if not constant and 2 * links <= len(t))


def extract(page: str | None, template: list | None) -> str:
    """Main text of a page: what varies in the slots of its host's template; by roles and names where it has none."""
    if not page:
        return ""
    root = parse(page)
    if template is not None and template[5] is not None:
        text = " ".join(t for region, inside in slots(root, template) for t, _, constant in blocks(region, inside, True) if not constant)
        if text:
            return text
    return by_roles(root, template)


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, template (JSON): one tree per host with verdicts, folded and counted over all of its pages.

    Folded inside tasks first. Over the partial trees of a host the pages of each
    path of keys are counted: a path that fewer than SUPPORT pages have holds no
    constant node, and falls away. Nothing else does, so a tree is bounded by what
    recurs on a host. Then the trees are folded, at most about FAN_IN at once, in as
    many rounds as it takes. Copies of a page count once.
    """
    schema = "host string, template string, path long, page long, value long, chars long, links long"
    names = [c.split()[0] for c in schema.split(", ")]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        counts: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows = [(host, json.dumps(t), *[None] * 5) for host, t in held.items()] + counts
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 2 + [pa.int64()] * 5)]
            held.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                if body := page.as_py():
                    code = body.encode("utf-8", "surrogatepass")
                    root, number = parse(body), xxhash.xxh64_intdigest(code) - (1 << 63)
                    made = shape(root, zlib.crc32(code))
                    held[host] = fold(held[host], made) if host in held else made
                    counts += [(host, None, path, number, *of) for path, of in own_texts(root).items()]
                if len(held) >= 2000 or len(counts) >= 100_000:
                    yield flush()
        if held:
            yield flush()

    def together(table: pa.Table) -> pa.Table:
        trees = sorted(table["template"].to_pylist())
        out = json.loads(trees[0])
        for t in trees[1:]:
            out = fold(out, json.loads(t))
        return pa.table({"host": table["host"].slice(0, 1), "template": pa.array([json.dumps(out)], pa.string())})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, tree in zip(batch.column(0), batch.column(1)):
                rows = [(at, page, len(on) >= SUPPORT) for at, on in paths(json.loads(tree.as_py())).items() for page in (sorted(on)[:1] if len(on) >= SUPPORT else on)]
                at, page, enough = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(page, pa.int64()), pa.array(enough, pa.bool_())], names=["host", "path", "page", "enough"])

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [json.dumps(prune(json.loads(t.as_py()), set(k.as_py() or ()))) for t, k in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=["host", "template"])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = []
            for tree, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = {c["path"]: (c["pages"], c["texts"], c["chars"], c["links"]) for c in counts or ()}
                trees.append(json.dumps(decide(json.loads(tree), known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=["host", "template"])

    read = materialise(pages.select(_host(url).alias("host"), F.col(html)).mapInArrow(partial, schema), "templates")
    parts = read.where("template is not null").select("host", "template")
    seen = parts.mapInArrow(listed, "host string, path long, page long, enough boolean").groupBy("host", "path").agg(F.bool_or("enough").alias("enough"), F.size(F.collect_set("page")).alias("n"))
    keep = seen.where(F.col("enough") | (F.col("n") >= SUPPORT)).groupBy("host").agg(F.collect_list("path").alias("keep"))
    parts = materialise(parts.join(keep, "host", "left").select("host", "template", "keep").mapInArrow(pruned, "host string, template string"), "pruned")
    steps = [parts]
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = F.pmod(F.xxhash64("template"), F.lit(-(-most // FAN_IN)))
        parts = materialise(parts.groupBy("host", groups.alias("group")).applyInArrow(together, "host string, template string"), "folded")
        steps.append(parts)
    once = read.where("path is not null").groupBy("host", "path", "page").agg(*(F.first(c).alias(c) for c in ("value", "chars", "links")))
    texts = once.groupBy("host", "path", "value").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    counts = texts.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    counts = counts.where(F.col("pages") >= SUPPORT).groupBy("host").agg(F.collect_list(F.struct("path", "pages", "texts", "chars", "links")).alias("counts"))
    known = materialise(parts.join(counts, "host", "left").select("host", "template", "counts").mapInArrow(decided, "host string, template string"), "decided")
    discard(read, *steps)
    return known


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page.

    Character references are decoded, white space in a block is one space, and
    blocks are joined by one space in page order. Null or empty pages give an
    empty text, a null or odd url the host ''. Repeated rows and null keys stay;
    an empty table gives none; other columns aren't read.

    Hosts that have more than a thousandth of all pages are dealt to copies of
    their template. There can't be over a thousand of them, so they are broadcast.
    """
    worker_path(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    sizes = materialise(pages.groupBy(_host(url).alias("host")).agg(F.count("*").alias("n")), "hosts")
    room = max(COPY_PAGES, (sizes.agg(F.sum("n")).first()[0] or 0) // SHARE)
    large = F.broadcast(sizes.where(F.col("n") > room).select("host", F.ceil(F.col("n") / room).alias("copies")))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("url"), F.col(html).alias("html"), _host(url).alias("host")).join(large, "host", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(key, "html"), copies))
    known = templates(pages, url, html).join(large, "host", "left").select("host", "template", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
    joined = rows.join(known, ["host", "salt"], "left").select(key, "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, host, template in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = json.loads(template.as_py()) if template.is_valid else None
                texts.append(extract(page.as_py(), known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"{key} {kind}, url string, text string, n_chars long")
