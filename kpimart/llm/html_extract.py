"""Main-text extraction by wrapper induction.

Each page becomes a tree of its block elements, in which neighbouring elements
of one kind are one node. The distinct trees of all pages of a host are aligned
by simple tree matching into the host's skeleton, ``TREES_AT_ONCE`` in a task;
where a host has more, their skeletons are aligned again. All distinct pages of
the host are then aligned with it, and Spark sums their texts by node: a text that a node holds in most of the pages that have the
node (``CONSTANT_SHARE``, and ``CONSTANT_PAGES`` pages at least) is template;
slots whose text varies are content. Pages of a host that agree in all that
the element rules leave of them are copies of one article and count as one
page. Every page is then aligned with the wrapper, and its blocks are kept
unless they are template.

What varies is not always article: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out by element,
role and class name, whatever the wrapper says. Where a page marks its article
(``article``, ``main``), only blocks inside count.

A host may hold any share of the pages: copies, trees and counts are combined
before the shuffle, and the trees of a host are dealt by hash; skeletons and wrappers are broadcast if their
measured size is small, and joined by salted host otherwise.

Edge cases: a null or empty page has no text; broken markup is read as far as
it goes (unclosed elements end with their parent); a host with too few pages
for a template keeps all that the element rules leave; pages without a host
in their url share the empty host; repeated pages are extracted each.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.session import scratch_dir

TREES_AT_ONCE = 64
CONSTANT_SHARE = 0.6
CONSTANT_PAGES = 3
BROADCAST_BYTES = 32 << 20
SALTS = 32

# Elements of HTML by their part in a page.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
    table caption tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "select")
LEFT_OUT = frozenset("nav footer aside form menu dialog head button search".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
LEFT_OUT_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup sidebar widget related
    recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer
    masthead header comment comments disqus reply replies respond pagination pager""".split()
)
ARTICLE = frozenset(("article", "main"))

_RAW = "|".join(RAW)
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """A block element, or the run of its like siblings in a page's tree."""

    __slots__ = ("sign", "tag", "out", "inside", "children", "texts", "parent")

    def __init__(self, sign: str, tag: str, out: bool, inside: bool, parent: Node | None):
        self.sign, self.tag, self.out, self.inside, self.parent = sign, tag, out, inside, parent
        self.children: list[Node] = []
        self.texts: list[str] = []


def _names(rest: str) -> tuple[list[str], str]:
    """Lower-case words of class and id, and the role."""
    words: list[str] = []
    role = ""
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        value = (a or b or c).lower()
        if name.lower() == "role":
            role = value.strip()
        else:
            words += _NAME.findall(value)
    return words, role


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """``(tree, blocks)``: the tree of block elements, like siblings merged,
    and the page's texts in order, each with its node."""
    root = Node("", "", False, False, None)
    open_nodes: list[tuple[str, Node]] = [("", root)]
    blocks: list[tuple[Node, str]] = []
    text: list[str] = []
    last_article = max((m.start() for m in re.finditer(r"<(?:article|main)\b", page, re.I)), default=-1)

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                node = open_nodes[-1][1]
                node.texts.append(line)
                blocks.append((node, line))

    def close(names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        for i in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[i][0] in names:
                del open_nodes[i:]
                return
            if open_nodes[i][0] in barrier:
                return

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag not in BLOCKS:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if m["end"]:
            close((tag,), ())
            continue
        close(("p",), ("td", "th", "li", "div", "table", "article", "section"))
        if tag in ("li", "dt", "dd", "tr", "td", "th"):
            like = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}.get(tag, ("td", "th"))
            close(like, ("ul", "ol", "dl", "table", "menu"))
        if tag in VOID:
            continue
        parent = open_nodes[-1][1]
        words, role = _names(m["rest"]) if m["rest"] else ([], "")
        inside = parent.inside or tag in ARTICLE or role == "main"
        named = role in LEFT_OUT_ROLES or not LEFT_OUT_NAMES.isdisjoint(words)
        if parent.out or tag in LEFT_OUT:
            out = True
        elif tag == "header":
            out = not parent.inside or named
        elif named and tag not in ARTICLE and tag not in ("html", "body"):
            # a frame around the article is not left out for its names
            out = inside or m.start() >= last_article or _closes_before(page, m.end(), tag, last_article)
        else:
            out = False
        sign = ".".join([tag, *sorted(set(words))])
        if parent.children and parent.children[-1].sign == sign and parent.children[-1].out == out:
            node = parent.children[-1]
        else:
            node = Node(sign, tag, out, inside, parent)
            parent.children.append(node)
        open_nodes.append((tag, node))
    if at < len(page):
        text.append(page[at:])
    flush()
    return root, blocks


def _closes_before(page: str, at: int, tag: str, limit: int) -> bool:
    """Whether the element opened before ``at`` ends before ``limit``."""
    depth = 1
    for m in re.finditer(rf"<(/?){tag}\b", page[at:limit], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return True
    return False


def text_hash(line: str) -> str:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def to_plain(node: Node) -> tuple[list, list[list[str]]]:
    """A tree as nested lists of sign and children, and the distinct hashes of
    its nodes' texts, the nodes in preorder."""
    texts: list[list[str]] = []

    def plain(node: Node) -> list:
        texts.append(sorted({text_hash(t) for t in node.texts}))
        return [node.sign, [plain(c) for c in node.children]]

    return plain(node), texts


def preorder(tree: list) -> list[list]:
    """The nodes of nested lists, each before its children."""
    out, queue = [], [tree]
    while queue:
        node = queue.pop()
        out.append(node)
        queue += reversed(node[1])
    return out


def tree_match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: the size of the largest matching that keeps the
    order of siblings, and its pairs of nodes."""
    if a[0] != b[0]:
        return 0, []
    rows, columns = a[1], b[1]
    best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(rows):
        for j, y in enumerate(columns):
            here = 0
            if x[0] == y[0]:
                found[i, j] = tree_match(x, y)
                here = best[i][j] + found[i, j][0]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], here)
    pairs = [(a, b)]
    i, j = len(rows), len(columns)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += found[i - 1, j - 1][1]
            i, j = i - 1, j - 1
    return best[len(rows)][len(columns)] + 1, pairs


def _grow(node: list) -> list:
    return [node[0], [_grow(c) for c in node[1]]]


def induce(trees: list[list]) -> list:
    """The skeleton of a host's trees: nested lists of sign and children."""
    skeleton = _grow(trees[0])
    for tree in trees[1:]:
        matched = {id(t): w for w, t in tree_match(skeleton, tree)[1]}
        queue = [tree]
        while queue:
            t = queue.pop()
            w = matched[id(t)]
            place = 0
            for child in t[1]:
                if id(child) in matched:
                    place = next(i for i, c in enumerate(w[1]) if c is matched[id(child)]) + 1
                    queue.append(child)
                else:
                    w[1].insert(place, _grow(child))
                    place += 1
    return skeleton


def article_of(blocks: list[tuple[Node, str]], template: dict[int, frozenset]) -> str:
    """The text of the blocks that are neither template nor left out."""
    kept = [
        (node, line)
        for node, line in blocks
        if not node.out and not (id(node) in template and text_hash(line) in template[id(node)])
    ]
    inside = [(node, line) for node, line in kept if node.inside]
    return "\n\n".join(line for _, line in inside or kept)


def extract(page: str, wrapper: list | None) -> str:
    """The article's text: the blocks that are neither template nor left out."""
    tree, blocks = parse(page)
    template: dict[int, frozenset] = {}
    if wrapper is not None:
        plain: dict[int, Node] = {}

        def keyed(node: Node) -> list:
            out = [node.sign, [keyed(c) for c in node.children], ()]
            plain[id(out)] = node
            return out

        mine = keyed(tree)
        for w, t in tree_match(wrapper, mine)[1]:
            template[id(plain[id(t)])] = frozenset(w[2])
    return article_of(blocks, template)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _trees(batches):
    for batch in batches:
        articles, trees, texts = [], [], []
        for page in batch.column(2).to_pylist():
            root, blocks = parse(page or "")
            article = article_of(blocks, {}).encode("utf-8", "surrogatepass")
            articles.append(hashlib.blake2b(article, digest_size=16).digest())
            tree, found = to_plain(root)
            trees.append(json.dumps(tree))
            texts.append(json.dumps(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(articles, pa.binary()), pa.array(trees, pa.string()), pa.array(texts, pa.string())],
            ["host", "pick", "article", "tree", "texts"],
        )


def _induce_trees(key, table):
    table = table.sort_by([("pick", "ascending"), ("tree", "ascending")])
    skeleton = induce([json.loads(t) for t in table["tree"].to_pylist()])
    return pa.table({"host": [key[0].as_py()], "pick": table["pick"][:1], "tree": [json.dumps(skeleton)]})


def skeletons_of(trees: DataFrame, at_once: int = TREES_AT_ONCE) -> DataFrame:
    """``host, wrapper``: every host's skeleton of all its distinct trees
    (host, pick, tree), aligned by rising ``pick``. No task aligns many more
    than ``at_once``: those of larger hosts are dealt by hash, and the
    skeletons are dealt and aligned again until few are left."""
    once = lambda df: df.groupBy("host", "tree").agg(F.min("pick").alias("pick"))
    parts = _written(once(trees), "skeletons")
    while True:
        large = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > at_once)
        last = large.isEmpty()
        if last:
            dealt = parts.withColumn("deal", F.lit(0).cast("long"))
        else:
            deal = F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / at_once))
            dealt = parts.join(large, "host", "left").withColumn("deal", F.coalesce(deal, F.lit(0)))
        merged = dealt.select("host", "deal", "pick", "tree").groupBy("host", "deal")
        found = merged.applyInArrow(_induce_trees, "host string, pick long, tree string")
        if last:
            return _written(found.select("host", F.col("tree").alias("wrapper")), "skeletons")
        parts = _written(once(found), "skeletons")


def _node_texts(batches):
    """``host, node, text`` of the texts of each page's aligned nodes, and one
    row without a text for each of the nodes."""
    known: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for batch in batches:
        hosts, nodes, texts = [], [], []
        for host, tree, found, skeleton in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (skeleton, tree) not in known:
                if len(known) > 2000:
                    known.clear()
                ours, page = json.loads(skeleton), json.loads(tree)
                node_at = {id(w): i for i, w in enumerate(preorder(ours))}
                place = {id(t): i for i, t in enumerate(preorder(page))}
                known[skeleton, tree] = [(node_at[id(w)], place[id(t)]) for w, t in tree_match(ours, page)[1]]
            lists = json.loads(found)
            for node, at in known[skeleton, tree]:
                lines = [None, *lists[at]]
                hosts += [host] * len(lines)
                nodes += [node] * len(lines)
                texts += lines
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(texts, pa.string())], ["host", "node", "text"]
        )


def _with_constants(batches):
    """``host, wrapper``: the skeletons with each node's constant texts."""
    for batch in batches:
        out = []
        for skeleton, constants in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            wrapper = json.loads(skeleton)
            nodes = preorder(wrapper)
            for node in nodes:
                node.append([])
            for c in constants or ():
                nodes[c["node"]][2].append(c["text"])
            out.append(json.dumps(wrapper))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "wrapper"])


def _join_hosts(rows: DataFrame, found: DataFrame, salt: Column, how: str) -> DataFrame:
    """``rows`` with the ``__wrapper`` of their ``__host``. ``found`` (host,
    wrapper) is best read from a written table: it is measured first."""
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    found = found.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), "__host", how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long").alias("__salt")
    salted = rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)))
    return salted.join(found.select("*", salts), ["__host", "__salt"], how)


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wrappers(pages: DataFrame, trees_at_once: int = TREES_AT_ONCE) -> DataFrame:
    """``host, wrapper`` (JSON) of every host."""
    pick = F.xxhash64("url", "html").alias("pick")
    trees = pages.select(host_of(F.col("url")).alias("host"), pick, "html").mapInArrow(
        _trees, "host string, pick long, article binary, tree string, texts string"
    )
    # one page for all copies of an article
    once = trees.groupBy("host", "article").agg(F.min(F.struct("pick", "tree", "texts")).alias("page"))
    distinct = _written(once.select("host", "page.*"), "page-trees")
    skeletons = skeletons_of(distinct.select("host", "pick", "tree"), trees_at_once)
    aligned = _join_hosts(distinct.withColumnRenamed("host", "__host"), skeletons, F.col("pick"), "inner")
    counts = (
        aligned.select("__host", "tree", "texts", "__wrapper")
        .mapInArrow(_node_texts, "host string, node int, text string")
        .groupBy("host", "node", "text")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("text").isNull() | (F.col("n") >= CONSTANT_PAGES))
    )
    counts = _written(counts, "node-texts")
    totals = counts.filter(F.col("text").isNull()).select("host", "node", F.col("n").alias("pages"))
    constants = (
        counts.filter(F.col("text").isNotNull())
        .join(totals, ["host", "node"])
        .filter(F.col("n") >= F.lit(CONSTANT_SHARE) * F.col("pages"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("constants"))
    )
    return (
        skeletons.join(constants, "host", "left")
        .select("host", "wrapper", "constants")
        .mapInArrow(_with_constants, "host string, wrapper string")
    )


def extract_pages(pages: DataFrame, host_wrappers: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every page with ``text`` and ``n_chars``.
    ``host_wrappers`` is best read from a written table: it is measured first."""
    rows = pages.select(
        *keep, F.col("html").alias("__html"), host_of(F.col("url")).alias("__host"), F.xxhash64("url", "html").alias("__pick")
    )
    joined = _join_hosts(rows, host_wrappers, F.col("__pick"), "left")

    def run(batches):
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 200:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(extract(page or "", known.get(wrapper)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    schema = T.StructType(
        [*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return joined.select(*keep, "__html", "__wrapper").mapInArrow(run, schema)
