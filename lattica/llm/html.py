r"""HTML extraction: gradient-boosted trees over DOM-node features (subtree density, attribute tokens, depth, sibling
statistics) give each node a content score; hierarchical decoding chooses labels so that nothing below a rejected node is
kept and no kept node is empty.

There are no hand labels. Pages that mark their article (`article`, `main`, itemprop=articleBody) teach the trees: what lies
in the article is content, the rest is not. Each training page is also shown a second time in another dress (`dress`): the
article's marks are taken off, menus and footers become plain parts with other names, and lists of links, notices and
comments made of the page's own words are put before, into and behind the article; what is put in is no content. So the
trees learn from structure and names, on a node and on the way to it, and no rule overrules them. Only what no reader
sees (the attribute hidden, aria-hidden=true, display:none and tags of HIDDEN), and forms, are left out by rule; a class
or id never hides. Training uses a bounded, documented sample: about `most` pages by hash of
the id, and of each page at most `nodes` nodes at even distances; histograms are worked out in numpy on that sample.

Defined cases: null html is empty and gives an empty text; unclosed and stray tags are mended as a browser would roughly do;
a page without any text gives an empty text; repeated rows are extracted each; a table without a marked article gives
all visible text; a very long page is read whole, in time that grows with it, whatever its tags and quotes are; a quote that never closes ends with its tag; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, small_slices, table, texts

PARAMETERS = dict(most=600, nodes=120, trees=60, depth=4, rate=0.2)
#: One token of a page: comment, declaration, end tag, start tag, text. A quote opens a value only behind an equals sign, so an
#: apostrophe in an unquoted value is a character like others. Nothing backtracks into what it has read.
_HEAD = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)"
TOKEN = re.compile(_HEAD + r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>|([^<]++|<)""", re.S)
#: The same for a page with a quote that never closes: tags end at the next ">".
LENIENT = re.compile(_HEAD + r"([^>]*+)>|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("head script style textarea title noscript template iframe svg form button select input object canvas option".split())
BLOCK = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption header footer nav aside form address details summary fieldset hr hgroup center menu dialog".split())
#: Start tags that end an open paragraph, and tags that end an open one of the same set.
ENDS_P = BLOCK - {"html", "body"}
SAME = [{"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}, {"thead", "tbody", "tfoot"}]
#: Attribute tokens with a meaning of their own; all others are hashed into a few bins.
WORDS_OUT = "ad ads advert advertisement banner breadcrumb comment comments cookie disclaimer footer header menu meta nav navbar newsletter notice popup promo related replies reply respond share sidebar social sponsor subscribe toolbar widget consent legal".split()
WORDS_IN = "article body content entry main post story text".split()
TAGS = "p h1 h2 h3 li ul ol div section article main header footer nav aside td tr table blockquote pre span a b figure body".split()
BINS = 4
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "own", "chars", "links", "tags", "commas", "depth", "hidden", "order")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None):
        self.tag, self.tokens, self.parent, self.children, self.own = tag, tokens, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = bool(parent and parent.hidden) or tag in HIDDEN
        self.chars = self.links = self.commas = 0
        self.tags = 1


def parse(page: str) -> tuple[list[Node], list]:
    """All nodes in page order, and the page's visible stream: (node, text) with text None where a block starts or ends."""
    root = Node("#page", [], None)
    nodes, stream, at = [root], [], root
    pos, size = 0, len(page)

    def close(upto: Node) -> None:
        nonlocal at
        while at is not upto:
            if at.tag in BLOCK:
                stream.append((at, None))
            at = at.parent

    token, last = TOKEN, page.rfind(">")
    while pos < size:
        if pos > last and page[pos] == "<" and not page.startswith("<!--", pos):  # no tag ends any more
            stream.append((at, page[pos:]))
            break
        m = token.match(page, pos)
        if m[4] == "<" and token is TOKEN and page[pos + 1 : pos + 2].isalpha():  # a quote that never closes
            token = LENIENT
            m = token.match(page, pos)
        pos = m.end()
        end, start, attributes, text = m.groups()
        if text is not None:
            stream.append((at, text))
        elif start:
            tag = start.lower()
            if tag in ENDS_P or any(tag in s for s in SAME):
                up = at
                while up is not root and up.tag not in ("div", "td", "article", "section", "table", "ul", "ol", "body", "main"):
                    if up.tag == "p" and tag in ENDS_P or any(tag in s and up.tag in s for s in SAME):
                        close(up.parent)
                        break
                    up = up.parent
            tokens: list[str] = []
            unseen = False
            if attributes and not attributes.isspace():
                for name, *value in ATTRIBUTE.findall(attributes):
                    name, value = name.lower(), "".join(value)
                    if name in ("class", "id", "role", "itemprop", "aria-label"):
                        tokens += [x for x in SPLIT.split(value.lower()) if x]
                    elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and UNSEEN.search(value):
                        unseen = True
            node = Node(tag, tokens, at)
            if tag == "br":
                stream.append((at, " "))
            node.hidden = node.hidden or unseen
            at.children.append(node)
            nodes.append(node)
            if tag in BLOCK:
                stream.append((node, None))
            if tag in RAW:
                m = RAW[tag].search(page, pos)
                pos = m.end() if m else size
            elif tag not in VOID and not attributes.endswith("/"):
                at = node
        elif end:
            tag = end.lower()
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                close(up.parent)
                if up.tag in BLOCK and at is up:
                    stream.append((up, None))
    close(root)
    for node, text in stream:
        if text:
            n = len(text) - text.count(" ")
            node.own.append(text)
            node.chars += n
            node.commas += text.count(",") + text.count(".")
            if node.tag == "a":
                node.links += n
    for node in reversed(nodes[1:]):
        up = node.parent
        up.chars += node.chars
        up.links += node.chars if node.tag == "a" else node.links
        up.commas += node.commas
        up.tags += node.tags
    return nodes, stream


#: Parts that are no content even in an article; the trees learn that from the pages.
ASIDE = {"nav", "aside", "footer", "menu", "dialog"}
PARTS = {"nav", "footer", "aside", "header", "menu", "dialog"}


def _marked(n: Node) -> bool:
    return n.tag in ("article", "main") or "articlebody" in n.tokens


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node: sizes, densities, depth, siblings, tags, attribute tokens of the node, its parent and the way to it."""
    out = np.zeros((len(nodes), 26 + 2 * len(TAGS) + BINS), np.float32)
    whole = max(nodes[0].chars, 1)
    number = {id(n): k for k, n in enumerate(nodes)}
    like = {id(n): Counter(x.tag for x in n.children) for n in nodes}
    way = np.zeros((len(nodes), 6), np.float32)  # of the node and all above it
    for k, node in enumerate(nodes):
        up = node.parent or node
        row, wide = out[k], 2 * node.chars >= whole
        bad, good = sum(x in WORDS_OUT for x in node.tokens), sum(x in WORDS_IN for x in node.tokens)
        links = node.links / max(node.chars, 1)
        # named parts and link lists, small and large ones apart; marks of an article; headings of their own
        own = (bad * (not wide), bad * wide, good, node.tag in PARTS, _marked(node), links * (not wide))
        way[k] = np.maximum(way[number[id(up)]], own) if node.parent else own
        row[:26] = (
            node.chars, node.chars / node.tags, links, node.commas / max(node.chars, 1), node.depth, node.tags, len(node.children), len(up.children),
            like[id(up)][node.tag], like[id(up)][node.tag] / max(len(up.children), 1), node.chars / max(up.chars, 1), up.chars / whole, node.chars / whole,
            up.links / max(up.chars, 1), up.chars / up.tags, len(node.own), bad, good, sum(x in WORDS_OUT for x in up.tokens), sum(x in WORDS_IN for x in up.tokens), *way[k],
        )
        if node.tag in TAGS:
            row[26 + TAGS.index(node.tag)] = 1
        if up.tag in TAGS:
            row[26 + len(TAGS) + TAGS.index(up.tag)] = 1
        for x in {*node.tokens, *up.tokens}:
            if x not in WORDS_OUT and x not in WORDS_IN:
                row[26 + 2 * len(TAGS) + zlib.crc32(x.encode()) % BINS] += 1
    return out


def _teacher(nodes: list[Node]) -> np.ndarray | None:
    """1 for nodes whose visible text is mostly in a marked article and not put in by `dress`; None without a mark."""
    number = {id(n): k for k, n in enumerate(nodes)}
    inside, size, good = (np.zeros(len(nodes), np.int64) for _ in range(3))
    for k, n in enumerate(nodes):
        above = inside[number[id(n.parent)]] if n.parent else 0
        inside[k] = 0 if n.hidden or PUT_IN in n.tokens or n.tag in ASIDE else 1 if _marked(n) else above
    if not inside.any():
        return None
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        own = 0 if n.hidden else sum(len(x) - x.count(" ") for x in n.own)
        size[k] += own
        good[k] += own * inside[k]
        if n.parent:
            size[number[id(n.parent)]] += size[k]
            good[number[id(n.parent)]] += good[k]
    return np.where(size > 0, 2 * good > size, inside).astype(np.int8)


#: The class by which parts put into a training page are known to the teacher; it is taken off before features are made.
PUT_IN = "partputin"
LISTS, NOTES, ENDS = "menu nav navbar toolbar related breadcrumb social share sidebar".split(), "ad notice comment comments cookie newsletter promo sponsor disclaimer banner popup reply".split(), "footer legal copyright".split()


def _unwrap(node: Node) -> None:
    """Takes a node out; what is in it goes to its parent."""
    up = node.parent
    at = up.children.index(node)
    up.children[at : at + 1] = node.children
    up.own += node.own
    below = list(node.children)
    for n in node.children:
        n.parent = up
    while below:
        n = below.pop()
        n.depth -= 1
        below += n.children
    while up:
        up.tags -= 1
        up = up.parent


def dress(page: str, rng: random.Random) -> tuple[list[Node], np.ndarray] | None:
    """The nodes of a page in another dress, and their labels; None for a page without a marked article."""
    m = re.search(r"<(article|main)\b[^>]*>(.*)</\1\s*>", page, re.S | re.I)
    if not m:
        return None
    words = re.sub(r"<[^>]*>", " ", m[2]).split() or ["x"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def part() -> str:
        tag = rng.choice(("div", "section", "aside", "ul", "div"))
        if rng.random() < 0.15:  # known by its tag alone
            tag = rng.choice(("aside", "nav", "footer"))
            inner = "".join(f"<p>{some(rng.randint(3, 30))}</p>" for _ in range(rng.randint(1, 3)))
            return f'<{tag} class="{PUT_IN}">{inner}</{tag}>'
        if rng.random() < 0.4:
            inner = "".join(f'<li><a href="#">{some(rng.randint(1, 6))}</a></li>' for _ in range(rng.randint(2, 9)))
            return f'<{tag} class="{PUT_IN} {rng.choice(LISTS)}">{inner}</{tag}>' if rng.random() < 0.8 else f'<{tag} class="{PUT_IN}">{inner}</{tag}>'
        inner = "".join(f"<{x}>{some(rng.randint(3, 40))}</{x}>" for x in rng.choices(("p", "div", "span", "h3"), k=rng.randint(1, 5)))
        if rng.random() < 0.4:
            inner = f"<div>{inner}</div>"
        return f'<{tag} class="{PUT_IN} {rng.choice(NOTES + LISTS)}">{inner}</{tag}>'

    def piece() -> str:
        """Content of a kind that the article may not have."""
        a, b = some(rng.randint(1, 12)), some(rng.randint(1, 5))
        kinds = (f"<p>{a}</p>", f'<p>{a} <a href="#">{b}</a> {some(4)}</p>', f"<ul><li>{a}</li><li>{b}</li><li>{some(6)}</li></ul>", f"<blockquote><p>{a}</p></blockquote>", f"<h2>{b}</h2>", f"<table><tr><td>{a}</td><td>{b}</td></tr></table>", f"<p>{b}</p>", f'<div class="{rng.choice(("meta", "byline", "author", "date"))}">{b}</div>')
        return rng.choice(kinds)

    before, inside, behind = ("".join(part() for _ in range(rng.choice(k))) for k in ((0, 0, 1, 2), (0, 0, 0, 1), (0, 1, 2)))
    begin, end = m.span(2)
    gaps = [x.end() for x in re.finditer(r"</(?:p|div|ul|h[1-6])\s*>", m[2], re.I)] or [0]
    gap, first = begin + rng.choice(gaps), begin + gaps[0]
    inside += "".join(piece() for _ in range(rng.choice((0, 1, 1, 2, 3))))
    top = piece() if first <= gap and rng.random() < 0.5 else ""
    page = page[: m.start()] + before + page[m.start() : min(first, gap)] + top + page[min(first, gap) : gap] + inside + page[gap : m.end()] + behind + page[m.end() :]
    nodes, _ = parse(page)
    label = _teacher(nodes)
    if rng.random() < 0.25:
        at = next(k for k, n in enumerate(nodes) if _marked(n))
        _unwrap(nodes.pop(at))
        label = np.delete(label, at)
    plain, names = rng.random() < 0.7, rng.choice(([], [], ["post"], ["entry", "body"], ["story"], ["text"]))
    for n in nodes:
        n.tokens = [x for x in n.tokens if x != PUT_IN]
        if _marked(n) and plain:
            n.tag, n.tokens = "div", [*names]
        elif n.tag in PARTS and rng.random() < 0.5:
            n.tokens = [*n.tokens, rng.choice(ENDS if n.tag == "footer" else LISTS)]
            n.tag = "div"
        elif n.tag == "body" and rng.random() < 0.3:
            n.tokens = [*n.tokens, "has", rng.choice(LISTS)]
        elif n.tag == "p" and rng.random() < 0.05:
            n.tag = "div"
    return nodes, label


class Trees:
    """Boosted regression trees of fixed depth for log-odds: feature, threshold and leaf arrays."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int = 32) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1).astype(np.int64)
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        base, inner = float(np.log(share / (1 - share))), 2**depth - 1
        f, t, leaves = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
        z = np.full(len(y), base)
        for k in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            for level in range(depth):
                first = 2**level - 1
                many = 2**level
                best = np.full(many, 1e-9)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = (at - first) * (bins + 1) + code[:, j]
                    gs, hs = (np.bincount(key, v, many * (bins + 1)).reshape(many, -1).cumsum(1) for v in (g, h))
                    gl, hl, ga, ha = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    top = gain.argmax(1)
                    better = gain[np.arange(many), top] > best
                    best = np.where(better, gain[np.arange(many), top], best)
                    f[k, first : first + many][better] = j
                    t[k, first : first + many][better] = e[top[better]]
                at = 2 * at + 1 + (x[np.arange(len(x)), f[k, at]] > t[k, at])
            at -= inner
            gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            leaves[k] = rate * gs / (hs + 1)
            z += leaves[k, at]
        return cls(base, f, t.astype(np.float32), leaves)


def weights(nodes: list[Node]) -> np.ndarray:
    """How much a node's verdict counts: for its own text, and a tenth for all visible text in it."""
    number = {id(n): k for k, n in enumerate(nodes)}
    out, whole = np.zeros(len(nodes)), np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        own = 0 if n.hidden else sum(map(len, map(str.strip, n.own)))
        whole[k] += own
        out[k] = own + 0.1 * whole[k]
        if n.parent:
            whole[number[id(n.parent)]] += whole[k]
    return out


def decode(nodes: list[Node], gain: np.ndarray) -> np.ndarray:
    """Labels of greatest total gain among those without contradiction: below a rejected node all are rejected, and a
    hidden node is. A node whose best total is not positive is rejected."""
    number = {id(n): k for k, n in enumerate(nodes)}
    value = np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        value[k] = 0.0 if n.hidden else max(0.0, value[k] + gain[k])
        if n.parent:
            value[number[id(n.parent)]] += value[k]
    kept = np.zeros(len(nodes), bool)
    for k, n in enumerate(nodes):
        kept[k] = value[k] > 0 and (n.parent is None or kept[number[id(n.parent)]])
    return kept


INLINE_KEEPS = set("b i em strong span a u s small sup sub code mark abbr q cite time font big tt kbd var samp del ins".split())


def main_text(page: str, trees: Trees | None, predicted: np.ndarray | None = None, parsed=None) -> str:
    nodes, stream = parsed or parse(page)
    score = trees.predict(features(nodes)) if predicted is None else np.array(predicted)
    number = {id(n): k for k, n in enumerate(nodes)}
    for k, n in enumerate(nodes):
        if n.parent and n.tag in INLINE_KEEPS and n.parent.tag not in ("#page", "body", "html"):
            score[k] = score[number[id(n.parent)]]  # an inline node goes with the block around it
    kept = decode(nodes, score * weights(nodes))
    blocks, run = [], []
    for node, text in stream:
        if text is None:
            if run:
                blocks.append(" ".join(entities.unescape("".join(run)).split()))
                run = []
        elif kept[number[id(node)]]:
            run.append(text)
    if run:
        blocks.append(" ".join(entities.unescape("".join(run)).split()))
    return "\n".join(b for b in blocks if b)


def train(pages: DataFrame, most: int, nodes: int, trees: int, depth: int, rate: float) -> Trees:
    many = pages.count()
    few = pages.where(F.abs(F.xxhash64("page_id", F.lit(29)) % 1_000_003) / 1_000_003 < most / max(many, 1)).select("html", F.xxhash64("page_id").alias("seed"))
    schema = pa.schema([("seed", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "html", 2_000_000):
            out = []
            for page, seed in zip(texts(batch, "html"), batch.column(1).to_pylist(), strict=True):
                own, _ = parse(page)
                for shown in ((own, _teacher(own)), dress(page, random.Random(seed))):
                    if shown and shown[1] is not None:
                        step = -(-len(shown[0]) // nodes)
                        out.append((seed, features(shown[0])[::step].tobytes(), shown[1][::step].tobytes()))
            if out:
                yield record_batch(schema, *zip(*out))

    got = sorted(arrow_map(few, run, "seed long, x binary, y binary").collect())  # a bounded sample
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, 26 + 2 * len(TAGS) + BINS)
    y = np.frombuffer(b"".join(bytes(r["y"]) for r in got), np.int8).astype(float)
    return Trees.fit(x, y, trees, depth, rate) if len(y) else Trees(1.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([("page_id", pages_type(pages)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "html", 2_000_000):
            parsed = [parse(x) for x in texts(batch, "html")]
            every = shared.value.predict(np.concatenate([features(nodes) for nodes, _ in parsed]))
            cut = np.split(every, np.cumsum([len(nodes) for nodes, _ in parsed])[:-1])
            out = [main_text("", None, score, p) for score, p in zip(cut, parsed)]
            yield record_batch(schema, batch.column(1), batch.column(2), out, [len(x) for x in out])

    return arrow_map(pages.select("html", "page_id", "url"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def pages_type(pages: DataFrame) -> pa.DataType:
    return pa.int32() if pages.schema["page_id"].dataType.simpleString() == "int" else pa.int64()


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages, **PARAMETERS))
