"""Main text of web pages by wrapper induction.

Of every host a bounded sample of pages teaches a wrapper: their DOM trees are
aligned by simple tree matching, one after the other, into one tree. A node
whose text is the same wherever it occurs is template; slots whose text varies
hold content, and the container with most of it is the main slot. Each page is
then aligned with its host's wrapper, and what isn't template inside the main
slot becomes its text. Menus, adverts and the like vary as well; they are told
by what their elements are and are called, where the alignment leaves that open.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpointed, draw, in_batches

#: Pages of a host that teach its wrapper, about.
PAGES_PER_HOST = 12
#: A text is template if at least so many aligned pages have it and none has another; inside the main slot, if it is a block that ``NEARLY_ALL`` of them have.
LEAST_EQUAL = 4
NEARLY_ALL = 0.9
#: Characters of a block's text outside links from which on it counts as prose, and how much more such text weighs where the main slot is chosen.
PROSE_FROM, PROSE_WEIGHT = 20, 10
#: Pairs of siblings that are all compared; among more, those within a band about the diagonal, so wide that about ``BAND_PAIRS`` are compared.
FULL_PAIRS, BAND, BAND_PAIRS = 10_000, 24, 500_000
#: Levels of a page's tree; what is nested deeper lies side by side on the last level, in its order.
MAX_DEPTH = 150
#: Hosts whose shares (a name and a number) are sent to all executors at most; with more, pages meet them in a shuffled join.
MAX_SENT_HOSTS = 200_000
#: Wrappers that are sent to all executors as one value, in bytes; with more, pages meet them in a join.
MAX_SENT_BYTES = 16 << 20

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the key ends an open element of these, unless one of the second lies between.
ENDS = {"p": ({"p"}, set())} | {"li": ({"li", "p"}, {"ul", "ol", "menu"})}
ENDS |= {x: ({"p"}, set()) for x in BLOCKS if x not in ("p", "li", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption")}
ENDS |= {"dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}

#: Elements that are never main text.
ASIDE_TAGS = frozenset("nav header footer aside form button menu dialog head label input".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in a class or id that say the same.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer foot sidebar aside widget widgets related recommended share sharing social newsletter subscribe signup login search comment comments respond reply replies disqus discussion toolbar pagination pager skip legal copyright".split()
)
#: Those of them that name parts of an article as well: inside the main slot the alignment decides.
WEAK_WORDS = frozenset("discussion legal copyright search alert header head foot reply replies".split())
MAIN_TAGS = ("article", "main")
HEADINGS = tuple(f"h{k}" for k in range(1, 7))
MAIN_WORDS = frozenset("article content main post entry story body".split())

# a quote opens a value only after an equals sign
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element: its tag, its label for matching, its children (nodes and strings)."""

    __slots__ = ("tag", "label", "children", "leaf", "aside", "weak", "main", "volume")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.label, self.leaf = tag, [], tag, True
        self.aside, self.weak, self.main, self.volume = tag in ASIDE_TAGS, False, tag in MAIN_TAGS, 0
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
                if name in ("class", "id"):
                    words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                    said = ASIDE_WORDS.intersection(words) if tag not in ("html", "body", *MAIN_TAGS, *HEADINGS) else frozenset()
                    self.aside |= not said <= WEAK_WORDS
                    self.weak |= bool(said)
                    self.main |= tag in ("div", "section") and not MAIN_WORDS.isdisjoint(words)
                    if name == "class" and words:
                        self.label = f"{tag}.{words[0]}"
                elif name == "role":
                    self.aside |= value.lower() in ASIDE_ROLES
                    self.main |= value.lower() == "main"
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    self.aside = True

    def text(self) -> str:
        """All text below, with white space turned into single spaces."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in RAW:
                stack += reversed(x.children)
        return " ".join(" ".join(out).split())

    template_text = text


def weigh(root: Node) -> None:
    """Notes how much text each element holds, prose more than the rest; none in what is never main text."""
    order, stack = [], [(root, None, False)]
    while stack:
        x, block, link = stack.pop()
        if x.aside or x.weak or x.tag in RAW:
            continue
        link = link or x.tag == "a"
        block = x if block is None or x.tag in BLOCKS else block
        order.append((x, block, link))
        stack += [(c, block, link) for c in x.children if not isinstance(c, str)]
    prose: dict[int, int] = {}
    for x, block, link in order:
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        x.volume = own
        if not link:
            prose[id(block)] = prose.get(id(block), 0) + own
    for x, block, _ in reversed(order):  # children come behind their parents
        if x is block:
            x.volume += PROSE_WEIGHT * max(0, prose.get(id(x), 0) - PROSE_FROM)
        x.volume += sum(c.volume for c in x.children if not isinstance(c, str))


def parse(page: str) -> tuple[Node, int]:
    """The tree of a page and its number of nodes. Tags may be missing or cut off; comments and raw elements leave no text."""
    root = Node("#root")
    stack, count, at = [root], 1, 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(html_lib.unescape(text))
            continue
        if not m[4]:  # cut off inside a tag
            break
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            else:
                if tag in BLOCKS and len(stack) >= MAX_DEPTH:  # an element that has no level of its own ends here
                    stack[-1].children.append(Node(tag))
            continue
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    del stack[k:]
                    break
                if stack[k].tag in barrier or stack[k].tag in BLOCKS:
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        stack[-1].leaf = False
        count += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root, count


def elements(node: Node) -> list[Node]:
    return [] if node.leaf else [c for c in node.children if not isinstance(c, str)]


def _runs(nodes: list, template: set[tuple[str, str]]) -> list[tuple[tuple[str, str | None], list]]:
    """Neighbouring leaves with one label as one run; any other node is a run of its own. What has a text of ``template`` is keyed by it, too."""
    out: list[tuple[tuple[str, str | None], list]] = []
    labels, last = {label for label, _ in template}, None
    for x in nodes:
        if x.label in labels and (own := (x.label, x.template_text())) in template:
            last = None
            out.append((own, [x]))
        elif x.leaf and last == x.label:
            out[-1][1].append(x)
        else:
            last = x.label if x.leaf else None
            out.append(((x.label, None), [x]))
    return out


class Wrapper:
    """A node of the aligned tree of a host's pages: how many pages have it, its text if that never varies, its children."""

    __slots__ = ("label", "pages", "text", "volume", "main", "children", "slot")

    def __init__(self, label: str, pages: int = 0, text: str | None = None, volume: int = 0, main: bool = False, children: list | None = None, slot: bool = False):
        self.label, self.pages, self.text, self.volume, self.main, self.children, self.slot = label, pages, text, volume, main, children or [], slot

    @property
    def leaf(self) -> bool:
        return not self.children and not self.constant

    @property
    def constant(self) -> bool:
        """True for template: a text that all of enough pages share."""
        return bool(self.text) and self.pages >= LEAST_EQUAL and not self.slot

    def template_text(self) -> str | None:
        """The text that a page's node must have to be aligned with this one; None if any will do."""
        return self.text if self.constant and not self.children else None

    def pruned(self) -> Wrapper | None:
        """What extraction needs of the tree: the way to the main slot, and template; None if there is neither."""
        if self.constant:
            return Wrapper(self.label, self.pages, self.text)
        found = [x.pruned() for x in self.children]
        if not self.slot and all(c is None for c in found):
            return None
        # what could be taken for the way to the slot stays beside it, and what tells the slot from that
        ways = {c.label for c in found if c is not None and not c.text}
        like = lambda x: 2 * x.pages >= self.pages and (self.slot or x.label in ways)
        children = [c or x.bare(1 if self.slot else 2) for x, c in zip(self.children, found, strict=True) if c is not None or like(x)]
        return Wrapper(self.label, self.pages, slot=self.slot, children=children)

    def bare(self, levels: int) -> Wrapper:
        """The shape alone, of what most pages have."""
        return Wrapper(self.label, self.pages, children=[c.bare(levels - 1) for c in self.children if levels and 2 * c.pages >= self.pages])

    def to_list(self) -> list:
        return [self.label, self.pages, self.text, self.slot, [c.to_list() for c in self.children]]

    @classmethod
    def from_list(cls, x: list) -> Wrapper:
        return cls(x[0], x[1], x[2], slot=x[3], children=[cls.from_list(c) for c in x[4]])


def _weight(w: Wrapper, n: Node) -> int:
    """Simple tree matching: the size of the largest match that keeps roots, levels and order."""
    if w.label != n.label:
        return 0
    if w.constant and not w.children:
        return 2 if n.text() == w.text else 0
    own = elements(n)
    if not own or not w.children:
        return 1
    return 1 + _table(w, own)[0][-1][-1]


def _band(n: int, m: int) -> list[tuple[int, int]]:
    """For each row of a table of n and m runs, the first and the last column that is looked at; neighbouring rows overlap."""
    half = m if n * m <= FULL_PAIRS else max(m // n + 2, min(BAND, BAND_PAIRS // (2 * n)))
    return [(max(0, i * m // n - half), min(m, i * m // n + half)) for i in range(n + 1)]


def _table(w: Wrapper, own: list[Node]):
    """Best total weights of aligning a wrapper node's children with a page node's, by runs; and the weights of run pairs.

    Template meets nothing but its own text, in runs as well.
    """
    template = {(c.label, text) for c in w.children if (text := c.template_text()) is not None}
    left, right = _runs(w.children, template), _runs(own, template)
    band = _band(len(left), len(right))
    best, pair = [[0] * (band[0][1] + 1)], []
    for i, (a, xs) in enumerate(left):
        above, (low, high), (first, last) = best[i], band[i], band[i + 1]
        here, weights, before = [], [], -1
        for j in range(first, last + 1):
            most, weight = max(before, above[j - low] if low <= j <= high else -1), 0
            if j and low < j <= high + 1 and a == right[j - 1][0]:
                ys = right[j - 1][1]
                weight = min(len(xs), len(ys)) if len(xs) > 1 or len(ys) > 1 else 2 if a[1] is not None else _weight(xs[0], ys[0])
                most = max(most, above[j - 1 - low] + weight)
            here.append(most)
            weights.append(weight)
            before = most
        best.append(here)
        pair.append(weights)
    return best, pair, left, right, band


def _aligned(w: Wrapper, own: list[Node]) -> list[tuple[Wrapper | None, Node | None]]:
    """The children of both in order, matched ones together."""
    if not w.children or not own:
        return [(x, None) for x in w.children] + [(None, y) for y in own]
    best, pair, left, right, band = _table(w, own)
    at = lambda i, j: best[i][j - band[i][0]] if band[i][0] <= j <= band[i][1] else -1
    i, j, out = len(left), len(right), []
    while i or j:
        weight = pair[i - 1][j - band[i][0]] if i and j else 0
        if weight and at(i, j) == at(i - 1, j - 1) + weight:
            i, j = i - 1, j - 1
            xs, ys = left[i][1], right[j][1]
            n = min(len(xs), len(ys))
            out += [(None, y) for y in reversed(ys[n:])] + [(x, None) for x in reversed(xs[n:])] + list(zip(reversed(xs[:n]), reversed(ys[:n]), strict=True))
        elif j and (not i or at(i, j) == at(i, j - 1)):
            j -= 1
            out += [(None, y) for y in reversed(right[j][1])]
        else:
            i -= 1
            out += [(x, None) for x in reversed(left[i][1])]
    return out[::-1]


def _learn(w: Wrapper, n: Node) -> None:
    """Takes one page into the tree."""
    text = n.text()
    w.text = text if w.pages == 0 or w.text == text else None
    w.pages += 1
    w.main |= n.main
    w.volume += n.volume
    if not n.aside and not n.weak and n.tag not in RAW:
        merged = []
        for x, y in _aligned(w, elements(n)):
            if y is not None:
                if x is None:
                    x = Wrapper(y.label)
                _learn(x, y)
            merged.append(x)
        w.children = merged


def induce(pages: list[str]) -> Wrapper:
    """The wrapper of one host's pages. Of equal pages one counts."""
    root = Wrapper("#root")
    for page in sorted(set(pages)):
        tree, _ = parse(page)
        weigh(tree)
        _learn(root, tree)
    # the main slot: an element that says so, else the deepest that holds nearly all text, prose above all
    best, stack = None, [(root, 0)]
    while stack:
        w, depth = stack.pop()
        if w.main and 2 * w.pages >= root.pages and (best is None or w.volume > best.volume):
            best = w
        stack += [(c, depth + 1) for c in w.children]
    if best is None:
        best = root
        while (inner := max(best.children, key=lambda c: c.volume, default=None)) and inner.children and inner.volume >= 0.8 * best.volume and 2 * inner.pages >= root.pages:
            best = inner
    best.slot = True
    # where the main slot hardly varies, as the pages share their article, being equal tells no template in it
    inside, equal, stack = [], 0, list(best.children)
    while stack:
        w = stack.pop()
        inside.append(w)
        if w.constant:
            equal += w.volume
        else:
            stack += w.children
    if 2 * equal >= best.volume:
        for w in inside:
            w.text = None
    # template are only whole blocks of the slot that nearly all pages have; what some share is their own, and so are headings
    # and pieces of blocks that vary
    stack = [(w, True) for w in best.children]
    while stack:
        w, whole = stack.pop()
        if w.constant and (not whole or w.pages < NEARLY_ALL * best.pages or w.label.split(".")[0] in HEADINGS):
            w.text = None
        if not w.constant:
            stack += [(c, whole and w.volume >= 0.8 * best.volume) for c in w.children]
    return root.pruned() or Wrapper(root.label, slot=best is root)


def _match(w: Wrapper, n: Node, found: dict[int, Wrapper]) -> bool:
    """Notes the wrapper's node for every node of a page that is aligned with one; true if the main slot is among them."""
    found[id(n)] = w
    if n.aside or n.weak and not w.slot:
        return False
    slot = w.slot
    if w.children and (own := elements(n)):
        for x, y in _aligned(w, own):
            if x is not None and y is not None:
                slot |= _match(x, y, found)
    return slot


def _collect(node: Node, found: dict[int, Wrapper], inside: bool, blocks: list[list[str]], weak: bool = True) -> None:
    """Adds the text of what isn't template or aside; ``weak`` says whether weak words count."""
    if node.aside or node.tag in RAW or weak and node.weak:
        return
    w = found.get(id(node))
    if w is not None:
        if inside and w.constant and node.text() == w.text:
            return  # the same on all pages
        inside, weak = inside or w.slot, weak and not w.slot
    block = node.tag in BLOCKS
    if block:
        blocks.append([])
    for c in node.children:
        if isinstance(c, str):
            if inside:
                blocks[-1].append(c)
        elif c.tag == "br":
            blocks[-1].append(" ")
        else:
            _collect(c, found, inside, blocks, weak)
    if block:
        blocks.append([])


def _mains(node: Node) -> list[Node]:
    """Outermost elements that call themselves main text, articles first."""
    found, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.aside or n.weak:
            continue
        if n.main:
            found.append(n)
        else:
            stack += reversed(elements(n))
    return found


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page: blocks in page order, a line each. Empty for null, and for a page without main text."""
    tree, _ = parse(page or "")
    blocks: list[list[str]] = [[]]
    found: dict[int, Wrapper] = {}
    if wrapper is not None and _match(wrapper, tree, found):
        _collect(tree, found, False, blocks)
    else:  # unlike its host's other pages
        mains = _mains(tree)
        for n in mains or [tree]:
            blocks.append([])
            _collect(n, {}, True, blocks, weak=not mains)
    return "\n".join(line for b in blocks if (line := " ".join("".join(b).split())))


def host(url: Column) -> Column:
    """The host of a URL in lower case, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induced(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages_each: int = PAGES_PER_HOST, seed: int = 9) -> DataFrame:
    """A wrapper for every host, as JSON: columns host and wrapper. About ``pages_each`` pages of a host are drawn by a seed."""
    light = pages.select(host(F.col(url_col)).alias("host"))
    share = light.groupBy("host").agg((F.lit(2.0 * pages_each) / F.count(F.lit(1))).alias("share")).withColumnRenamed("host", "h")
    share = checkpointed(share)
    share = F.broadcast(share) if share.count() <= MAX_SENT_HOSTS else share
    # two draws: first about twice as many as needed by chance, then the smallest of them
    rows = pages.select(host(F.col(url_col)).alias("host"), draw(seed, F.col(id_col), F.col(url_col)).alias("u"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.join(share, F.col("host") == F.col("h")).filter(F.col("u") < F.col("share")).select("host", "u", "html")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = induce(pdf.sort_values(["u", "html"])["html"].head(pages_each).tolist())
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(tree.to_list(), ensure_ascii=False)]})

    return rows.groupBy("host").applyInPandas(run, "host string, wrapper string")


def main_text(pages: DataFrame, keys: list[str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``keys`` of each page and its main text in ``out_col``.

    Null or empty html gives an empty text; a null URL belongs to the host
    without a name. Pages that repeat are extracted alike; long and deeply
    nested ones are read as a whole. Of equally good alignments the last in
    page order counts. An empty table gives
    an empty table.
    """
    wrappers = checkpointed(induced(pages, id_col, url_col, html_col))
    total = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    rows = pages.select(*keys, host(F.col(url_col)).alias("__host"), F.col(html_col).alias("__html"))
    fields = [f for f in rows.schema.fields if f.name not in ("__host", "__html")]
    shared = None
    if total <= MAX_SENT_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.toLocalIterator()})
        rows = rows.select("*", F.lit(None).cast("string").alias("__wrapper"))
    else:
        rows = rows.join(wrappers.select(F.col("host").alias("__h"), F.col("wrapper").alias("__wrapper")), F.col("__host") == F.col("__h"), "left").drop("__h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for b in batches:
            hosts, pages_, own = (b.column(b.num_columns - k).to_pylist() for k in (3, 2, 1))
            out = []
            for h, page, w in zip(hosts, pages_, own, strict=True):
                if h not in known:
                    if len(known) > 10_000:
                        known.clear()
                    w = shared.value.get(h) if shared is not None else w
                    known[h] = Wrapper.from_list(json.loads(w)) if w else None
                out.append(extract(page, known[h]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(out, pa.string())], names=[*(f.name for f in fields), out_col])

    return in_batches(rows).mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.StringType())]))
