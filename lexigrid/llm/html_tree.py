"""Main text of web pages by a graphical model over the DOM tree.

Every node is content or not.  Parent-child potentials connect the nodes, so that what surrounds a node speaks for it;
sums of products pass from the leaves to the root and back and give each node's marginal.  The potentials are counts
from labelled pages: pages whose ``article`` or ``main`` elements tell what their article is.  A node's tag is one
observation, every whole name in its class, id, role and itemprop another; how long and how linked its text is, and
which part of the page's text it holds, are more.  Each is bounded, so that no single one decides, and so is what the
children of a node tell it together, since they depend on each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import short_batches

MAX_LABELLED = 2_000     # labelled pages that the potentials are counted on, in the order of a hash of their key
_HTML = "html"
# Fixed: element classes of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style title textarea template noscript iframe object svg math canvas audio video head".split())
RAW = set("script style title textarea noscript iframe xmp".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
             "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
             "tfoot th thead tr ul".split())
CLOSED_BY_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
                  "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
ARTICLE_TAGS = {"article", "main"}
AROUND_TAGS = set("nav header footer aside form menu dialog button select option fieldset legend input optgroup datalist".split())
# What a class, id, role or itemprop made of these words alone says before any page is seen: around the article or it
AROUND = set("nav navigation navbar menu menubar header masthead topbar footer copyright colophon aside sidebar complementary ad ads advert "
             "adverts advertisement advertising advertorial sponsor sponsored promo promotion banner contentinfo cookie cookies consent gdpr "
             "notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login comment comments disqus reply "
             "replies respond discussion form search share sharing social related recommended recommendations teaser breadcrumb breadcrumbs "
             "pagination pager widget toolbar button paywall tooltip".split())
INSIDE = set("article main content post entry story body articlebody maincontent".split())
# words that say where or how large a box is, not what it holds; with these beside it a word keeps its meaning
PLACING = set("site page top bottom left right main global primary secondary box block list section wrapper container area slot bar unit panel "
              "inner outer group holder links items item posts articles stories row col column thread text title js wp the".split())
NEGATED = set("no not without hide open closed has is with enabled disabled allow skip".split())
# in a name of both kinds these decide
RULING = set("comment comments reply replies related sidebar nav navigation footer newsletter advert advertisement cookie".split())
KINDS = ["root", "around", "article", "heading", "paragraph", "list", "table", "link", "inline", "block", "text"]
SHARED = [KINDS.index(k) for k in ("article", "block")]   # kinds that are asked for their part of the page's text
TEXT_BINS = [25, 80, 200, 600]   # characters of a text node's block
SHARE_BINS = [0.05, 0.2, 0.5]    # of the page's text outside links and marked surroundings
FEATURES = [*(f"kind:{k}" for k in KINDS), *(f"length:{k}" for k in range(len(TEXT_BINS) + 1)), "linked:0", "linked:1",
            *(f"share:{k}" for k in range(len(SHARE_BINS) + 1)), "holds:article", "nested:article"]
# to a node marked as the article; from a marked surrounding; from elsewhere to a marked surrounding; to a box; any other
EDGES = ["opening", "enclosed", "leaving", "box", "other"]
# observations that count before any page is seen: (content, not content)
PRIOR_SEEN = {"kind:root": (0.0, 50.0), "kind:around": (0.0, 1e8), "kind:article": (2000.0, 0.0), "share:3": (20.0, 4.0), "share:0": (2.0, 4.0),
              "holds:article": (0.0, 2000.0), "nested:article": (0.0, 200.0), "length:0": (2.0, 8.0), "length:1": (8.0, 4.0),
              "length:2": (16.0, 4.0), "length:3": (20.0, 4.0), "length:4": (20.0, 4.0), "linked:0": (10.0, 5.0), "linked:1": (2.0, 16.0)}
SMOOTH = 4.0
# log-odds that an observation may give at most; two unless said here, and half for tags that serve all purposes
MOST = {"kind:around": 14.0, "kind:article": 6.0, "holds:article": 6.0, "nested:article": 4.0, "length:0": 1.0,
        **{f"kind:{k}": 0.5 for k in ("heading", "paragraph", "list", "table", "link", "inline", "block")}}
MOST_ELSE = 2.0
MOST_NAMED = 14.0        # all names of a node together
PRIOR_NAMED = {"around": -14.0, "inside": 4.0, "hint": -1.0}
SMOOTH_NAMED = 0.5       # pages that a name counts as on either side beside those it was seen on
MARKED = (-4.0, 2.0)     # log-odds of its names up from which a node counts as a marked surrounding, or an article
MOST_NAMES = 20_000      # names that are learned: those on most of the labelled pages
MOST_BELOW = 4.0         # log-odds that all children of a node give it together
MOST_MOVES = 100.0       # labelled pages share templates, so their steps count as no more than so many
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z|</[^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNSHOWN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
HIDDEN = "hidden attribute"


@dataclass
class Tree:
    """Nodes in page order; a node's parent comes before it."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    texts: dict[int, str] = field(default_factory=dict)    # of text nodes
    block: dict[int, int] = field(default_factory=dict)    # the run of inline text that a text node stands in
    linked: set[int] = field(default_factory=set)

    def add(self, parent: int, kind: int, names: tuple[str, ...] = ()) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.names.append(names)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return len(self.parent) - 1


def kind_of(tag: str) -> int:
    """What the tag of an element says about it."""
    if tag in AROUND_TAGS:
        return KINDS.index("around")
    if tag in ARTICLE_TAGS:
        return KINDS.index("article")
    if re.fullmatch("h[1-6]", tag):
        return KINDS.index("heading")
    if tag in ("p", "blockquote", "pre"):
        return KINDS.index("paragraph")
    if tag in ("ul", "ol", "li", "dl", "dt", "dd"):
        return KINDS.index("list")
    if tag in ("table", "tbody", "thead", "tr", "td", "th"):
        return KINDS.index("table")
    return KINDS.index("link" if tag == "a" else "block" if tag in BLOCKS else "inline")


def names_of(attributes: str) -> tuple[str, ...]:
    """Whole names in class, id, role and itemprop; a name of its own for elements that aren't shown."""
    if not attributes:
        return ()
    names = {n for value in _NAMED.findall(attributes) for n in value.strip("\"'").split()}
    style = re.search(r"style\s*=\s*(\"[^\"]*\"|'[^']*')", attributes, re.I)
    if _UNSHOWN.search(_QUOTED.sub('""', attributes)) or re.search("aria-hidden\\s*=\\s*[\"']?true", attributes, re.I) \
            or (style and re.search("display\\s*:\\s*none", style[1], re.I)):
        names.add(HIDDEN)
    return tuple(sorted(names))


_priors: dict[str, float] = {}


def prior_of(name: str) -> float:
    """Log-odds of a name before any page is seen, by the words it is made of."""
    if name not in _priors:
        if len(_priors) > 20_000:
            _priors.clear()
        _priors[name] = _prior_of(name)
    return _priors[name]


def _prior_of(name: str) -> float:
    if name == HIDDEN:
        return PRIOR_NAMED["around"]
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or NEGATED & set(words):
        return 0.0
    telling = [w for w in words if w not in PLACING] or words
    around, inside = [w for w in telling if w in AROUND], [w for w in telling if w in INSIDE]
    if around and (len(around) == len(telling) or (telling[-1] in RULING and len(around) + len(inside) == len(telling))):
        return PRIOR_NAMED["around"]
    if inside and len(inside) == len(telling):
        return PRIOR_NAMED["inside"]
    return PRIOR_NAMED["hint"] if around else 0.0


def parse(html: str, seen: dict[tuple[str, str], tuple[int, tuple[str, ...]]] | None = None) -> Tree:
    """Tree of the visible elements and texts of a page, however broken its markup is."""
    seen = {} if seen is None else seen
    tree = Tree()
    stack = [(_HTML, tree.add(-1, KINDS.index("root")))]
    block, at, unseen = 0, 0, 0

    def text(raw: str) -> None:
        if unseen or not raw or raw.isspace():
            if raw and not unseen and tree.texts and next(reversed(tree.block.values())) == block:
                tree.texts[next(reversed(tree.texts))] += " "
            return
        node = tree.add(stack[-1][1], KINDS.index("text"))
        tree.texts[node] = unescape(raw) if "&" in raw else raw
        tree.block[node] = block
        if any(t == "a" for t, _ in stack):
            tree.linked.add(node)

    def close(until: int) -> None:
        nonlocal block, unseen
        while len(stack) > until:
            tag, _ = stack.pop()
            unseen -= tag in UNSEEN
            block += tag in BLOCKS

    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        shut, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in ("html", "body"):
            continue  # the root stands for both
        if tag in BLOCKS:
            block += 1
            for k in range(len(stack) - 1, 0, -1):  # a new block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag in CLOSED_BY_SELF:
            alike = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSED_BY_SELF[tag]:
                    break
                if stack[k][0] in alike:
                    close(k)
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                at = stop.start() if stop else end
            stack.append((tag, stack[-1][1]))
            unseen += tag in UNSEEN
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        if (tag, attributes) not in seen:
            if len(seen) > 20_000:
                seen.clear()
            seen[tag, attributes] = kind_of(tag), names_of(attributes)
        unseen += tag in UNSEEN
        stack.append((tag, stack[-1][1] if unseen else tree.add(stack[-1][1], *seen[tag, attributes])))
    return tree


def observe(tree: Tree) -> np.ndarray:
    """Per node the places of its features: kind, length, links, part of the page's text, and how articles nest (-1: none)."""
    n = len(tree.parent)
    out = np.full((n, 5), -1, np.int64)
    out[:, 0] = tree.kind
    sizes: dict[int, int] = {}
    mass = [0] * n
    for node, b in tree.block.items():
        sizes[b] = sizes.get(b, 0) + len(tree.texts[node])
        mass[node] = 0 if node in tree.linked else len(tree.texts[node])
    base = len(KINDS)
    for node, b in tree.block.items():
        out[node, 1] = base + int(np.searchsorted(TEXT_BINS, sizes[b], "right"))
        out[node, 2] = base + len(TEXT_BINS) + 1 + (node in tree.linked)
    article, around = KINDS.index("article"), KINDS.index("around")
    for node, (parent, kind) in enumerate(zip(tree.parent, tree.kind)):
        barred = kind == around or any(prior_of(name) <= MARKED[0] for name in tree.names[node])
        if barred or (parent >= 0 and mass[parent] < 0):
            mass[node] = -1              # for now: what is below a marked surrounding
    mass = [max(0, m) for m in mass]
    holds = [k == article for k in tree.kind]
    for node in range(n - 1, 0, -1):     # children come after their parent
        mass[tree.parent[node]] += mass[node]
        holds[tree.parent[node]] |= holds[node]
    below = [False] * n                  # an article further up
    whole = max(1, mass[0])
    shares = base + len(TEXT_BINS) + 3
    for node in range(1, n):
        parent = tree.parent[node]
        below[node] = below[parent] or tree.kind[parent] == article
        if tree.kind[node] in SHARED:
            out[node, 3] = shares + int(np.searchsorted(SHARE_BINS, mass[node] / whole, "right"))
        if tree.kind[node] == article:
            out[node, 4] = len(FEATURES) - 1 if below[node] else -1
        elif holds[node] and not below[node]:
            out[node, 4] = len(FEATURES) - 2
    return out


def labels_of(tree: Tree) -> np.ndarray | None:
    """1 for nodes of the article, 0 for others, -1 where neither is sure; None for pages that don't mark their article.

    Only elements decide: the outermost ``article`` or ``main`` without another inside, but for surroundings by tag.
    Parts of it whose names are those of surroundings are not sure, nor are the elements that hold the article.
    """
    article, around = KINDS.index("article"), KINDS.index("around")
    out = np.zeros(len(tree.parent), np.int64)
    places = observe(tree)[:, 4]
    holding = len(FEATURES) - 2
    outer = [k == article and p != len(FEATURES) - 1 for k, p in zip(tree.kind, places)]
    for node in range(len(outer) - 1, 0, -1):   # a main around articles holds them, and isn't one
        up = tree.parent[node]
        while tree.kind[node] == article and up > 0:
            if outer[up]:
                outer[up], outer[node] = False, True
            up = tree.parent[up]
    for node, (parent, kind) in enumerate(zip(tree.parent, tree.kind)):
        above = out[parent] if parent >= 0 else 0
        if outer[node]:
            out[node] = 1
        elif above == 1:
            named = min((prior_of(n) for n in tree.names[node]), default=0.0) <= MARKED[0]
            out[node] = 0 if kind == around else -1 if named else 1
        elif above == -1 and parent >= 0 and places[parent] != holding:
            out[node] = -1
        elif places[node] == holding and kind != KINDS.index("root"):
            out[node] = -1
    return out if (out == 1).any() else None


@dataclass
class Potentials:
    """Log-odds of the features and of names, and log P(child | parent) as [edge, parent state, child state]."""

    odds: np.ndarray
    edges: np.ndarray
    names: dict[str, float] = field(default_factory=dict)

    @classmethod
    def from_counts(cls, seen: np.ndarray, moves: np.ndarray, names: dict[str, tuple[float, float]] | None = None) -> Potentials:
        """``seen``: [feature, (not content, content)]; ``moves``: [edge, parent state, child state]; ``names``: pages
        that have the name (outside, in) the article.
        """
        seen = seen.copy()
        kinds = seen[: len(KINDS)].sum(axis=0) + 1
        base = kinds[1] / kinds.sum()
        for name, (yes, no) in PRIOR_SEEN.items():
            seen[FEATURES.index(name)] += (no, yes)
        total = seen.sum(axis=1) + SMOOTH
        odds = (np.log((seen[:, 1] + SMOOTH * base) / total) - np.log((seen[:, 0] + SMOOTH * (1 - base)) / total)
                - np.log(base / (1 - base)))
        most = np.array([MOST.get(name, MOST_ELSE) for name in FEATURES])
        prior = np.array([[[20.0, 80.0], [1.0, 99.0]], [[100.0, 1e-4], [1.0, 99.0]], [[100.0, 1.0], [50.0, 50.0]],
                          [[98.0, 2.0], [0.5, 99.5]], [[99.9, 0.1], [0.5, 99.5]]])  # [edge, parent state, child state]
        moves = moves * np.minimum(1, MOST_MOVES / np.maximum(moves.sum(axis=2, keepdims=True), 1)) + prior
        # labelled pages all mark their article, so they can't tell how often one starts unmarked
        for name in ("enclosed", "box", "other"):
            moves[EDGES.index(name), 0] = prior[EDGES.index(name), 0]
        learned = {n: float(np.clip(prior_of(n) + np.log((yes + SMOOTH_NAMED) / (no + SMOOTH_NAMED)), -MOST_NAMED, MOST_NAMED))
                   for n, (no, yes) in (names or {}).items()}
        return cls(np.clip(odds, -most, most), np.log(moves / moves.sum(axis=2, keepdims=True)), learned)

    def named(self, names: tuple[str, ...]) -> float:
        """Log-odds of all names of a node."""
        total = sum(self.names[n] if n in self.names else prior_of(n) for n in names)
        return float(np.clip(total, -MOST_NAMED, MOST_NAMED))


def edges_of(parent: np.ndarray, kind: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Which table of EDGES joins each node to its parent."""
    around = (kind == KINDS.index("around")) | (named <= MARKED[0])
    opening = (kind == KINDS.index("article")) | (named >= MARKED[1])
    return np.select([around[parent], around, opening, kind == KINDS.index("block")],
                     [EDGES.index(name) for name in ("enclosed", "leaving", "opening", "box")], EDGES.index("other"))


def marginals(parent: np.ndarray, depth: np.ndarray, seen: np.ndarray, named: np.ndarray, potentials: Potentials) -> np.ndarray:
    """P(content) of every node of a forest by one pass of messages up and one down.

    Children of a node whose messages together exceed MOST_BELOW are tempered to it.
    """
    own = np.where(seen >= 0, potentials.odds[seen], 0.0).sum(axis=1) + named
    belief = np.stack([np.zeros(len(own)), own], axis=1)          # own evidence plus messages from below
    tables = potentials.edges[edges_of(np.maximum(parent, 0), seen[:, 0], named)]   # [node, parent state, own state]
    up = np.zeros_like(belief)
    levels = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[levels], np.arange(depth.max() + 2)) if len(depth) else [0]
    told = np.zeros(len(own))
    for d in range(len(bounds) - 2, 0, -1):
        nodes = levels[bounds[d] : bounds[d + 1]]
        up[nodes] = np.logaddexp(tables[nodes, :, 0] + belief[nodes, None, 0], tables[nodes, :, 1] + belief[nodes, None, 1])
        np.add.at(told, parent[nodes], up[nodes, 1] - up[nodes, 0])
        up[nodes] *= np.minimum(1, MOST_BELOW / np.maximum(np.abs(told[parent[nodes]]), 1e-9))[:, None]
        np.add.at(belief, parent[nodes], up[nodes])
    for d in range(1, len(bounds) - 1):
        nodes = levels[bounds[d] : bounds[d + 1]]
        above = belief[parent[nodes]] - up[nodes]                 # what the parent knows without this child
        belief[nodes] += np.logaddexp(tables[nodes, 0, :] + above[:, None, 0], tables[nodes, 1, :] + above[:, None, 1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def main_text(tree: Tree, content: np.ndarray) -> str:
    """Texts of the content nodes; white space inside a block becomes one space, blocks are joined by one."""
    blocks: dict[int, list[str]] = {}
    for node, body in tree.texts.items():
        if content[node]:
            blocks.setdefault(tree.block[node], []).append(body)
    return " ".join(" ".join(joined) for parts in blocks.values() if (joined := "".join(parts).split()))


def extract_all(pages: list[str | None], potentials: Potentials) -> list[str]:
    """Main texts of a batch of pages; the messages of all its trees are passed level by level together."""
    marks: dict[tuple[str, str], tuple[int, tuple[str, ...]]] = {}
    trees = [parse(p or "", marks) for p in pages]
    if not trees:
        return []
    starts = np.cumsum([0, *(len(t.parent) for t in trees)])
    parent = np.concatenate([np.array(t.parent, np.int64) + s for t, s in zip(trees, starts)])  # of a root: not used
    odds: dict[tuple[str, ...], float] = {}
    named = np.array([odds[n] if n in odds else odds.setdefault(n, potentials.named(n)) for t in trees for n in t.names])
    p = marginals(parent, np.concatenate([np.array(t.depth) for t in trees]), np.concatenate([observe(t) for t in trees]), named, potentials)
    return [main_text(t, p[a:b] >= 0.5) for t, a, b in zip(trees, starts, starts[1:])]


def train(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = MAX_LABELLED) -> Potentials:
    """Potentials counted on pages that mark their article; ``most`` of them, in the order of a hash of their key."""
    marked = pages.where(F.col(html).rlike("(?i)<(?:article|main)[\\s>]")).select(F.col(key).alias("k"), F.col(html).alias("h"))
    chosen = marked.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(most)

    shape = {"f": (len(FEATURES), 2), "e": (len(EDGES), 2, 2)}

    def count(batches):
        seen, moves, names = np.zeros(shape["f"]), np.zeros(shape["e"]), {}
        for batch in batches:
            for page in batch.column(0):
                tree = parse(page.as_py() or "")
                labels = labels_of(tree)
                if labels is None:
                    continue
                places, sure = observe(tree), labels >= 0
                for column in places.T:
                    at = sure & (column >= 0)
                    np.add.at(seen, (column[at], labels[at]), 1)
                parent = np.maximum(np.array(tree.parent), 0)
                named = np.array([min(map(prior_of, n), default=0.0) for n in tree.names])
                edge = edges_of(parent, places[:, 0], named)
                both = (sure & sure[parent])[1:]
                np.add.at(moves, (edge[1:][both], labels[parent[1:]][both], labels[1:][both]), 1)
                for name, state in {(n, int(labels[k])) for k, own in enumerate(tree.names) if sure[k] for n in own}:
                    names.setdefault(name, [0.0, 0.0])[state] += 1
        rows = [("f", str(k), *x) for k, x in enumerate(seen.tolist())] + [("e", str(k), *x) for k, x in enumerate(moves.reshape(-1, 2).tolist())]
        rows += [("n", name, *x) for name, x in names.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["what", "name", "no", "yes"])

    counts = (marked.join(F.broadcast(chosen), "k", "left_semi").select("h")  # ``most`` keys
              .mapInArrow(count, "what string, name string, no double, yes double").groupBy("what", "name").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")))
    # a fixed few dozen, and the names that most of the labelled pages have
    found = counts.orderBy(F.col("what") == "n", F.desc(F.col("no") + F.col("yes")), "name").limit(len(FEATURES) + len(EDGES) * 2 + MOST_NAMES).collect()
    flat = {"f": np.zeros((len(FEATURES), 2)), "e": np.zeros((len(EDGES) * 2, 2))}
    for r in found:
        if r["what"] != "n":
            flat[r["what"]][int(r["name"])] = r["no"], r["yes"]
    return Potentials.from_counts(flat["f"], flat["e"].reshape(shape["e"]), {r["name"]: (r["no"], r["yes"]) for r in found if r["what"] == "n"})


def extractor(potentials: Potentials):
    """A column function from HTML to main text."""
    step = 64  # trees held at once

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        out: list[str] = []
        for k in range(0, len(pages), step):
            out += extract_all(pages.slice(k, step).to_pylist(), potentials)
        return pa.array(out, pa.string())

    return extracted


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", potentials: Potentials | None = None) -> DataFrame:
    """key, url, text and n_chars (code points) of every page.

    Null and empty pages, and pages without an article, give an empty text.  Repeated rows give their text again; an
    empty table gives no rows; without labelled pages the prior observations alone decide.  Other columns are not read.
    """
    short_batches(pages)
    text: Column = extractor(potentials or train(pages, key, html))(F.col(html))
    out = pages.select(F.col(key).alias(key), F.col(url).alias(url), text.alias("text"))
    return out.select(key, url, "text", F.length("text").cast("long").alias("n_chars"))
