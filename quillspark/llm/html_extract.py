"""Main text of web pages by a tree-structured graphical model.

A page's elements form a tree of nodes that are content or not. Each node has a potential from its tag, its class and id
words, its text and its links, and each parent and child share one. Sum-product messages pass once upward and once
downward, which gives every node's exact marginal; blocks of nodes with a marginal of at least one half are kept in page
order. Potentials are counted on labelled pages (html_pages). The model is a few hundred numbers and travels with the
tasks; pages are extracted one by one where they lie, with no shuffle.

Edge cases: null, empty and text-free html give an empty text. Text outside all tags is a block of the body, the root of
the tree; a page without any structure (a plain text, paragraphs or bare divs alone) keeps its text. Unclosed elements
end with their parent; scripts, styles, the head and comments never give text. Repeated rows give equal rows. Nesting
may be of any depth, and work grows in proportion to the page: every open element knows what an end tag or a new block
would close. Other columns pass through the query's operator untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .html_pages import labelled_pages

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation".split())
SILENT = set("head script style noscript template svg iframe object title select option textarea button canvas audio video".split())
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: what a start tag ends: the innermost open element of these groups, unless one of the group's scope is further in
GROUPS = {"p": "p", "li": "li", "dt": "term", "dd": "term", "td": "cell", "th": "cell", "tr": "row", "option": "option"}
ENDS_SAME = {"li": ["li"], "dt": ["term"], "dd": ["term"], "td": ["cell"], "th": ["cell"], "tr": ["row", "cell"], "option": ["option"]}
P_SCOPE = set("ul ol dl table body html article div section td th".split())
LIST_SCOPE = set("ul ol dl table select".split())

#: elements by which a page tells its parts apart; one without these and without names is bare
PARTS = set("nav header footer aside form article main section menu dialog".split())

#: elements that hold text and, unless they have names, mostly go with their parent
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead pre blockquote ul ol dl table figure figcaption".split())

NAME = re.compile(r"[A-Z]?[a-z]+")


class Tree(HTMLParser):
    """Nodes in page order (a parent before its children) and pieces of text with their node and block."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.names, self.parents, self.gold = ["body"], [[]], [-1], ["0"]
        # (tag, node, nearest open element of each group in scope); an inline element without names shares its parent's node
        self.open: list[tuple[str, int, dict[str, int]]] = [("body", 0, {})]
        self.places: dict[str, list[int]] = {}  # where the elements of each tag stand in self.open
        self.blocks = [0]  # and those that aren't inline
        self.silent = self.links = self.block = 0
        self.bare = True
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag in VOID:
            if tag not in INLINE and tag != "br":
                self.block += 1
            elif tag == "br":
                self.handle_data("\n")
            return
        given = dict(attrs)
        if tag in ("html", "body"):
            self.gold[0] = given.get("data-y") or self.gold[0]
            return
        if tag in ENDS_P:
            self._end(["p"])
        self._end(ENDS_SAME.get(tag, []))
        node, near = self.open[-1][1:]
        names = [w.lower() for k in ("class", "id", "role") for w in NAME.findall(given.get(k) or "")]
        if "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", ""):
            names.append("hidden")
        if tag not in INLINE or names:
            self.tags.append(tag)
            self.names.append(names)
            self.parents.append(node)
            self.gold.append(given.get("data-y") or self.gold[node])
            node = len(self.tags) - 1
            self.bare = self.bare and not names and tag not in PARTS
        if tag in P_SCOPE or tag in LIST_SCOPE or tag in GROUPS:
            near = {k: v for k, v in near.items() if not (tag in P_SCOPE if k == "p" else tag in LIST_SCOPE)}
            if tag in GROUPS:
                near[GROUPS[tag]] = len(self.open)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, node, near))
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.block += tag not in INLINE

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _pop(self, to: int) -> None:
        for tag, _, _ in reversed(self.open[to:]):
            self.places[tag].pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            if tag not in INLINE:
                self.blocks.pop()
                self.block += 1
        del self.open[to:]

    def _end(self, groups: list[str]) -> None:
        """Close the innermost open element of the first of groups that is in scope."""
        near = self.open[-1][2]
        for g in groups:
            if g in near:
                self._pop(near[g])
                return

    def _end_head(self, always: bool) -> None:
        """Close a head whose end tag is left out; what is open inside it, as noscript, holds it open unless always."""
        if self.places.get("head") and (always or self.open[-1][0] == "head"):
            self._pop(self.places["head"][-1])

    def handle_endtag(self, tag: str) -> None:
        at = self.places.get(tag)
        if at:
            if tag not in INLINE or self.blocks[-1] < at[-1]:  # a stray end of an inline element closes no block
                self._pop(at[-1])
        elif tag == "p":
            self.block += 1

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head(False)
        if not self.silent:
            self.pieces.append((self.block, self.open[-1][1], data, self.links > 0))


#: elements whose whole inside is another part than the article, wherever they stand
ASIDE = set("nav footer aside form menu dialog".split())


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def features(tree: Tree) -> list[list[str]]:
    n = len(tree.tags)
    own, own_links = [0] * n, [0] * n
    for _, node, text, link in tree.pieces:
        size = len(text.strip())
        own[node] += size
        own_links[node] += size * link
    total, total_links = own[:], own_links[:]
    for i in range(n - 1, 0, -1):
        total[tree.parents[i]] += total[i]
        total_links[tree.parents[i]] += total_links[i]
    plain = max(total[0] - total_links[0], 1)
    inside = [""] * n  # the innermost of these that a node is or stands in
    for i in range(1, n):
        inside[i] = tree.tags[i] if tree.tags[i] in ASIDE else inside[tree.parents[i]]
    return [
        [
            f"{'tag' if tree.names[i] else 'bare'} {tree.tags[i]}",
            *([f"inside {inside[i]}"] if inside[i] else [f"most {_bucket((total[i] - total_links[i]) * 100, (plain * 15, plain * 40, plain * 65, plain * 90))} {tree.tags[i] in TEXTUAL}"]),
            f"own {_bucket(own[i], (1, 25))} {_bucket(own_links[i] * 100, (own[i] * 30 + 1, own[i] * 80 + 1))}",
            f"all {_bucket(total[i], (1, 100, 400))} {_bucket(total_links[i] * 100, (total[i] * 30 + 1, total[i] * 70 + 1))}",
            *(f"name {x}" for x in dict.fromkeys(tree.names[i])),
            *([] if i else [f"body {_bucket(own[0], (1, 60, 200))} {tree.bare}"]),
            *([f"alone {_bucket(own_links[i] * 100, (own[i] * 50 + 1,))} {tree.tags[i] if tree.tags[i] in TEXTUAL else 'div'}"] if tree.bare else []),
        ]
        for i in range(n)
    ]


def bond(tree: Tree, i: int) -> int:
    """Which parent-child table holds for node i: that of the body's children, or of named, textual, article or other elements."""
    if tree.parents[i] == 0:
        return 4
    return 0 if tree.names[i] else 1 if tree.tags[i] in TEXTUAL else 2 if tree.tags[i] in ("article", "main") else 3


class Model:
    """Log-odds of the features and a parent-child table for each kind of bond."""

    def __init__(self, odds: dict[str, float], root: tuple[float, float], child: list[tuple]) -> None:
        self.odds, self.root, self.child = odds, root, child

    def marginals(self, tree: Tree, given: list[list[str]] | None = None) -> list[float]:
        """Sum-product: probability of content for each node."""
        n, odds = len(tree.tags), self.odds
        local = []
        for f in given or features(tree):
            x = max(-25.0, min(25.0, sum(odds.get(k, 0.0) for k in f)))
            local.append((1 / (1 + math.exp(x)), 1 / (1 + math.exp(-x))))
        tables = [self.child[bond(tree, i)] for i in range(n)]
        up = [list(x) for x in local]  # own potential times the messages from below
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            x, y = up[i]
            (a, b), (c, d) = tables[i]
            m = (a * x + b * y, c * x + d * y)
            s = m[0] + m[1]
            sent[i] = m = (m[0] / s, m[1] / s)
            p = up[tree.parents[i]]
            p[0] *= m[0]
            p[1] *= m[1]
            s = p[0] + p[1]
            p[0] = max(p[0] / s, 1e-300)
            p[1] = max(p[1] / s, 1e-300)
        belief = [(up[0][0] * self.root[0], up[0][1] * self.root[1])] + [(0.0, 0.0)] * (n - 1)
        for i in range(n):
            if i:
                q = belief[tree.parents[i]]
                (a, b), (c, d) = tables[i]
                x, y = q[0] / max(sent[i][0], 1e-300), q[1] / max(sent[i][1], 1e-300)
                belief[i] = ((a * x + c * y) * up[i][0], (b * x + d * y) * up[i][1])
            s = belief[i][0] + belief[i][1]
            belief[i] = (belief[i][0] / s, belief[i][1] / s)
        return [x[1] for x in belief]

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        tree = Tree(html)
        content = self.marginals(tree)
        blocks: dict[int, list[str]] = {}
        for block, node, text, _ in tree.pieces:
            if content[node] >= 0.5:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


def train(pages: list[str], rounds: int = 12, rate: float = 0.03, smoothing: float = 0.5) -> Model:
    """Fit on labelled pages, whose elements have data-y of 0 or 1.

    The parent-child table and the first log-odds are counts; the log-odds then climb the conditional likelihood of the
    labels, whose gradient is label minus marginal, page by page with a falling rate.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    n, pairs, made, roots = [0, 0], [[[1.0, 1.0], [1.0, 1.0]] for _ in range(5)], [], [1.0, 1.0]
    for html in pages:
        tree = Tree(html)
        y, f = [g == "1" for g in tree.gold], features(tree)
        made.append((tree, y, f))
        roots[y[0]] += 1
        for i in range(len(y)):
            n[y[i]] += 1
            seen[y[i]].update(f[i])
            if i:
                pairs[bond(tree, i)][y[tree.parents[i]]][y[i]] += 1
    odds = {k: 0.3 * (math.log((seen[1][k] + smoothing) / (n[1] + 1)) - math.log((seen[0][k] + smoothing) / (n[0] + 1))) for k in seen[0] | seen[1]}
    model = Model(odds, (roots[0] / sum(roots), roots[1] / sum(roots)), [tuple((row[0] / sum(row), row[1] / sum(row)) for row in kind) for kind in pairs])
    for k in range(rounds):
        for tree, y, f in made:
            for i, p in enumerate(model.marginals(tree, f)):
                step = rate / (1 + k) * (y[i] - p)
                if abs(step) > 1e-3:
                    for x in f[i]:
                        odds[x] += step
    return model


def extract_text(pages: DataFrame, model: Model, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the column out_col (replaced where it exists): the main text of each page."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([model.extract(h) for h in html], dtype=object)

    return pages.withColumn(out_col, main_text(F.col(html_col).cast("string")))


def default_model(n_pages: int = 800, seed: int = 1) -> Model:
    return train(labelled_pages(n_pages, seed))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(read(spark, sf_dir, "pages"), default_model())
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
