"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every stretch of text is a node that is content or not. A node has a log-linear potential over
its tag, what its id, class, role and the like call it, and shares of text and links beneath it; every edge has a
potential over the labels of parent and child, by kind of edge. Sum-product messages, first from the leaves up and then
from the root down, give exact marginals, and stretches whose marginal is above one half are the main text, in page order.

The weights are trained on labelled pages (html, and the text wanted, a line for each block) by gradient steps on the
penalised log-likelihood, whose gradient is what the same messages expect against what is labelled. The penalty draws
weights to a stated prior (PRIOR), which speaks for cues that the labelled pages do not show. At most `LABELLED` labelled
pages are used, chosen by hash, of at most `NODES` nodes each; every page is then extracted, whole.

Without pages labelled by hand, `marked_pages` takes as labelled those that mark exactly one article themselves. In half
of the training pages tags that name a part of a page are read as plain boxes, and in half of that half cues are hidden,
too, so that the weights of text, links and tree do not lean on the marks alone.

Null or empty html: empty text. Very long pages: read whole. Null ids and repeated rows: a row each. Broken markup: read as
far as it goes (`html_tree`). Without labelled pages the prior alone decides. An empty table: no rows. Other columns are
ignored, whatever their names; columns named in `keep` are carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.html_tree import Page, attributes_of, parse

#: Bounds of the labelled sample: pages, and nodes of a page. Gradient steps and their length; strength of the prior.
LABELLED, NODES, STEPS, RATE, RIDGE = 200, 2_000, 120, 0.25, 0.1
#: Characters of html that a worker holds as trees at once; one longer page is held by itself.
TOGETHER = 4_000_000
#: Groups of tags with the prior weight of a node of the group.
TAGS = {
    "article": (2.5, "article main"), "nav": (-5.0, "nav menu"), "header": (-1.5, "header"), "footer": (-5.0, "footer address"), "aside": (-5.0, "aside dialog search"),
    "form": (-5.0, "form fieldset legend"), "heading": (0.3, "h1 h2 h3 h4 h5 h6 hgroup"), "prose": (0.5, "p blockquote pre figure figcaption dl dt dd"), "list": (0.0, "ul ol li"),
    "table": (0.0, "table caption thead tbody tfoot tr td th"), "box": (0.0, "div section center details summary"), "root": (0.0, "html body"),
}
#: Words of id, class, role and the like that are cues, with the prior weight of a node that has one.
CUES = {
    "main": (1.5, "article articlebody main content post entry story"),
    "menu": (-5.0, "nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar pagination pager tabs skip masthead"),
    "header": (-4.0, "header banner logo"),
    "footer": (-5.0, "footer foot copyright colophon contentinfo legal"),
    "side": (-5.0, "sidebar aside side complementary related recommended recommendations trending popular widget widgets share sharing social rail"),
    "notice": (-5.0, "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall promo toast disclaimer"),
    "advert": (-5.0, "ad ads adv advert adverts advertisement advertising sponsor sponsored promoted adsense"),
    "form": (-4.0, "form search login signup signin register"),
    "comments": (-6.0, "comment comments reviews reply replies respond disqus discussion responses usercomments"),
    "hidden": (-5.0, "hidden"),
}
#: Prior of an edge: both content, both not, only the parent content, only the child content. "part": anywhere below
#: what is marked as another part of the page, by its tag or a cue.
EDGES = {"root": (0.0, 0.5, 0.0, 0.0), "box": (1.0, 1.0, -0.5, -1.0), "article": (1.5, 0.5, -0.5, -1.5), "prose": (2.0, 2.0, -2.0, -2.0), "part": (-2.0, 6.0, 0.0, -8.0), "text": (2.0, 2.0, -2.0, -2.0)}
_TAG = {t: k for k, (_, tags) in enumerate(TAGS.values()) for t in tags.split()}
_CUE = {w: k for k, (_, words) in enumerate(CUES.values()) for w in words.split()}
_EDGE = {name: k for k, name in enumerate(EDGES)}
_NAMED = ("id", "class", "role", "itemprop", "aria-label", "data-component", "data-testid")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: bias, stretch of text, size of text beneath, its share of the page, links' share beneath, stretches beneath, their mean size, ends like a sentence, © in it
_SHAPE = (-0.5, 0.2, 0.2, 1.0, -3.0, 0.0, 0.3, 0.5, -1.0)
WIDE = len(TAGS) + len(CUES) + len(_SHAPE)
PRIOR = np.array([*[w for w, _ in TAGS.values()], *[w for w, _ in CUES.values()], *_SHAPE, *[x for e in EDGES.values() for x in e]])
_APART = np.array([w < -2.5 for w, _ in CUES.values()], np.float32)
_BOX, _MARKS = _TAG["div"], {_TAG[t] for t in ("article", "nav", "header", "footer", "aside", "form")}


def cues_of(raw: str) -> set[int]:
    if not raw or raw.isspace():
        return set()
    named = attributes_of(raw)
    words = {w.lower() for k in _NAMED for w in _WORD.findall(named.get(k, ""))}
    found = {_CUE[w] for w in words if w in _CUE}
    if "hidden" in named or named.get("aria-hidden") == "true" or _HIDDEN.search(named.get("style", "")):
        found.add(_CUE["hidden"])
    # The header of an entry is where its headline stands.
    return found - {_CUE["header"]} if _CUE["entry"] in found else found


class Forest:
    """Nodes of some pages with their features, as arrays; parents come before their children."""

    def __init__(self, pages: list[Page], blind: list[int] | None = None):
        """blind: for each page 1 to read marked parts as boxes, 2 to hide cues, too."""
        sizes = [len(p.parent) for p in pages]
        start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(start[-1])
        self.start, self.page = start, np.repeat(np.arange(len(pages)), sizes)
        self.parent = np.array([-1 if p < 0 else p + s for page, s in zip(pages, start, strict=False) for p in page.parent], np.int64)
        stretch = np.array([t == "" for page in pages for t in page.tag], bool)
        chars = np.array([len(t) for page in pages for t in page.text], np.float64)
        linked = np.array([x for page in pages for x in page.linked], np.float64)
        count = stretch.astype(np.float64)
        depth = np.zeros(n, np.int64)
        for i, p in enumerate(self.parent.tolist()):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
        for level in reversed(self.levels[1:]):
            for column in (chars, linked, count):
                np.add.at(column, self.parent[level], column[level])
        # Elements without text beneath say nothing; they are left out of the sums by zero potentials.
        self.empty = count == 0
        group = np.array([_TAG.get(t, _BOX) for page in pages for t in page.tag], np.int64)
        x = np.zeros((n, WIDE), np.float32)
        ends = [("" if not t else t[-1]) for page in pages for t in page.text]
        for k, (page, at) in enumerate(zip(pages, start, strict=False)):
            hide = blind[k] if blind else 0
            if hide:
                group[at : at + len(page.tag)] = [_BOX if g in _MARKS else g for g in group[at : at + len(page.tag)]]
            if hide < 2:
                for i, raw in enumerate(page.attributes):
                    for c in cues_of(raw):
                        x[at + i, len(TAGS) + c] = 1
        body = np.flatnonzero(~stretch)
        x[body, group[body]] = 1
        c = len(TAGS) + len(CUES)
        total = np.maximum(1, chars[start[:-1]])[self.page] if n else chars
        some = np.maximum(1, chars)
        x[:, c] = 1
        x[:, c + 1] = stretch
        x[:, c + 2] = np.log1p(chars) / 4
        x[:, c + 3] = chars / total
        x[:, c + 4] = linked / some
        x[:, c + 5] = np.log1p(count) / 3
        x[:, c + 6] = np.log1p(chars / np.maximum(1, count)) / 4
        x[:, c + 7] = [e in ".!?…。:;\"”»)" and e != "" for e in ends]
        x[:, c + 8] = ["©" in t for page in pages for t in page.text]
        x[self.empty] = 0
        part = np.isin(group, [_TAG[t] for t in ("nav", "footer", "aside", "form")]) | (x[:, len(TAGS) : c] @ _APART > 0)
        # What marks the main text does not do so inside another part of the page.
        under = np.zeros(n, bool)
        for level in self.levels[1:]:
            under[level] = under[self.parent[level]] | part[self.parent[level]]
        marked = under & (group == _TAG["article"])
        group[marked] = _BOX
        x[marked, _TAG["article"]], x[marked & ~self.empty, _BOX] = 0, 1
        x[under, len(TAGS) + _CUE["main"]] = 0
        self.x, self.stretch = x, stretch
        above = group[np.maximum(self.parent, 0)]
        kind = np.full(n, _EDGE["box"])
        kind[above == _TAG["html"]] = _EDGE["root"]
        kind[above == _TAG["article"]] = _EDGE["article"]
        kind[np.isin(above, [_TAG[t] for t in ("p", "ul", "table", "h1")])] = _EDGE["prose"]
        kind[stretch] = _EDGE["text"]
        kind[under] = _EDGE["part"]
        self.kind = kind


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def marginals(forest: Forest, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of (node, label) and of (node, parent's label, own label); those of roots' edges are zero."""
    n = len(forest.parent)
    edge = weights[WIDE:].reshape(-1, 4)[:, [1, 3, 2, 0]].reshape(-1, 2, 2)[forest.kind]  # [parent's label, own label]
    edge = np.where(forest.empty[:, None, None], 0.0, edge)
    belief = np.zeros((n, 2))
    belief[:, 1] = forest.x @ weights[:WIDE]
    up = np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        up[level] = _logsum(edge[level] + belief[level][:, None, :], 2)
        np.add.at(belief, forest.parent[level], up[level])
    down, pair = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        p = forest.parent[level]
        rest = (belief[p] + down[p] - up[level])[:, :, None] + edge[level]
        down[level] = _logsum(rest, 1)
        both = rest + belief[level][:, None, :]
        pair[level] = np.exp(both - _logsum(both.reshape(-1, 4), 1)[:, None, None])
    total = belief + down
    return np.exp(total - _logsum(total, 1)[:, None]), pair


def labels_of(forest: Forest, pages: list[Page], wanted: list[str]) -> np.ndarray:
    """A stretch is content if it is a line of the wanted text; an element if most of its text is."""
    lines = [set(w.split("\n")) for w in wanted]
    good = np.array([len(t) if t in lines[k] else 0 for k, page in enumerate(pages) for t in page.text], np.float64)
    chars = np.array([len(t) for page in pages for t in page.text], np.float64)
    for level in reversed(forest.levels[1:]):
        np.add.at(good, forest.parent[level], good[level])
        np.add.at(chars, forest.parent[level], chars[level])
    return (2 * good > chars).astype(np.int64)


def gradient(forest: Forest, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of the labels: what is labelled less what is expected."""
    node, pair = marginals(forest, weights)
    out = np.zeros(len(PRIOR))
    out[:WIDE] = forest.x.T @ (labels - node[:, 1])
    inner = np.flatnonzero((forest.parent >= 0) & ~forest.empty)
    seen = np.zeros((len(inner), 2, 2))
    seen[np.arange(len(inner)), labels[forest.parent[inner]], labels[inner]] = 1
    by_kind = np.zeros((len(EDGES), 2, 2))
    np.add.at(by_kind, forest.kind[inner], seen - pair[inner])
    out[WIDE:] = by_kind.reshape(-1, 4)[:, [3, 0, 2, 1]].ravel()
    return out


def fit(samples: list[tuple[str, str]]) -> np.ndarray:
    """Weights from labelled pages (html, wanted text)."""
    pages = [parse(h) for h, _ in samples]
    fine = [k for k, p in enumerate(pages) if len(p.parent) <= NODES]
    if not fine:
        return PRIOR.copy()
    pages, wanted = [pages[k] for k in fine], [samples[k][1] for k in fine]
    forest = Forest(pages, blind=[max(0, (zlib.crc32(samples[k][0].encode()) >> 3) % 4 - 1) for k in fine])
    labels = labels_of(forest, pages, wanted)
    weights, mean, square = PRIOR.copy(), np.zeros(len(PRIOR)), np.zeros(len(PRIOR))
    for step in range(1, STEPS + 1):
        g = gradient(forest, labels, weights) / len(pages) - RIDGE * (weights - PRIOR)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        weights = weights + RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def extract(pages: list[Page], weights: np.ndarray) -> list[str]:
    forest = Forest(pages)
    chosen = forest.stretch & (marginals(forest, weights)[0][:, 1] > 0.5)
    out = []
    for page, at in zip(pages, forest.start, strict=False):
        out.append("\n".join(t for t, c in zip(page.text, chosen[at : at + len(page.text)], strict=True) if c))
    return out


_PART_OUT = frozenset("nav aside form footer menu dialog search".split())


def marked_text(source: str) -> str | None:
    """The text of the one article that a page marks itself, or None if it does not mark exactly one."""
    page = parse(source)
    marks = [k for k, t in enumerate(page.tag) if t == "article"]
    if len(marks) != 1 or cues_of(page.attributes[marks[0]]) - {_CUE["main"]}:
        return None
    inside, out = {marks[0]}, []
    for k in range(marks[0] + 1, len(page.tag)):
        if page.parent[k] in inside:
            if page.tag[k] == "":
                out.append(page.text[k])
            elif page.tag[k] not in _PART_OUT and not cues_of(page.attributes[k]) - {_CUE["main"]}:
                inside.add(k)
    return "\n".join(out) or None


def marked_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(html, text) of a sample of the pages that mark exactly one article: at most `LABELLED`, with the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h, t) for h in b.column(0).to_pylist() if (t := marked_text(h))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["html", "text"])

    bounded = pages.select(F.col(html_col).alias("html")).where(F.length("html") < 40 * NODES)
    few = bounded.orderBy(F.xxhash64("html"), "html").limit(2 * LABELLED)
    return few.mapInArrow(run, "html string, text string").orderBy(F.xxhash64("html"), "html").limit(LABELLED)


def train(labelled: DataFrame) -> np.ndarray:
    """Weights from (html, text): at most `LABELLED` rows, with the least hashes, meet the driver."""
    rows = labelled.where("html is not null and text is not null").where(F.length("html") < 40 * NODES)
    return fit([(r["html"], r["text"]) for r in rows.orderBy(F.xxhash64("html", "text"), "html", "text").limit(LABELLED).collect()])


def main_text(pages: DataFrame, weights: np.ndarray, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep columns, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column(b.num_columns - 1)
            at = 0
            while at < b.num_rows:
                held: list[Page] = []
                size = 0
                while at + len(held) < b.num_rows and size < TOGETHER:
                    source = sources[at + len(held)].as_py() or ""
                    size += len(source) + 1_000
                    held.append(parse(source))
                text = extract(held, shared.value)
                kept = [c.slice(at, len(held)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*keep, "text", "n_chars"])
                at += len(held)

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string, n_chars long")
